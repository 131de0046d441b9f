"""Tables, sinks and materialisation."""
