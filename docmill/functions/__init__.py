"""Column expressions: text, scores, JSON, citations."""
