"""All core queries by name."""

from docmill.plans import evidence_queries, layout_queries, retrieval_queries

QUERIES = layout_queries.QUERIES | retrieval_queries.QUERIES | evidence_queries.QUERIES
ORACLES = layout_queries.ORACLES | retrieval_queries.ORACLES | evidence_queries.ORACLES
