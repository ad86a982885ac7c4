"""Queries by name, and the SQL they are checked against."""

from papyrion.plans import document_queries, layout_queries, memory_queries, page_queries, source_queries, text_queries

MODULES = (text_queries, memory_queries, layout_queries, page_queries, source_queries, document_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
