"""All queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from corvane.llm import queries_documents, queries_links, queries_manifest, queries_native, queries_pages, queries_series, queries_tokens, queries_vectors

_PARTS = (queries_tokens, queries_documents, queries_links, queries_native, queries_pages, queries_manifest, queries_series, queries_vectors)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
