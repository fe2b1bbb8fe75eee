"""Compositions of operators: the retrieval plan over the tables, its queries, and their SQL."""
