"""Operators: DataFrame in, DataFrame out; all of them work on many queries, documents or submissions at once."""
