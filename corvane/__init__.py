"""Corvane: a PySpark-native engine for passage retrieval, ranking and evaluation."""
