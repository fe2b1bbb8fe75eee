"""Query of the similarity join: op8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import ngram_join
from corvane.llm.common import table


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of 4-word shingles with a similarity of 0.85 or more."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), size=4, percent=85)


QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
ORACLES: dict[str, str] = {}
