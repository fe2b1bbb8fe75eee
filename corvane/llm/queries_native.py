"""Queries of the native operators: op7 (mixing) and op9 (fingerprints)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import fingerprints, mixing
from corvane.llm.common import table


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to weights 1, 2, 3 by source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every whole text and its edited text."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 mixes towards: documents, words and target of every source."""
    return mixing.source_targets(table(spark, sf_dir, "documents"))


def edited_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express: lengths, and digests of the edited texts."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {"op7_mixing": op7_mixing, "op9_fingerprints": op9_fingerprints, "mixing_targets": mixing_targets, "edited_digests": edited_digests}
ORACLES: dict[str, str] = {
    # Each source gives the level at which those that reach their bounds before it are full; the first that its own bound allows.
    "mixing_targets": r"""
WITH s AS (
  SELECT source, count(*) AS n_docs, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS source_size
  FROM documents GROUP BY source
), w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
levels AS (
  SELECT a.source_size, a.weight,
    CAST((SELECT sum(source_size) FROM w) - sum(CASE WHEN b.source_size * a.weight < a.source_size * b.weight THEN 3 * b.source_size ELSE 0 END) AS DOUBLE)
    / CAST(sum(CASE WHEN b.source_size * a.weight < a.source_size * b.weight THEN 0 ELSE b.weight END) AS DOUBLE) AS level
  FROM (SELECT DISTINCT source_size, weight FROM w) a, w b GROUP BY a.source_size, a.weight
)
SELECT source, n_docs, source_size,
  CAST(least(3 * source_size, (SELECT arg_min(level, source_size / weight) FROM levels WHERE level * weight <= 3 * source_size) * weight) AS DOUBLE) AS target FROM w
""",
    "edited_digests": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT doc_id, text, length(text) AS n_chars,
    coalesce(lead(text) OVER o, first_value(text) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS following
  FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text)
)
SELECT doc_id, n_chars, sha256(substring(text, 1, n_chars - n_chars // 2) || substring(following, 1, n_chars // 2)) AS edited_sha256 FROM p
""",
}
