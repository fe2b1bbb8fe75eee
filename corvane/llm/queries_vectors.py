"""Query of the nearest neighbours: op13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import nearest
from corvane.llm.common import table


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings to each whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(e.where("vec_id % 100 = 0"), e, 10)


QUERIES = {"op13_nearest": op13_nearest}
ORACLES = {
    "op13_nearest": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10""",
}
