"""Metrics of ranked documents against gold documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = 20


def per_question(ranked: DataFrame, gold: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """Recall, precision, hit (at ``k``) and reciprocal rank (in ``ranked``, RANKS deep) of each question of ``gold``.

    ``ranked``: qid, doc_id, rnk and the columns of ``by``, configurations that all cover the questions with any result.
    """
    by = by or []
    wanted = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    if by:
        wanted = wanted.crossJoin(F.broadcast(ranked.select(*by).distinct()))
    marked = ranked.join(gold.select("qid", "doc_id", F.lit(1).alias("g_")), ["qid", "doc_id"], "left")
    found = marked.groupBy("qid", *by).agg(F.count_if(F.col("rnk") <= k).alias("n_pred"), F.count_if((F.col("rnk") <= k) & F.col("g_").isNotNull()).alias("inter"), F.min(F.when(F.col("g_").isNotNull(), F.col("rnk"))).alias("first"))
    both = wanted.join(found, ["qid", *by], "left")
    inter = F.coalesce("inter", F.lit(0))
    return both.select(
        "qid", *by, (inter / F.col("n_gold")).alias("recall"), F.coalesce(F.try_divide(inter, F.col("n_pred")), F.lit(0.0)).alias("precision"),
        (inter > 0).cast("double").alias("hit"), F.coalesce(1 / F.when(F.col("first") <= max(k, RANKS), F.col("first")), F.lit(0.0)).alias("rr"), F.col("first"),
    )


def means(questions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return questions.groupBy(*(by or [])).agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("hit").alias("hit"), F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n_questions"))


def rank_histogram(questions: DataFrame) -> DataFrame:
    """Questions by the rank of their first gold document, with their share."""
    bucket = F.when(F.col("first") == 1, "1").when(F.col("first") <= 3, "2-3").when(F.col("first") <= 5, "4-5").when(F.col("first") <= 10, "6-10").when(F.col("first") <= RANKS, "11-20").otherwise("outside")
    counted = questions.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = questions.agg(F.count(F.lit(1)).alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("bucket", "n", (100 * F.col("n") / F.col("total")).alias("percent"))


def sample(questions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` questions by a seeded hash of their id; 0 means all."""
    return questions if n == 0 else questions.orderBy(F.xxhash64("qid", F.lit(seed)), "qid").limit(n)


def best(metrics: DataFrame, by: list[str], metric: str = "recall") -> DataFrame:
    """The configuration (``by``) of the highest ``metric``, one row; of equals the first in order of ``by``."""
    return metrics.orderBy(F.round(metric, 9).desc(), *by).limit(1)


def deltas(metrics: DataFrame, baseline: Column, metric: str = "recall") -> DataFrame:
    """``metrics``, a row for each configuration, with ``delta``: ``metric`` less that of the row where ``baseline`` holds."""
    base = metrics.where(baseline).agg(F.first(metric).alias("base_"))
    return metrics.crossJoin(F.broadcast(base)).withColumn("delta", F.col(metric) - F.col("base_")).drop("base_")


def matrix(metrics: DataFrame, row: str, column: str, values: list, metric: str = "recall") -> DataFrame:
    """``metric`` by ``row`` and by each of ``values`` of ``column``."""
    return metrics.groupBy(row).pivot(column, values).agg(F.first(metric))
