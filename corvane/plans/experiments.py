"""Comparisons over questions with gold documents: parameter sweeps, aggregators, fusions, rerankers. One job each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import evaluation, fusion, scoring
from corvane.operators.index import Index
from corvane.sources.products import stored

DEPTH = 20


def sweep(idx: Index, asked: DataFrame, wanted: DataFrame, k1s: Sequence[float], bs: Sequence[float], agg: str = "top3", pool: int = scoring.POOL, k: int = 5) -> DataFrame:
    """Metrics (k1, b, recall, precision, hit, mrr, n_questions) of every pair of ``k1s`` and ``bs``: a chunk's terms are read
    once for all of them."""
    params = asked.sparkSession.createDataFrame([(float(k1), float(b)) for k1 in k1s for b in bs], "k1 double, b double")
    by = ["k1", "b"]
    cut = scoring.top_chunks(scoring.score(idx, asked, params, k=pool), pool, by)
    ranked = stored(scoring.rank_docs(cut, agg, DEPTH, scoring.chunks_per_doc(idx), by), "ranked")
    return evaluation.means(evaluation.per_question(ranked, wanted, k, by), by)


def aggregators(idx: Index, asked: DataFrame, wanted: DataFrame, names: Sequence[str] = ("max", "top3", "top3_log"), pool: int = scoring.POOL, k: int = 5) -> DataFrame:
    """Metrics by ``agg``, the way that chunks' scores become a document's."""
    cut = scoring.best_chunks(idx, asked, pool)
    ranked = stored(reduce(DataFrame.unionByName, [scoring.rank_docs(cut, a, DEPTH, scoring.chunks_per_doc(idx)).withColumn("agg", F.lit(a)) for a in names]), "ranked")
    return evaluation.means(evaluation.per_question(ranked, wanted, k, ["agg"]), ["agg"])


def fusions(pool: DataFrame, wanted: DataFrame, alphas: Sequence[float] = (0.3, 0.5, 0.7), agg: str = "top3", k: int = 5) -> DataFrame:
    """Metrics by ``fusion`` of a pool with both scores: each alone, reciprocal ranks, and linear mixes at ``alphas``. The pool
    is ranked by all of them in one pass."""
    per = Window.partitionBy("qid")
    mixed = fusion.fuse(pool, "rrf").withColumn("md", fusion.minmax("dense", per)).withColumn("ms", fusion.minmax("score", per))
    configs = {"bm25": F.col("score"), "dense": F.col("dense"), "rrf": F.col("fused"), **{f"linear_{a}": a * F.col("md") + (1 - a) * F.col("ms") for a in alphas}}
    listed = F.array(*[F.struct(F.lit(n).alias("fusion"), c.alias("value")) for n, c in configs.items()])
    each = mixed.select("qid", "chunk_idx", "doc_id", F.inline(listed))
    ranked = stored(scoring.rank_docs(fusion.ranked_by(each, "value", ["fusion"]), agg, DEPTH, by=["fusion"]), "ranked")
    return evaluation.means(evaluation.per_question(ranked, wanted, k, ["fusion"]), ["fusion"])


def systems(ranked: dict[str, DataFrame], wanted: DataFrame, k: int = 5) -> DataFrame:
    """Metrics by ``system`` of rankings (qid, doc_id, rnk) by name, such as those with and without a reranker."""
    every = stored(reduce(DataFrame.unionByName, [df.select("qid", "doc_id", "rnk").withColumn("system", F.lit(n)) for n, df in ranked.items()]), "ranked")
    return evaluation.means(evaluation.per_question(every, wanted, k, ["system"]), ["system"])
