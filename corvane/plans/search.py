"""Search and document requests as tables: what a page of results and a page of one document show, for any number at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import rendering, scoring
from corvane.operators.index import Index

MOST_RESULTS, RESULTS, AGGREGATORS = 100, 10, ("top3", "max", "top3_log")


def search(idx: Index, chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(qid, terms, results) of each of ``requests`` (qid, q, k, mode, agg).

    ``k`` counts results, 1 to 100 (beyond that the nearest of these; null: 10); ``mode`` is ``chunk`` or documents, which are
    ranked by ``agg`` (null or unknown: top3). ``terms`` are the question's tokens that the vocabulary has. An empty question has
    neither terms nor results. Results are at most 100 structs, best first.
    """
    asked = requests.select("qid", T.text_of("q").alias("question"), F.greatest(F.lit(1), F.least(F.lit(MOST_RESULTS), F.coalesce(F.col("k").cast("int"), F.lit(RESULTS)))).alias("k"), F.coalesce(F.col("mode") == "chunk", F.lit(False)).alias("by_chunk"), F.coalesce("agg", F.lit("top3")).alias("agg"))
    some = asked.where("question <> ''")
    limits = some.select("qid", "k", "by_chunk", F.when(F.col("agg").isin(*AGGREGATORS), F.col("agg")).otherwise("top3").alias("agg"))
    pool = scoring.best_chunks(idx, some.select("qid", "question"), scoring.POOL).join(limits, "qid")
    shown = [rendering.search_chunks(pool.where(F.col("by_chunk") & (F.col("rnk") <= F.col("k"))).drop("k", "by_chunk", "agg"), chunks)]
    counts = scoring.chunks_per_doc(idx)
    for agg in AGGREGATORS:
        docs = scoring.rank_docs(pool.where(~F.col("by_chunk") & (F.col("agg") == agg)), agg, MOST_RESULTS, counts).join(limits.select("qid", "k"), "qid").where("rnk <= k").drop("k")
        shown.append(rendering.search_results(docs, chunks))
    rows = reduce(DataFrame.unionByName, shown)
    names = [c for c in rows.columns if c not in ("qid", "rnk")]
    results = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rnk", *names))).alias("results"))
    return requests.select("qid").distinct().join(scoring.hit_terms(idx, some.select("qid", "question")), "qid", "left").join(results, "qid", "left").select("qid", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("results", F.array()).alias("results"))


def documents(requests: DataFrame, docs: DataFrame, terms: list[str] | None = None, focus: str = "") -> DataFrame:
    """``rendering.document_view`` of ``requests`` (doc_id: text) with ``error``: ``invalid`` for an id that is not of digits
    alone, ``unknown`` for one that no document has, else null."""
    wanted = requests.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    view = rendering.document_view(wanted, docs.withColumn("doc_id", F.col("doc_id").cast("string")), terms, focus)
    valid = F.coalesce(F.col("doc_id").rlike(r"\A\p{Nd}+\z"), F.lit(False))
    held = valid & F.col("found")
    blank = [F.when(held, F.col(c)).alias(c) for c in view.columns if c not in ("doc_id", "found")]
    return view.select("doc_id", held.alias("found"), *blank, F.when(~valid, "invalid").when(~F.col("found"), "unknown").alias("error"))
