"""Answers: ranked documents, padded by popular ones, as ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANSWERS, POPULAR = 5, 20


def popular(gold: DataFrame, n: int = POPULAR) -> DataFrame:
    """(doc_id, place) of the ``n`` most frequent documents of ``gold`` (doc_id, pos); of equals the first met comes first."""
    counted = gold.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    top = counted.orderBy(F.desc("n"), "first", "doc_id").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first", "doc_id"))).select("doc_id", "place")


def padded(questions: DataFrame, ranked: DataFrame, fallback: DataFrame, k: int = ANSWERS) -> DataFrame:
    """(qid, doc_id, place) of ``k`` documents for each question: its ranked ones, then those of ``fallback`` (at most
    POPULAR rows) that are not among them."""
    own = ranked.select("qid", "doc_id", F.col("rnk").alias("p"), F.lit(0).alias("kind"))
    spare = questions.select("qid").crossJoin(F.broadcast(fallback)).select("qid", "doc_id", F.col("place").alias("p"), F.lit(1).alias("kind"))
    every = own.unionByName(spare).groupBy("qid", "doc_id").agg(F.min(F.struct("kind", "p")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("qid", "doc_id", "place")


def answers(rows: DataFrame) -> DataFrame:
    """(qid, answer): document ids as strings in order of their place."""
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("answer"))


def length_histogram(answered: DataFrame) -> DataFrame:
    return answered.groupBy(F.size("answer").alias("n_ids")).agg(F.count(F.lit(1)).alias("n_questions"))


def summary(rows: DataFrame, ranked: DataFrame, k: int = ANSWERS) -> DataFrame:
    """One row about padded answers ``rows`` (qid, doc_id): n_questions, n_documents (different ones), and n_padded, the
    questions of which ``ranked`` has fewer than ``k`` documents."""
    own = ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("own"))
    per = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).join(own, "qid", "left")
    counted = per.agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.coalesce("own", F.lit(0)) < k).alias("n_padded"))
    return counted.crossJoin(F.broadcast(rows.agg(F.count_distinct("doc_id").alias("n_documents"))))


def submission_json(answered: DataFrame) -> DataFrame:
    """One row: the submission as a JSON object by question."""
    entries = F.array_sort(F.collect_list(F.struct("qid", F.struct("answer").alias("value"))))
    return answered.select(F.col("qid").cast("string").alias("qid"), "answer").agg(F.to_json(F.map_from_entries(entries)).alias("json"))
