"""BM25 scores and rankings of chunks and documents for any number of questions at once.

Ties: scores are compared at nine decimals, then the lower chunk or document number wins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.index import Index
from corvane.operators.matching import bounded, matches
from corvane.sources.products import shared_root, stored

K1, B, POOL, TOP = 2.5, 0.9, 3000, 5



def query_terms(questions: DataFrame) -> DataFrame:
    """(qid, term, qtf) of ``questions`` (qid, question); a repeated token weighs as often as it stands there."""
    return questions.select("qid", F.explode(T.tokens("question")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def hit_terms(index: Index, questions: DataFrame) -> DataFrame:
    """(qid, terms): the question's tokens that the vocabulary has, in order, duplicates kept."""
    each = questions.select("qid", F.posexplode(T.tokens("question")).alias("pos", "term"))
    found = each.join(index.vocab.select("term"), "term", "left_semi")
    return found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))


def known_terms(index: Index, questions: DataFrame) -> DataFrame:
    """(qid, terms): what a document view highlights, the question's tokens of the vocabulary, each once, in order of
    letters."""
    return query_terms(questions).join(index.vocab.select("term"), "term", "left_semi").groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def _weighted(index: Index, asked: DataFrame, k1: float | None = None) -> DataFrame:
    """(qid, term, qtf, idf) of the question's terms that the vocabulary has, with ``w``, their weight for one k1."""
    weights = asked.join(index.vocab.select("term", "idf"), "term")
    return weights if k1 is None else weights.withColumn("w", F.col("qtf") * F.col("idf") * F.lit(k1 + 1))


def _looked_for(index: Index, questions: DataFrame) -> DataFrame:
    """(qid, term, w) of the questions' terms that the vocabulary has; ``w`` does not depend on parameters."""
    return _weighted(index, query_terms(questions)).select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w"))


def score(index: Index, questions: DataFrame, params: DataFrame | None = None, k1: float = K1, b: float = B, k: int | None = None, longer: DataFrame | None = None, mode: str = "max", share: float = 0.3) -> DataFrame:
    """(qid, chunk_idx, doc_id, score) of every chunk with a term of the question.

    ``params`` (k1, b: one row for each pair, a table of parameters) scores for each of its rows in one job and adds its
    columns. ``k``: chunks that are certainly not among the ``k`` best of a question and pair may be missing. ``longer`` (qid,
    question): the questions in another form, whose scores are combined by ``mode``, see ``expansion.combine``.
    """
    pairs = [(float(k1), float(b))] if params is None else [(float(r["k1"]), float(r["b"])) for r in params.select("k1", "b").collect()]
    found = matches(index, _looked_for(index, questions), None if longer is None else _looked_for(index, longer), pairs or [(k1, b)], k, mode, share)
    keys = ["qid", "chunk_idx", "doc_id"]
    if params is None:
        return found.select(*keys, F.col("scores")[0].alias("score"))
    if k is not None:  # scores go to the ranking in one row for all pairs, which become rows there
        found = found.repartition("qid")
    each = F.array(*[F.struct(F.lit(x).alias("k1"), F.lit(y).alias("b"), F.get("scores", F.lit(i)).alias("score")) for i, (x, y) in enumerate(pairs or [(k1, b)])])
    return found.select(*keys, F.inline(each)).where("score is not null" if pairs else "false")


def best_chunks(index: Index, questions: DataFrame, k: int, k1: float = K1, b: float = B, longer: DataFrame | None = None, mode: str = "max", share: float = 0.3) -> DataFrame:
    """The rows of ``top_chunks(score(index, questions), k)``, written to the shared folder: whoever reads them often scores once."""
    return stored(top_chunks(score(index, questions, k1=k1, b=b, k=k, longer=longer, mode=mode, share=share), k), "pool")


def top_chunks(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` best chunks of each question (and of each further key of ``by``), with their rank ``rnk`` from 1."""
    order = Window.partitionBy("qid", *(by or [])).orderBy(F.round("score", 9).desc(), "chunk_idx")
    return scores.where("score > 0").withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


@dataclass
class Bounded:
    """``top``: the best chunks. ``tally``: (stage, scored), the postings that each stage has scored, and, as stage ``matched``,
    those that a score of every match takes."""

    top: DataFrame
    tally: DataFrame


def bounded_top_chunks(index: Index, questions: DataFrame, k: int, k1: float = K1, b: float = B, root: str | None = None) -> Bounded:
    """The rows of ``top_chunks(score(index, questions), k)``, from bounds: see ``matching.bounded``. Terms that can't lift a
    chunk to the best ones any more are not scored. What the tasks find is written once, below ``root`` (the shared folder by
    default)."""
    rows = bounded(index, _looked_for(index, questions), (k1, b), k)
    at = f"{root or shared_root(questions.sparkSession)}/bounded-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    found = questions.sparkSession.read.schema(rows.schema).parquet(at)
    top = top_chunks(found.where("stage is null").select("qid", "chunk_idx", "doc_id", "score"), k)
    none = questions.sparkSession.range(1).select(F.explode(F.array(F.lit("matched"), F.lit("seeds"))).alias("stage"), F.lit(0).cast("long").alias("scored"))
    return Bounded(top, found.where("stage is not null").select("stage", "scored").unionByName(none).groupBy("stage").agg(F.sum("scored").alias("scored")))


def rank_docs(pool: DataFrame, agg: str = "top3", k: int = TOP, doc_chunks: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Documents of a ranked pool (qid, chunk_idx, doc_id, score, rnk): qid, doc_id, score, best_chunk, n_chunk, rnk.

    ``agg``: ``max``, the best chunk; ``top3``, the mean of the best three or fewer; ``top3_log``, that over the logarithm of
    one plus the document's chunks in the corpus, from ``doc_chunks`` (doc_id, n). Other names mean ``top3``.
    """
    keys = ["qid", *(by or [])]
    in_doc = Window.partitionBy(*keys, "doc_id").orderBy("rnk")
    ranked = pool.withColumn("r_", F.row_number().over(in_doc))
    value = F.max("score") if agg == "max" else F.avg(F.when(F.col("r_") <= 3, F.col("score")))
    docs = ranked.groupBy(*keys, "doc_id").agg(value.alias("score"), F.min_by("chunk_idx", "rnk").alias("best_chunk"), F.count(F.lit(1)).cast("int").alias("n_chunk"), F.min("rnk").alias("first_"))
    if agg == "top3_log":
        docs = docs.join(doc_chunks, "doc_id").withColumn("score", F.col("score") / F.log1p(F.col("n").cast("double"))).drop("n")
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "first_")
    return docs.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k).drop("first_")


def chunks_per_doc(index: Index) -> DataFrame:
    return index.chunk_stats.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def search_docs(index: Index, questions: DataFrame, chunks: DataFrame | None = None, agg: str = "max", k: int = TOP, pool: int = POOL, k1: float = K1, b: float = B) -> DataFrame:
    """Ranked documents of each question; ``chunks`` adds path, n_words, tier and text of each best chunk."""
    ranked = rank_docs(best_chunks(index, questions, pool, k1, b), agg, k, chunks_per_doc(index))
    if chunks is None:
        return ranked
    return ranked.join(chunks.select(F.col("chunk_idx").alias("best_chunk"), "path", "n_words", "tier", "text"), "best_chunk")
