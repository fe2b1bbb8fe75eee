"""Dense scores on a lexical pool, fusion of both, and reranking of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators.scoring import rank_docs

RRF_K, POOL, ALPHA, BETA, N_DOCS, M_CHUNKS = 60, 1000, 0.7, 0.6, 20, 3


def with_dense(pool: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], question_vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``pool`` with ``dense``, the dot product of question_vectors (qid, qvec) and vectors (chunk_idx, vec); chunks and
    questions without a vector drop out. ``vectors`` may be a function that finds those of the pool's chunks (chunk_idx, doc_id).
    ``dim``: both are cut to that many components and normalised."""
    found = vectors(pool.select("chunk_idx", "doc_id").distinct()) if callable(vectors) else vectors
    joined = pool.join(found, "chunk_idx").join(question_vectors, "qid")
    shorten = (lambda c: V.truncated(c, dim)) if dim else (lambda c: c)
    return joined.withColumn("dense", V.dot(shorten(F.col("vec")), shorten(F.col("qvec")))).drop("vec", "qvec")


def minmax(c: str, over: WindowSpec) -> Column:
    """``c`` from 0 to 1 within the window; all zeros if it hardly varies."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)))


def fuse(pool: DataFrame, fusion: str = "linear", alpha: float = ALPHA, by: list[str] | None = None) -> DataFrame:
    """``pool`` (qid, chunk_idx, score, dense) with ``fused``: ``linear`` mixes min-max values, ``rrf`` reciprocal ranks,
    ``bm25`` and ``dense`` pass one score on."""
    keys = ["qid", *(by or [])]
    per = Window.partitionBy(*keys)
    if fusion == "linear":
        value = alpha * minmax("dense", per) + (1 - alpha) * minmax("score", per)
    elif fusion == "rrf":
        rank = lambda c: F.row_number().over(per.orderBy(F.round(c, 9).desc(), "chunk_idx"))
        value = 1 / (RRF_K + rank("score")) + 1 / (RRF_K + rank("dense"))
    elif fusion in ("bm25", "dense"):
        value = F.col("score" if fusion == "bm25" else "dense")
    else:
        raise ValueError(fusion)
    return pool.withColumn("fused", value)


def ranked_by(pool: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``pool`` with ``column`` as its score and ``rnk`` by it."""
    order = Window.partitionBy("qid", *(by or [])).orderBy(F.round(column, 9).desc(), "chunk_idx")
    return pool.withColumn("rnk", F.row_number().over(order)).drop(*({"score"} - {column})).withColumnRenamed(column, "score")


def hybrid_docs(pool: DataFrame, fusion: str = "linear", alpha: float = ALPHA, agg: str = "top3", k: int = 5) -> DataFrame:
    return rank_docs(ranked_by(fuse(pool, fusion, alpha), "fused"), "max" if agg == "max" else "top3", k)


def rerank_candidates(fused: DataFrame, n_docs: int | None = N_DOCS, m_chunks: int | None = M_CHUNKS) -> DataFrame:
    """Chunks of a fused pool (qid, chunk_idx, doc_id, fused) that a reranker sees: those before the first chunk of document
    ``n_docs + 1``, and of each document the first ``m_chunks``. None: all documents, all chunks of a document."""
    order = Window.partitionBy("qid").orderBy(F.round("fused", 9).desc(), "chunk_idx")
    walked = fused.withColumn("rn", F.row_number().over(order)).withColumn("first_", F.min("rn").over(Window.partitionBy("qid", "doc_id")))
    seen = walked.withColumn("nth_", F.dense_rank().over(Window.partitionBy("qid").orderBy("first_")))
    if n_docs is not None:
        stop = F.min(F.when(F.col("nth_") == n_docs + 1, F.col("rn"))).over(Window.partitionBy("qid"))
        seen = seen.withColumn("stop_", stop).where(F.col("stop_").isNull() | (F.col("rn") < F.col("stop_")))
    kept = seen.withColumn("in_doc", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rn")))
    if m_chunks is not None:
        kept = kept.where(F.col("in_doc") <= m_chunks)
    return kept.drop("first_", "nth_", "stop_")


def rerank_docs(candidates: DataFrame, beta: float = BETA, agg: str = "top3", k: int = 5) -> DataFrame:
    """Documents of ``candidates`` (qid, chunk_idx, doc_id, fused, logit): below 1, ``beta`` mixes the min-max values of
    logit and fused score; 1 takes the logits."""
    per = Window.partitionBy("qid")
    value = beta * minmax("logit", per) + (1 - beta) * minmax("fused", per) if beta < 1 else F.col("logit")
    return rank_docs(ranked_by(candidates.withColumn("blend", value), "blend"), "max" if agg == "max" else "top3", k)
