"""A corpus pipeline: toxic and poor documents go, one of each group of near copies stays, sources are mixed, texts encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and reads it again as
the next one's ``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, mixing, ngram_join, quality, toxicity
from corvane.llm.common import fresh_path, table, unused, written
from corvane.llm.queries_documents import held_out, quality_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the compression distance finds toxic. Labels of held-out rows are not learnt from.

    Null and empty texts have no toxic window and stay; rows that repeat stay or go together; columns are unchanged, whatever
    their names; an empty table stays empty, and without labels nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    score = unused(docs, "score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).drop(score)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the discriminant finds poor. Labels of held-out rows are not learnt from.

    Null counts as an empty text, which goes if the labelled rows make it poor; rows that repeat stay or go together; columns
    are unchanged, whatever their names; an empty table stays empty, and without labels nothing goes. The statistics of a
    text are taken once.
    """
    features = unused(docs, "features")
    featured = written(quality.featurise(docs, out=features), "featured")
    model = quality_model(featured.select("doc_id", F.col(features).alias("features")), table(spark, sf_dir, "labels"))
    score = unused(featured, "score")
    return quality.score(featured, model, features=features, out=score).where(F.col(score) >= 0.5).drop(score, features)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, a similarity of 0.8 or more; see
    ``ngram_join.one_of_each`` for nulls, repeated rows, the empty table and names of columns."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources to weights 1, 2, 3 takes it; see ``mixing.apply_mix`` for nulls, repeated
    rows, the empty table and names of columns."""
    return mixing.apply_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids (little-endian u32 bytes) of every row: null and empty texts have none. Other
    columns are not returned."""
    coded = byte_bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packed=True, keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near copies", drop_near_copies), ("mixing", mix_sources), ("encoding", encode_texts)]

#: Training of dictionaries and the iterations of the other stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
