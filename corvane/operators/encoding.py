"""Models over texts and pairs of texts: encoders and rerankers plug in as functions of lists.

Rows are taken in super-batches across Arrow batches and ordered by their number of tokens, so that a model's batches hold texts
of about one length; a task holds one super-batch. Texts are cut to what a model reads, and their lengths are told.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions import vectors as V

MOST_TOKENS, BATCH, SUPER_BATCH = 512, 64, 4096
_TOKEN = re.compile(r"\w+")


def cut(text: str, most: float) -> tuple[str, int]:
    """The text up to the end of its token number ``most``, and how many tokens the whole has. A model with a tokenizer of its
    own brings its own ``cut``."""
    n, end = 0, 0
    for found in _TOKEN.finditer(text):
        n += 1
        if n <= most:
            end = found.end()
    return (text if n <= most else text[:end]), n


def with_model(df: DataFrame, prepare: Callable[[pd.DataFrame], tuple[list, list[int]]], call: Callable[[list], list], added: str, batch: int = BATCH, super_batch: int = SUPER_BATCH) -> DataFrame:
    """``df`` with the columns of DDL ``added``: the first from ``call``, which gets lists of ``batch`` inputs, then ``n_tokens``.

    ``prepare`` gives a frame's inputs and their numbers of tokens. Input columns named like an added one give way.
    """
    extra = df.sparkSession.createDataFrame([], added).schema
    out = extra[0].name
    kept = df.drop(*extra.names)
    schema = StructType([*kept.schema.fields, *extra.fields])

    def answered(frames: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(frames, ignore_index=True)
        inputs, sizes = prepare(whole)
        order = np.argsort(-np.array(sizes, np.int64), kind="stable").tolist()
        got: list = [None] * len(inputs)
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            for j, value in zip(part, call([inputs[j] for j in part]), strict=True):
                got[j] = value
        whole[out], whole["n_tokens"] = got, sizes
        return whole

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            for i in range(0, len(frame), super_batch):
                part = frame.iloc[i : i + super_batch]
                if n and n + len(part) > super_batch:
                    yield answered(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            yield answered(held)

    return kept.mapInPandas(run, schema)


def encode(df: DataFrame, call: Callable[[list[str]], list], text: str = "text", out: str = "vec", dim: int | None = None, most: int = MOST_TOKENS, cut: Callable[[str, int], tuple[str, int]] = cut, **sizes: int) -> DataFrame:
    """``df`` with ``out``, the vector that ``call`` gives for each text cut to ``most`` tokens, ``n_tokens`` of the whole text
    and whether it was ``truncated``. ``dim`` keeps so many components, normalised. Null counts as an empty text."""

    def prepare(frame: pd.DataFrame) -> tuple[list, list[int]]:
        pairs = [cut(x or "", most) for x in frame[text].where(frame[text].notna(), None)]
        return [t for t, _ in pairs], [n for _, n in pairs]

    coded = with_model(df, prepare, call, f"`{out}` array<float>, n_tokens int", **sizes).withColumn("truncated", F.col("n_tokens") > most)
    return coded.withColumn(out, F.transform(V.truncated(F.col(out), dim), lambda x: x.cast("float"))) if dim else coded


def score_pairs(df: DataFrame, call: Callable[[list[tuple[str, str]]], list], question: str = "question", text: str = "text", out: str = "logit", most: float = MOST_TOKENS, cut: Callable[[str, float], tuple[str, int]] = cut, **sizes: int) -> DataFrame:
    """``df`` with ``out``, what ``call`` gives for each pair of a question and a text, and the pair's ``n_tokens``.

    A question is cut to ``most`` tokens, its text to what these leave; ``math.inf`` cuts nothing. Pairs are ordered by their
    joint length. Nulls count as empty texts."""

    def prepare(frame: pd.DataFrame) -> tuple[list, list[int]]:
        pairs, lengths = [], []
        for q, t in zip(frame[question], frame[text], strict=True):
            first, n = cut(q if isinstance(q, str) else "", most)
            second, m = cut(t if isinstance(t, str) else "", max(0, most - n))
            pairs.append((first, second))
            lengths.append(n + m)
        return pairs, lengths

    return with_model(df, prepare, call, f"`{out}` double, n_tokens int", **sizes)


def length_statistics(encoded: DataFrame) -> DataFrame:
    """One row: n_texts, median, p90, p99 and longest of ``n_tokens``, and the share of texts that were cut."""
    p = lambda q: F.percentile("n_tokens", F.lit(q))
    return encoded.agg(F.count(F.lit(1)).alias("n_texts"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("n_tokens").cast("long").alias("longest"), F.avg(F.col("truncated").cast("double")).alias("truncated"))


def build_vectors(chunks: DataFrame, path: str, coded: Callable[[DataFrame], DataFrame], part_rows: int = 100_000) -> DataFrame:
    """(chunk_idx, vec, n_tokens, truncated) of all ``chunks`` below ``path``; ``coded`` is ``encode`` with its model.

    Chunks that the folder has are not encoded again. The others are dealt into parts by a hash of their number, each written
    whole or not at all, sorted by chunk, so that gathering a pool prunes row groups."""
    spark = chunks.sparkSession
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(top)
    ddl = "chunk_idx long, vec array<float>, n_tokens int, truncated boolean, part int"
    held = spark.read.schema(ddl).parquet(path) if there else spark.createDataFrame([], ddl)
    left, last = chunks.join(held.select("chunk_idx"), "chunk_idx", "left_anti"), held.agg(F.max("part")).first()[0]
    n, first = -(-left.count() // part_rows), 0 if last is None else last + 1
    for part in range(n):
        rows = coded(left.where(F.pmod(F.xxhash64("chunk_idx"), F.lit(n)) == part).select("chunk_idx", "text"))
        rows.select("chunk_idx", "vec", "n_tokens", "truncated").repartitionByRange("chunk_idx").sortWithinPartitions("chunk_idx").write.mode("overwrite").parquet(f"{path}/part={first + part}")
    return spark.read.schema(ddl).parquet(path).drop("part") if n or there else held.drop("part")


def hashed_encoder(dim: int) -> Callable[[list[str]], list]:
    """An encoder without a model: tokens add or take one at a component that their hash names; normalised."""

    def call(texts: list[str]) -> list:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for token in _TOKEN.findall(text.lower()):
                h = zlib.crc32(token.encode())
                out[i, h % dim] += 1 if h & 1 << 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return list(out / np.where(size > 0, size, 1))

    return call


def overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """A reranker without a model: the share of a question's different tokens that the text has."""
    out = []
    for question, text in pairs:
        asked = set(_TOKEN.findall(question.lower()))
        out.append(len(asked & set(_TOKEN.findall(text.lower()))) / len(asked) if asked else 0.0)
    return out
