"""The index as tables without parameters: rows of chunks with their terms, vocabulary, postings, blocks, corpus statistics.

Terms are counted inside a chunk's row. Written rows are what everything else is counted from, without a look at the texts, and
what searches read; only the inverted form shuffles a row for each term of a chunk, once, to the place where it stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

MIN_DF, MAX_DF_RATIO, MOST_TF = 2, 0.7, 65535
#: Chunks whose lengths agree up to so many tokens form a block of each of their terms.
BLOCK_LENGTHS = 32
#: Postings of a bucket of the written index at least, and of one part of a term that has more.
BUCKET_ROWS, PART_ROWS = 1 << 22, 1 << 21
#: Documents in a row whose postings of a parted term stay together.
PART_DOCS = 4096

#: Chunks of a step in a task that counts terms.
STEP = 2000

#: What a written index depends on besides its chunks.
OPTIONS = {"version": 4, "min_df": MIN_DF, "max_df_ratio": MAX_DF_RATIO, "block_lengths": BLOCK_LENGTHS}

#: Tables of a written index; an empty one has no file to take its columns from.
_TABLES = {
    "postings": "term string, chunk_idx long, doc_id long, doclen int, tf int, bucket int", "vocab": "term string, df long, idf double", "blocks": "term string, block int, most_tf int, least_len int, n long",
    "rows": "chunk_idx long, doc_id long, doclen int, terms string, tfs array<int>", "corpus_stats": "n_chunks long, avgdl double, nnz long, vocab_size long",
}


@dataclass
class Index:
    """postings(term, chunk_idx, doc_id, doclen, tf, bucket), vocab(term, df, idf), blocks(term, block, most_tf, least_len, n),
    rows(chunk_idx, doc_id, doclen, terms), corpus_stats(n_chunks, avgdl, nnz, vocab_size): lazy, or read from a written index.

    ``buckets``: how many the postings' folders are; 0 if they are not in folders. ``stored``: the rows as they are written, see ``packed``.
    """

    postings: DataFrame
    vocab: DataFrame
    blocks: DataFrame
    rows: DataFrame
    corpus_stats: DataFrame
    buckets: int = 0
    stored: DataFrame | None = None

    @property
    def packed(self) -> DataFrame:
        return self.stored if self.stored is not None else packed_rows(self.rows)

    @property
    def chunk_stats(self) -> DataFrame:
        return (self.rows if self.stored is None else self.stored).select("chunk_idx", "doc_id", "doclen")

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """The postings in the buckets of ``terms`` (term): other folders are not read. At most every bucket's number goes to
        the driver."""
        if not self.buckets:
            return self.postings
        used = [r[0] for r in terms.select(bucket("term", self.buckets).alias("b")).distinct().collect()]
        return self.postings.where(F.col("bucket").isin(used))


def bucket(term: str, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def block(doclen: str) -> Column:
    return F.floor(F.col(doclen) / BLOCK_LENGTHS).cast("int")


#: By session's application: the code points from 128 on of which tokens are made, as runs [first, last).
_LETTERS: dict[str, np.ndarray] = {}


def _letters(spark: SparkSession) -> np.ndarray:
    """Those runs as the pattern of tokens has them: Spark is asked once for every code point."""
    key = spark.sparkContext.applicationId
    if key not in _LETTERS:
        every = spark.range(128, 0x110000, 1, 8).where("id < 55296 or id > 57343")
        sign = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = np.sort(every.where(sign.rlike(T.TOKEN)).select("id").toArrow()["id"].to_numpy())
        first = np.flatnonzero(np.diff(found, prepend=-1) != 1)
        _LETTERS[key] = np.stack([found[first], found[np.append(first[1:], len(found)) - 1] + 1], axis=1)
    return _LETTERS[key]


def _tokens(texts: pa.Array, is_token: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of ``texts`` (in lower case) one behind the other, and of each the number of its text."""
    listed = [x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]
    codes = np.frombuffer("".join([x + "\0" for x in listed]).encode("utf-32-le"), dtype=np.uint32)
    inside = is_token[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begins, ends = edges[::2], edges[1::2]
    kept = codes[inside]
    width = 1 + (kept >= 0x80).astype(np.int8) + (kept >= 0x800) + (kept >= 0x10000)
    lengths = np.add.reduceat(width, np.cumsum(ends - begins) - (ends - begins), dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    data = kept.astype(np.uint8).tobytes() if not (kept >= 0x80).any() else kept.tobytes().decode("utf-32-le").encode()
    sizes = np.array([len(x) for x in listed], dtype=np.int64)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(np.cumsum(sizes + 1), begins, side="right")


def _joined(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """For each of ``counts`` the next so many ``values`` with a blank between them."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), " ")


def packed(chunks: DataFrame) -> DataFrame:
    """(chunk_idx, doc_id, doclen, terms, tfs) of each of ``chunks`` (chunk_idx, doc_id, text): its terms in order with a blank
    between them, as no token holds one, and their frequencies. Rows so written are read as one string and one array of numbers."""
    runs = _letters(chunks.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_token = np.zeros(0x110000, dtype=bool)
        for sign in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
            is_token[sign] = True
        for first, end in runs:
            is_token[first:end] = True
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                found, row = _tokens(part.column("text"), is_token)
                coded = found.dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                keys, tf = np.unique(row * len(order) + place[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
                of, term = keys // max(len(order), 1), keys % max(len(order), 1)
                counts = np.bincount(of, minlength=part.num_rows)
                terms = _joined(coded.dictionary.take(pa.array(order)).take(pa.array(term)), counts)
                tfs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.minimum(tf, MOST_TF).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("chunk_idx"), part.column("doc_id"), pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int32)), terms, tfs], ["chunk_idx", "doc_id", "doclen", "terms", "tfs"])

    lowered = chunks.select(F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("doc_id").cast("long").alias("doc_id"), F.lower(T.text_of("text")).alias("text"))
    return lowered.mapInArrow(count, _TABLES["rows"])


def packed_rows(rows: DataFrame) -> DataFrame:
    """The rows of ``forward`` in the form of ``packed``."""
    return rows.select("chunk_idx", "doc_id", "doclen", F.array_join(F.col("terms.term"), " ").alias("terms"), F.col("terms.tf").alias("tfs"))


def unpacked(rows: DataFrame) -> DataFrame:
    """The rows of ``packed`` in the form of ``forward``."""
    kind = "array<struct<term: string, tf: int>>"
    terms = F.when(F.col("terms") == "", F.array().cast(kind)).otherwise(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf")).cast(kind))
    return rows.select("chunk_idx", "doc_id", "doclen", terms.alias("terms"))


def forward(chunks: DataFrame) -> DataFrame:
    """(chunk_idx, doc_id, doclen, terms: array of (term, tf) in order of terms) of each of ``chunks`` (chunk_idx, doc_id, text)."""
    return unpacked(packed(chunks))


def packed_frequencies(rows: DataFrame) -> DataFrame:
    """(term, df) of the rows of ``packed``: a task counts the terms of its batches, of which only sums are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = pc.split_pattern(batch.column("terms"), " ").flatten().dictionary_encode()
            counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(counts)], ["term", "n"])

    return rows.select("terms").where("terms <> ''").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def listed(rows: DataFrame) -> DataFrame:
    """(term, chunk_idx, doc_id, doclen, tf) of the rows of ``forward``: all terms, before pruning."""
    # The outer form: for the other one Spark infers a filter on the array, which would repeat the whole count below it.
    each = rows.select("chunk_idx", "doc_id", "doclen", F.inline_outer("terms"))
    return each.where("term is not null").select("term", "chunk_idx", "doc_id", "doclen", "tf")


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """(chunk_idx, term, tf) of all terms, before pruning."""
    return listed(forward(chunks)).select("chunk_idx", "term", "tf")


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(df: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """Terms of two chunks to seven tenths of all, with their idf. ``n_chunks`` is a table of one row."""
    counted = df.crossJoin(F.broadcast(n_chunks.select("n_chunks")))
    kept = counted.where(F.col("df").between(MIN_DF, F.floor(F.col("n_chunks") * F.lit(MAX_DF_RATIO))))
    return kept.select("term", "df", F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def block_bounds(postings: DataFrame) -> DataFrame:
    """Of each term and block the greatest tf, the least length and the number of postings: what a score can reach there,
    whatever the parameters."""
    return postings.groupBy("term", block("doclen").alias("block")).agg(F.max("tf").alias("most_tf"), F.min("doclen").alias("least_len"), F.count(F.lit(1)).alias("n"))


def assemble(rows: DataFrame, df: DataFrame, sizes: DataFrame) -> Index:
    """The index of the rows of ``forward``, their document frequencies (term, df) and their totals (n_chunks, avgdl)."""
    vocab = vocabulary(df, sizes)
    totals = sizes.crossJoin(vocab.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("nnz"), F.count(F.lit(1)).alias("vocab_size")))
    return _inverted(rows, vocab, totals)


def _inverted(rows: DataFrame, vocab: DataFrame, totals: DataFrame) -> Index:
    postings = listed(rows).join(vocab.select("term"), "term", "left_semi").select("term", "chunk_idx", "doc_id", "doclen", "tf", F.lit(0).alias("bucket"))
    return Index(postings, vocab, block_bounds(postings), rows, totals)


def build(chunks: DataFrame) -> Index:
    """The index over ``chunks`` (chunk_idx, doc_id, text)."""
    return counted(forward(chunks))


def counted(rows: DataFrame) -> Index:
    """The index of the rows of ``forward``, whose terms it counts."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("doclen").alias("avgdl"))
    return assemble(rows, document_frequencies(listed(rows)), sizes)


def pruning_counts(df: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """One row: terms kept, dropped as rare, dropped as common."""
    counted = df.crossJoin(F.broadcast(n_chunks.select("n_chunks")))
    most = F.floor(F.col("n_chunks") * F.lit(MAX_DF_RATIO))
    return counted.agg(F.count_if(F.col("df").between(MIN_DF, most)).alias("kept"), F.count_if(F.col("df") < MIN_DF).alias("rare"), F.count_if(F.col("df") > most).alias("common"))


def dealt(index: Index, buckets: int, part_rows: int = PART_ROWS) -> DataFrame:
    """The postings by bucket of their term, a term of more than ``part_rows`` postings in parts of neighbouring documents: a
    task gets a bucket's common run of terms, or parts, never a whole hot term."""
    parts = index.vocab.select("term", F.ceil(F.col("df") / part_rows).alias("parts")).where("parts > 1")
    spread = index.postings.join(parts, "term", "left").withColumn("bucket", bucket("term", buckets))
    part = F.coalesce(F.pmod(F.floor(F.col("doc_id") / PART_DOCS), F.col("parts")), F.lit(-1))
    return spread.withColumn("part", part).withColumn("hot", F.when(F.col("parts").isNotNull(), F.col("term"))).repartition("bucket", "hot", "part").sortWithinPartitions("bucket", "term", "chunk_idx").drop("part", "parts", "hot")


def _stored(spark, path: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{path}/{name}")


def write_rows(rows: DataFrame, path: str) -> None:
    """The rows of ``packed`` below ``path``, in one pass over the texts."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")


def write_terms(spark, path: str) -> None:
    """Vocabulary and corpus statistics of the rows below ``path``."""
    rows = _stored(spark, path, "rows")
    sizes = rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("doclen").alias("avgdl"))
    vocabulary(packed_frequencies(rows), sizes).write.mode("overwrite").parquet(f"{path}/vocab")
    totals = _stored(spark, path, "vocab").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("nnz"), F.count(F.lit(1)).alias("vocab_size"))
    sizes.crossJoin(totals).write.mode("overwrite").parquet(f"{path}/corpus_stats")


def write_postings(index: Index, path: str, buckets: int | None = None, part_rows: int = PART_ROWS) -> None:
    """The postings of a written index below ``path``, in a folder a bucket, sorted by term in each file, so that readers prune
    folders and row groups; and their blocks. ``buckets``: from the number of postings by default."""
    spark = index.postings.sparkSession
    if buckets is None:
        buckets = max(8, -(-index.corpus_stats.first()["nnz"] // BUCKET_ROWS))
    dealt(index, buckets, part_rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    block_bounds(_stored(spark, path, "postings")).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def write(index: Index, path: str, buckets: int | None = None, part_rows: int = PART_ROWS) -> None:
    """All tables below ``path``, counted from the rows that it writes first."""
    spark = index.rows.sparkSession
    write_rows(index.packed, path)
    write_terms(spark, path)
    write_postings(read_terms(spark, path), path, buckets, part_rows)


def read_terms(spark, path: str) -> Index:
    """The written index without its postings, which are lazy."""
    rows, vocab, totals = [_stored(spark, path, name) for name in ("rows", "vocab", "corpus_stats")]
    return replace(_inverted(unpacked(rows), vocab, totals), stored=rows)


def read(spark, path: str, postings: str | None = None) -> Index:
    """A written index; ``postings``: the folder of its postings, if that is another one."""
    at, found = postings or path, read_terms(spark, path)
    return Index(_stored(spark, at, "postings"), found.vocab, _stored(spark, at, "blocks"), found.rows, found.corpus_stats, spark.read.parquet(f"{at}/layout").first()["buckets"], found.stored)
