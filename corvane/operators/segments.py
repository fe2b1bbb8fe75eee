"""An index that grows by segments: each batch of documents writes one, later segments replace documents of earlier ones.

A segment holds the rows of its chunks (terms and counts in the row), tombstones for the documents that it replaces, and
deltas of document frequencies and totals: what it adds, less what its tombstones take away. Merging sums deltas and leaves dead
rows out; no segment is read again to count terms. A segment that is written again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import index

ROWS = "chunk_idx long, doc_id long, doclen int, terms array<struct<term: string, tf: int>>, segment int"
DOCS = "doc_id long, segment int"
DELTAS = "term string, df long, segment int"
TOTALS = "n_chunks long, tokens long, segment int"
_NAMES = {"rows": ROWS, "docs": DOCS, "deltas": DELTAS, "totals": TOTALS}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of all segments; empty before the first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], _NAMES[name])
    return spark.read.schema(_NAMES[name]).parquet(f"{path}/{name}")


def _live(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of documents that no later segment holds."""
    latest = docs.groupBy("doc_id").agg(F.max("segment").alias("latest"))
    return rows.join(latest, "doc_id").where(F.col("segment") == F.col("latest")).drop("latest")


def append(chunks: DataFrame, path: str, segment: int, docs: DataFrame | None = None) -> None:
    """Writes ``chunks`` (chunk_idx, doc_id, text) as segment number ``segment`` of the index at ``path``.

    ``docs`` (doc_id): the documents of the batch, also those that have no chunk any more and only end their older version; by
    default those of the chunks. Segments are numbered in their order; the tables of this and later ones don't count for what
    is replaced, so that a repeated batch gives the same segment. Rows with a null doc_id are left out. An empty batch is a
    segment without rows.
    """
    spark = chunks.sparkSession
    at = lambda name: f"{path}/{name}/segment={segment}"
    index.forward(chunks.where("doc_id is not null")).sortWithinPartitions("chunk_idx").write.mode("overwrite").parquet(at("rows"))
    own = spark.read.parquet(at("rows"))
    named = (docs if docs is not None else own).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    named.write.mode("overwrite").parquet(at("docs"))
    named = spark.read.parquet(at("docs"))
    before = lambda name: _table(spark, path, name).where(F.col("segment") < segment)
    # Partitions of the rows are sorted by chunk: a batch that is broadcast reads little of the others.
    dead = _live(before("rows"), before("docs")).join(named, "doc_id", "left_semi")
    terms = index.listed(own).select("term", F.lit(1).alias("d")).unionByName(index.listed(dead).select("term", F.lit(-1).alias("d")))
    terms.groupBy("term").agg(F.sum("d").cast("long").alias("df")).where("df <> 0").write.mode("overwrite").parquet(at("deltas"))
    sign = own.select("doclen", F.lit(1).alias("d")).unionByName(dead.select("doclen", F.lit(-1).alias("d")))
    sign.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(F.sum(F.col("d") * F.col("doclen")), F.lit(0)).cast("long").alias("tokens")).write.mode("overwrite").parquet(at("totals"))


def merged(spark: SparkSession, path: str, upto: int | None = None) -> index.Index:
    """The index of the documents as the segments up to ``upto`` (all by default) leave them: that of one build over them."""
    read = lambda name: _table(spark, path, name) if upto is None else _table(spark, path, name).where(F.col("segment") <= upto)
    rows = _live(read("rows"), read("docs")).select("chunk_idx", "doc_id", "doclen", "terms")
    df = read("deltas").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    sizes = read("totals").agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), (F.sum("tokens") / F.nullif(F.sum("n_chunks"), F.lit(0))).alias("avgdl"))
    return index.assemble(rows, df, sizes)


def compact(spark: SparkSession, path: str, out: str, upto: int | None = None) -> index.Index:
    """Writes the merged index in buckets below ``out`` and reads it."""
    index.write(merged(spark, path, upto), out)
    return index.read(spark, out)
