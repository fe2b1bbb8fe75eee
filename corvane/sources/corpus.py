"""Readers with explicit schemas, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id long, name string, link string, passage string"
CHUNK = "doc_id string, chunk_id string, tier int, path string, n_words int, text string"
QUESTION = "map<string, struct<question: string, answer: array<string>>>"
EXPANSION = "map<string, struct<question: string, normalized_query: string, expansion_terms: array<string>, source: string>>"
FILES = "context_*.json"


def documents(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """(doc_id, name, link, passage) of the JSON files below ``folder``, at any depth; doc_id is of the file's name.

    ``limit`` takes the first files by name, 0 all.
    """
    read = spark.read.schema(DOCUMENT).option("multiLine", True).option("pathGlobFilter", FILES).option("recursiveFileLookup", True).json(folder)
    named = read.select(F.regexp_extract(F.col("_metadata.file_name"), r"\Acontext_(.*)\.json\z", 1).alias("doc_id"), "name", "link", "passage")
    return named.orderBy("doc_id").limit(limit) if limit else named


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the corpus from its files' names; no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILES).option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", r"context_([^/]*)\.json\z", 1).alias("doc_id")).distinct()


def document(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def write_chunks(rows: DataFrame, path: str, form: str = "parquet") -> None:
    rows.write.mode("overwrite").format(form).save(path)


def _keyed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json(F.regexp_replace("value", "\\A﻿", ""), ddl)).alias("qid", "v")).select("qid", "v.*")


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """questions(qid, question) and gold(qid, doc_id, pos) of a JSON object by question; null answers give no gold."""
    rows = _keyed(spark, path, QUESTION)
    return rows.select("qid", "question"), rows.select("qid", F.posexplode("answer").alias("pos", "doc_id"))


def expansions(spark: SparkSession, path: str | None) -> DataFrame:
    """The cached expansions; none without a path."""
    if path is None:
        return spark.createDataFrame([], "qid string, question string, normalized_query string, expansion_terms array<string>, source string")
    return _keyed(spark, path, EXPANSION)


def write_expansions(rows: DataFrame, path: str) -> None:
    """One JSON object by question, as ``expansions`` reads it: for caches that fit into one file. Larger ones stay batches."""
    value = F.struct(*[F.col(c) for c in ("question", "normalized_query", "expansion_terms", "source")])
    entries = rows.select(F.col("qid").cast("string").alias("qid"), value.alias("v")).groupBy("qid").agg(F.min("v").alias("v"))
    text = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qid", "v")))), {"ignoreNullFields": "false"})
    entries.agg(text.alias("value")).write.mode("overwrite").text(path)


CACHED = "qid string, question string, normalized_query string, expansion_terms array<string>, source string, batch int"


def append_expansions(rows: DataFrame, path: str, batch: int | Column) -> None:
    """Writes ``rows`` (qid, question, normalized_query, expansion_terms, source) as batch number ``batch`` of the cache at
    ``path``. A batch that is written again replaces itself; one that was interrupted has no file that counts. A column deals
    the rows into the batches of its numbers, all in one job."""
    named = rows.select(F.col("qid").cast("string").alias("qid"), "question", "normalized_query", "expansion_terms", "source")
    if isinstance(batch, Column):
        named.withColumn("batch", batch.cast("int")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    else:
        named.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def cached_expansions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, normalized_query, expansion_terms, source, batch) of the cache that ``append_expansions`` writes, each
    question once: that of the first batch that has it. Empty where there is no cache yet."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(top):
        return spark.createDataFrame([], CACHED)
    columns = [c.split()[0] for c in CACHED.split(", ")]
    found = spark.read.schema(CACHED).parquet(path).groupBy("qid").agg(F.min(F.struct("batch", *columns[1:-1])).alias("v"))
    return found.select("qid", *[F.col(f"v.{c}").alias(c) for c in columns[1:]])


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("chunk_idx", "vec")


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vectors sorted by chunk in ranges, so that gathering a pool prunes row groups."""
    rows.repartitionByRange("chunk_idx").sortWithinPartitions("chunk_idx").write.mode("overwrite").parquet(path)
