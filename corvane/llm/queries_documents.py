"""Queries of the classifiers and media columns: op2 (quality), op3 (telephony), op5 (toxicity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import quality, telephony, toxicity
from corvane.llm.common import table, written


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves ``remainder``: such rows' labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def judged(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_model(featured: DataFrame, labels: DataFrame) -> quality.Discriminant:
    learnt = labels.where(~held_out(3, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    return quality.fit(featured.join(learnt, "doc_id"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits the discriminant to the rows of labels that are not held out and scores every whole text."""
    featured = written(quality.featurise(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]), "quality")
    model = quality_model(featured, table(spark, sf_dir, "labels"))
    return judged(quality.score(featured, model, keep=["doc_id"]), 3, 1)


#: PCM has four bytes for one of a text: it is packed well, in pages that show the packer enough of it.
PCM_STORE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20), "parquet.block.size": str(64 << 20)}


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makes every whole text the codes of a mu-law WAVE file, reads these back and describes their sound; stores the resampled
    PCM of each file as Parquet and describes what is read from there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = telephony.features(telephony.store(docs, keep=["doc_id"]), keep=["doc_id", "n_bytes"], stored="pcm_media")
    kept = written(made, "pcm", **PCM_STORE)
    read = telephony.pcm_features(kept, keep=[c for c in kept.columns if c != "pcm_media"])
    return read.withColumn("feature", F.concat_ws(";", "feature", "pcm_feature")).drop("pcm_feature")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains the dictionaries on a bounded sample of labels that are not held out and scores every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return judged(toxicity.score(docs, model, keep=["doc_id"]), 5, 0)


QUERIES = {"op2_quality": op2_quality, "op3_telephony": op3_telephony, "op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
