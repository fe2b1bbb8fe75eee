"""Documents that arrive as files are chunked and indexed, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import segments
from corvane.operators.chunking import chunk, with_index
from corvane.operators.index import listed


def follow(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str):
    """Starts a query that takes every new Parquet file below ``source`` (doc_id, name, link, passage) once.

    Each batch writes its chunks, its segment of the index at ``out``/index and its term frequencies, all overwritten if the
    batch is repeated after a failure, so that nothing counts twice. A document that comes again replaces its older version in
    ``segments.merged``.
    """

    def take(batch: DataFrame, number: int) -> None:
        at = f"{out}/chunks/batch={number}"
        with_index(chunk(batch)).write.mode("overwrite").parquet(at)
        segments.append(spark.read.parquet(at), f"{out}/index", number, batch.select(F.col("doc_id")))
        listed(spark.read.parquet(f"{out}/index/rows/segment={number}")).select("chunk_idx", "term", "tf").write.mode("overwrite").parquet(f"{out}/frequencies/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
