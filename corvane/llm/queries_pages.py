"""Query of the WARC derivatives: op6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import warc
from corvane.llm.common import table


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wraps every page in a response record and derives its metadata and conversion records: one row for each."""
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")), keep=["page_id"])
    return warc.flat(made).select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "block_bytes", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


QUERIES = {"op6_warc": op6_warc}
ORACLES: dict[str, str] = {}
