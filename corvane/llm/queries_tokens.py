"""Queries of the token operators: op1 (byte-level BPE), op4 (Simple-8b shards), op10 (edit-aware counts)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, edit_counts, simple8b
from corvane.llm.common import table, written


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns digests of both."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, ranks, pattern, packed=True, keep=["doc_id"])
    decoded = byte_bpe.decode(coded, ranks)
    return decoded.select("doc_id", F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every text's ids to Simple-8b shards in ascending doc_id order and reads them back."""
    docs = table(spark, sf_dir, "documents")
    read = simple8b.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every text's tokens, applies three derived edits, stores the edited texts with their trees, and applies three
    edits derived from these to the trees that are read back. Counts of the second batch are named ``again_…``."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = ["n_tokens", "edited_n_tokens", "edited_n_chars", "n_edits", "reencoded_chars"]
    kept = written(edit_counts.apply_edits(edit_counts.derived_edits(docs), ranks, pattern, keep=["doc_id"]), "trees", compression="zstd")
    kept = kept.select("doc_id", "text", *edit_counts.TREE, F.struct(*first).alias("first"))
    again = edit_counts.count_edits(edit_counts.derived_edits(kept), ranks, pattern, keep=["doc_id", "first"])
    second = {"again_n_tokens": "edited_n_tokens", "again_n_chars": "edited_n_chars", "again_reencoded_chars": "reencoded_chars", "again_split_chars": "split_chars"}
    return again.select("doc_id", "first.*", *[F.col(c).alias(n) for n, c in second.items()])


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op4_simple8b": op4_simple8b, "op10_edit_counts": op10_edit_counts}
ORACLES: dict[str, str] = {}
