"""Query of the Merkle manifest: op11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import merkle
from corvane.llm.common import table


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each language over all documents, a tree over these; every document's proof, and the root that follows from
    it with a leaf that is tampered with for a seventh of all ids."""
    docs = table(spark, sf_dir, "documents")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    forged = merkle.leaf(doc_id, source, lang, n_chars.cast("decimal(20,0)") + 1, text)
    leaves = docs.select("doc_id", "lang", merkle.leaf(doc_id, source, lang, n_chars, text).alias("leaf"), F.when(chosen & n_chars.isNotNull(), forged).alias("forged"))
    found = merkle.manifest(leaves, "lang", "doc_id").withColumn("folded_root", merkle.folded(F.col("path"), F.coalesce("forged", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL spells out: enough for 2^20 rows of a language.
_LEVELS = 20


def _tree(name: str, levels: int) -> str:
    """Levels ``name``0 to ``name``<levels> of (g, pos, h, n), and the walk ``name``_p0 to ... of (k, g, pos, n, proof, acc)."""
    parts = []
    for i in range(levels):
        parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT g, pos // 2 AS pos, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, (n + 1) // 2 AS n FROM {name}{i} GROUP BY g, pos // 2, n)")
        parts.append(
            f"{name}_p{i + 1} AS MATERIALIZED (SELECT k, p.g, p.pos // 2 AS pos, (p.n + 1) // 2 AS n, proof || coalesce(s.h, '') AS proof, CASE WHEN p.n = 1 THEN acc WHEN p.pos % 2 = 1 THEN sha256(s.h || acc) ELSE sha256(acc || coalesce(s.h, '')) END AS acc"
            f" FROM {name}_p{i} p LEFT JOIN {name}{i} s ON s.g = p.g AND s.pos = xor(p.pos, 1))"
        )
    return ", ".join(parts)


def _leaf(n_chars: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", n_chars, "text"))


QUERIES = {"op11_merkle": op11_merkle}
#: DuckDB has no CRC: the remainder by 7 comes from a table of bytes, spelt out by the polynomial's rule.
_CRC = """crc_table AS MATERIALIZED (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) t(i)),
crc_of AS (SELECT list(c ORDER BY i) AS t FROM crc_table)"""
ORACLES = {
    "op11_merkle": f"""WITH {_CRC},
rows_ AS MATERIALIZED (SELECT doc_id, lang, sha256({_leaf("n_chars")}) AS leaf, CASE WHEN n_chars IS NOT NULL AND
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 7 = 0 THEN sha256({_leaf("(n_chars + 1)")}) END AS forged FROM documents, crc_of),
g0 AS MATERIALIZED (SELECT *, row_number() OVER () AS k, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows_),
a0 AS MATERIALIZED (SELECT g, pos, leaf AS h, n FROM g0), a_p0 AS MATERIALIZED (SELECT k, g, pos, n, '' AS proof, coalesce(forged, leaf) AS acc FROM g0), {_tree("a", _LEVELS)},
b0 AS MATERIALIZED (SELECT 1 AS g, g - 1 AS pos, h, (SELECT count(*) FROM a{_LEVELS}) AS n FROM a{_LEVELS}),
b_p0 AS MATERIALIZED (SELECT k, 1 AS g, p.g - 1 AS pos, (SELECT count(*) FROM b0) AS n, proof, acc FROM a_p{_LEVELS} p), {_tree("b", 8)}
SELECT doc_id, leaf, a{_LEVELS}.h AS subroot, b8.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = b8.h AS verified FROM g0 JOIN b_p8 USING (k) JOIN a{_LEVELS} ON a{_LEVELS}.g = g0.g, b8""",
}
