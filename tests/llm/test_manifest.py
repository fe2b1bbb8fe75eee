"""The manifest against trees in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle
from corvane.llm import queries_manifest as Q
from tests.llm.sql import compare


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def walk(tree, pos, start):
    """Siblings of a leaf and where ``start`` leads to in its place."""
    proof = []
    for level in tree[:-1]:
        run = level[pos // 2 * 2 : pos // 2 * 2 + 2]
        here = pos % 2
        proof += run[1 - here : 2 - here] if len(run) == 2 else []
        start = sha((run[0] + start) if here else start + "".join(run[1:]))
        pos //= 2
    return proof, start


@pytest.fixture
def small_bands(monkeypatch):
    monkeypatch.setattr(merkle, "BAND", 2)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, "b": 1}, {None: 5, "": 1, "é": 17, "z": 4, "\U0001f600": 33, "￿": 3}, {f"g{i:02}": i + 1 for i in range(19)}])
def test_against_plain_trees(spark, small_bands, sizes):
    rnd = random.Random(len(sizes))
    rows = [(lang, None if i == 3 else i // 2, sha(f"{lang} {i}"), "x") for lang, n in sizes.items() for i in range(n)]
    rnd.shuffle(rows)
    found = merkle.manifest(spark.createDataFrame(rows, "lang string, doc_id long, leaf string, size string"), "lang", "doc_id")
    got = {r["leaf"]: r for r in found.withColumn("folded", merkle.folded(F.col("path"), F.lit("0" * 64))).withColumn("proof", merkle.siblings(F.col("path"))).collect()}
    assert len(got) == len(rows)
    order = sorted(sizes, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: sorted((r for r in rows if r[0] == lang), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for lang in order}
    trees = {lang: levels([r[2] for r in own[lang]]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    for k, lang in enumerate(order):
        for pos, r in enumerate(own[lang]):
            proof, start = walk(trees[lang], pos, "0" * 64)
            more, start = walk(top, k, start)
            row = got[r[2]]
            assert (row["subroot"], row["root"], row["proof"], row["folded"]) == (trees[lang][-1][0], top[-1][0], "".join(proof + more), start)


def test_leaves_tell_nulls_from_empty_texts(spark):
    row = spark.sql("SELECT CAST(NULL AS BIGINT) AS a, '' AS b, 12 AS c, 'é:1' AS d")
    assert row.select(merkle.leaf(*[F.col(c) for c in "abcd"])).first()[0] == sha("-0:2:124:é:1")


def test_equal_rows_and_extra_columns(spark, tmp_path):
    rows = [(1, "a", "en", 3, "abc", "x"), (1, "a", "en", 3, "abc", "x"), (None, None, None, None, None, None), (2, "b", "en", None, "", "y"), (7, "b", "", 9, "w " * 100_000, "y")]
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree_no string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op11_merkle(spark, str(tmp_path)).collect()
    assert len(got) == 5 and len({r["root"] for r in got}) == 1 and len({r["leaf"] for r in got}) == 4
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and any(r["verified"] for r in got)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert Q.op11_merkle(spark, str(tmp_path / "none")).count() == 0


def test_store_is_partitioned_by_level_and_pruned(spark, small_bands, tmp_path):
    leaves = spark.range(37).select(F.lit(0).cast("long").alias("tree_no"), F.col("id").alias("pos"), F.lit(37).cast("long").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    forest = merkle.build(leaves, str(tmp_path / "store"))
    tree = levels([sha(str(i)) for i in range(37)])
    stored = {(r["level"], r["pos"]): r["hash"] for r in spark.read.parquet(forest.path).collect()}
    assert stored == {(i, p): h for i, level in enumerate(tree) for p, h in enumerate(level)}
    assert "PartitionFilters" in forest.nodes(spark, 2, 4)._jdf.queryExecution().toString()
    asked = spark.createDataFrame([(0, 36), (0, 5)], "tree_no long, pos long")
    got = {r["pos"]: r["path"] for r in merkle.paths(forest, asked).collect()}
    assert all("".join(s[1:] for s in got[p]) == "".join(walk(tree, p, "")[0]) and len(got[p]) == len(tree) - 1 for p in (36, 5))


def test_op11(spark):
    compare(spark, Q, "op11_merkle")
