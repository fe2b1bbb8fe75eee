"""A Merkle manifest of a dataset: binary trees over sorted leaves, one for each group, and a tree over their roots.

Leaves are sorted into runs once and numbered by coordinates (tree_no, pos). Nodes live in a Parquet store partitioned by level.
A band of levels is one pass: whole chunks of 2^BAND neighbouring nodes of its lowest level, read from the store, stream through
a task that folds them level by level. Proofs come from a merge scan from the top band down: nodes, requested coordinates and
the paths above meet by chunk, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import fresh_path, map_arrow, runs, written

#: Levels of a band: a chunk has 2^BAND nodes of the band's lowest level.
BAND = 10
NODE = "tree_no long, pos long, size long, hash string, level int"


def encoded(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*columns: Column) -> Column:
    """The digest of a row: lowercase hex SHA-256 of its columns, each ``encoded``."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ranked(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """``df`` with its place from 0 in ``order`` (nulls first, strings by bytes), written to the shared folder in sorted runs.

    A run's offset is the sum of the runs before it; there are as many runs as partitions. ``order`` should tell all rows
    apart that differ.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # partition << 33 | row
    sorted_ = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at_", at), "runs")
    run = F.shiftright("at_", 33)
    sizes = sorted_.groupBy(run.alias("run_")).agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("run_", before.alias("before_"))
    placed = sorted_.withColumn("run_", run).join(F.broadcast(offsets), "run_")  # a row for each partition at most
    return placed.withColumn(rank, F.col("before_") + F.col("at_") - F.shiftleft("run_", 33)).drop("run_", "before_", "at_")


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))


@dataclass
class Forest:
    """Trees whose nodes are below ``path``. ``trees``: (tree_no, size, top), top being what remains of the tree."""

    path: str
    highest: int
    trees: DataFrame

    def nodes(self, spark: SparkSession, low: int, high: int) -> DataFrame:
        """Nodes of the levels from ``low`` to below ``high``; other partitions are not read."""
        return spark.read.schema(NODE).parquet(self.path).where((F.col("level") >= low) & (F.col("level") < high))


def _band(nodes: DataFrame, low: int) -> DataFrame:
    """Nodes of the levels ``low`` + 1 to ``low`` + BAND over the nodes of level ``low``; those of level 0 as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in runs(batches, ["tree_no", "chunk"]):
            tree, pos, size = (table[c].to_numpy() for c in ("tree_no", "pos", "size"))
            hashes, level = table["hash"].to_pylist(), low
            if not low:
                yield _rows(tree, pos, size, hashes, 0)
            while level < low + BAND and (size > 1).any():
                kept = np.flatnonzero(size > 1)
                tree, pos, size, hashes = tree[kept], pos[kept] >> 1, (size[kept] + 1) // 2, [hashes[i] for i in kept.tolist()]
                first = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (pos[1:] != pos[:-1])))
                ends = [*first[1:].tolist(), len(hashes)]
                hashes = [digest("".join(hashes[i:j])) for i, j in zip(first.tolist(), ends, strict=True)]
                tree, pos, size, level = tree[first], pos[first], size[first], level + 1
                yield _rows(tree, pos, size, hashes, level)

    chunked = nodes.select("tree_no", "pos", "size", "hash", F.shiftright("pos", BAND).alias("chunk"))
    return map_arrow(chunked.repartition("tree_no", "chunk").sortWithinPartitions("tree_no", "pos"), run, NODE)


def _rows(tree: np.ndarray, pos: np.ndarray, size: np.ndarray, hashes: list[str], level: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tree), pa.array(pos), pa.array(size), pa.array(hashes, pa.string()), pa.array(np.full(len(tree), level, np.int32))], names=["tree_no", "pos", "size", "hash", "level"])


def build(leaves: DataFrame, path: str | None = None) -> Forest:
    """The forest over ``leaves`` (tree_no: long, pos: long from 0 without gaps in each tree, size: long, hash: hex text).

    While a level of a tree has several nodes, every two consecutive ones become their digest, a last single one its own. An
    empty table gives an empty forest. ``path``: the store, in the shared folder by default; it must not exist.
    """
    spark = leaves.sparkSession
    path = path or fresh_path(spark, "merkle")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    highest, low, below = max(0, largest - 1).bit_length(), 0, leaves
    while low == 0 or low < highest:
        _band(below, low).write.mode("append").partitionBy("level").parquet(path)
        low += BAND
        below = spark.read.schema(NODE).parquet(path).where(F.col("level") == low)
    every = spark.read.schema(NODE).parquet(path)
    trees = every.where("pos = 0").groupBy("tree_no").agg(F.max(F.when(F.col("level") == 0, F.col("size"))).alias("size"), F.max_by("hash", "level").alias("top"))
    return Forest(path, highest, trees)


def paths(forest: Forest, asked: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``asked`` (tree_no, pos and further columns) with ``path``, the siblings of a leaf up to the top of its tree, then
    ``above``'s path of that tree, and with ``above``'s other columns.

    An entry is ``L`` or ``R``, the side of the sibling, before its digest, or empty where a node had none. ``above``:
    (tree_no, path, further columns), a row for each tree that is asked for; rows of trees that it lacks have none of these.
    """
    spark = asked.sparkSession
    bands = max(1, -(-forest.highest // BAND))
    sizes = forest.trees.select("tree_no", "size")
    if above is None:
        above = sizes.select("tree_no", F.array().cast("array<string>").alias("path"))
    extra = [f for f in above.schema if f.name not in ("tree_no", "path")]
    ends = above.join(sizes, "tree_no").withColumn("band", F.greatest(F.lit(0), F.floor((height(F.col("size")) - 1) / BAND)).cast("int")).drop("size")
    higher: DataFrame | None = None
    for band in reversed(range(bands)):
        low = band * BAND
        tops = ends.where(F.col("band") == band).select("tree_no", F.lit(0).cast("long").alias("chunk"), "path", *[f.name for f in extra])
        if higher is not None:
            tops = tops.unionByName(higher.select("tree_no", F.col("pos").alias("chunk"), "path", *[f.name for f in extra]))
        nodes = forest.nodes(spark, low, low + BAND)
        wanted = asked if not band else nodes.where(F.col("level") == low).select("tree_no", "pos")
        higher = _scan(nodes, wanted, tops, low, extra)
    return higher


def _scan(nodes: DataFrame, wanted: DataFrame, tops: DataFrame, low: int, extra: list) -> DataFrame:
    """Merges by (tree, chunk) the paths above chunks, the nodes of a band and the coordinates at its lowest level."""
    kept = [f for f in wanted.schema if f.name not in ("tree_no", "pos")]
    down = F.lit(BAND + low) - F.col("level")
    nothing = lambda fields, have: [F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name not in have]
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    a = tops.select("tree_no", "chunk", F.lit(0).alias("what"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("level"), number.alias("size"), text.alias("hash"), "path", *[f.name for f in extra], *nothing(kept, ()))
    b = nodes.select("tree_no", F.expr("pos").alias("pos"), "level", "size", "hash", down.alias("down_")).select("tree_no", F.expr("shiftright(pos, down_)").alias("chunk"), F.lit(1).alias("what"), "pos", "level", "size", "hash", F.lit(None).cast("array<string>").alias("path"), *nothing(extra, ()), *nothing(kept, ()))
    c = wanted.select("tree_no", F.shiftright("pos", BAND).alias("chunk"), F.lit(2).alias("what"), "pos", F.lit(0).alias("level"), number.alias("size"), text.alias("hash"), F.lit(None).cast("array<string>").alias("path"), *nothing(extra, ()), *[f.name for f in kept])
    merged = a.unionByName(b).unionByName(c).repartition("tree_no", "chunk").sortWithinPartitions("tree_no", "chunk", "what", "level", "pos")
    passed, given = [f.name for f in kept], [f.name for f in extra]
    schema = merged.select("tree_no", "pos", "path", *given, *passed).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["tree_no", "chunk"]):
            for start, end in bounds:
                part = table.slice(start, end - start)
                what = part["what"].to_numpy()
                first, last = int(np.searchsorted(what, 1)), int(np.searchsorted(what, 2))
                if last == len(what):
                    continue
                higher = part["path"][0].as_py() if first else []
                levels: list[tuple[int, list[str]]] = []  # first position of the chunk at each level, and its digests
                level, pos, size, hashes = (part[c].slice(first, last - first) for c in ("level", "pos", "size", "hash"))
                level, pos, size = level.to_numpy(), pos.to_numpy(), size.to_numpy()
                at = 0
                while at < len(level) and size[at] > 1:
                    upto = int(np.searchsorted(level, level[at], "right"))
                    levels.append((int(pos[at]), hashes.slice(at, upto - at).to_pylist()))
                    at = upto
                leaves = part.slice(last)
                found = []
                for p in leaves["pos"].to_pylist():
                    path = []
                    for base, digests in levels:
                        i = (p ^ 1) - base
                        path.append(("L" if p & 1 else "R") + digests[i] if i < len(digests) else "")
                        p >>= 1
                    found.append(path + higher)
                n = leaves.num_rows
                above = [pa.array([part[g][0].as_py() if first else None] * n, part.schema.field(g).type) for g in given]
                columns = [leaves["tree_no"], leaves["pos"], pa.array(found, pa.list_(pa.string())), *above, *[leaves[g] for g in passed]]
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], names=["tree_no", "pos", "path", *given, *passed])

    return map_arrow(merged, run, schema)


def folded(path: Column, start: Column) -> Column:
    """The digest that ``start`` and the siblings of ``path`` lead to."""
    step = lambda x, s: F.sha2(F.when(F.startswith(s, F.lit("L")), F.concat(F.substr(s, F.lit(2)), x)).otherwise(F.concat(x, F.substr(s, F.lit(2)))), 256)
    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """The digests of ``path`` one behind the other."""
    return F.array_join(F.transform(path, lambda s: F.substr(s, F.lit(2))), "")


def manifest(leaves: DataFrame, tree: str, key: str, path: str | None = None) -> DataFrame:
    """``leaves`` (columns ``tree``, ``key``, ``leaf`` and others) with subroot, root and path of every row.

    Trees are the values of ``tree``, null being one; their leaves ascend by ``key``, then by digest, nulls first. The roots of
    trees, in their order, are the leaves of the last tree. Rows that repeat are leaves of their own; an empty table gives an
    empty one. The node stores stay below ``path``, in the shared folder by default.
    """
    spark = leaves.sparkSession
    path = path or fresh_path(spark, "manifest")
    names = {c: f"c{i}" for i, c in enumerate(leaves.columns)}  # none is the name of a generated column
    group, own = names[tree], names["leaf"]
    placed = written(ranked(leaves.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [group, names[key], own], "place"), "placed")
    trees = placed.groupBy(F.col(group).alias("tree")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    numbered = written(ranked(trees, ["tree"], "tree_no"), "trees")  # broadcast if Spark finds it small
    located = placed.join(numbered, F.col(group).eqNullSafe(F.col("tree"))).withColumn("pos", F.col("place") - F.col("first")).drop("place", "first", "tree")
    located = written(located, "located")
    forest = build(located.select("tree_no", "pos", "size", F.col(own).alias("hash")), f"{path}/trees")
    n_trees = numbered.agg(F.count(F.lit(1)).alias("size"))
    roots = forest.trees.select(F.lit(0).cast("long").alias("tree_no"), F.col("tree_no").alias("pos"), F.col("top").alias("hash")).crossJoin(F.broadcast(n_trees))
    roots = written(roots, "roots")
    last = build(roots, f"{path}/root")
    root = last.trees.select(F.col("top").alias("root"))
    above = paths(last, roots.select("tree_no", "pos", F.col("hash").alias("subroot"))).select(F.col("pos").alias("tree_no"), "path", "subroot").crossJoin(F.broadcast(root))
    found = paths(forest, located.drop("size"), above)
    kept = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in ("path", "subroot", "root")]
    return found.select(*kept, "path", "subroot", "root")
