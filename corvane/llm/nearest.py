"""Exact nearest neighbours of many queries by a block matrix join.

Blocks of queries meet lanes of candidates; a task streams a lane past its block in tiles. Vectors are quantised to int8: the
product of two code matrices gives every distance of a tile within a proven error. Only pairs that may be among the nearest are
computed again on the original components, in double precision, and go to the queries' heaps, whose worst members bound the
tiles that follow.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import map_arrow

#: Queries of a block and candidates of a tile: what a task holds besides its heaps.
BLOCK_QUERIES, TILE_ROWS = 2048, 2048
#: Lanes of candidates for each block of queries at least; more if the session has more shuffle partitions.
LANES = 32
#: Products of so many int8 codes at once are exact in 32-bit floats: 1,024 * 127 * 127 is below 2^24.
SLAB = 1024


def usable(embedding: str) -> Column:
    """Whether a vector takes part: not null, no component null, infinite or not-a-number, and one that is not zero."""
    v = F.col(embedding)
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x.cast("double"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


class Codes:
    """Rows of a double matrix as int8 codes: x = scale * code + rest, with the rest's length."""

    def __init__(self, x: np.ndarray) -> None:
        scale = np.abs(x).max(1) / 127
        scale[scale == 0] = 1.0  # components so small that their 127th part is zero
        self.codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
        coded = scale[:, None] * self.codes
        with np.errstate(over="ignore"):  # infinite bounds prune nothing
            self.scale, self.rest = scale, np.sqrt(np.square(x - coded).sum(1))
            self.square = np.square(coded).sum(1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of two int8 matrices."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], SLAB):
        out += a[:, i : i + SLAB].astype(np.float32) @ b[:, i : i + SLAB].astype(np.float32).T
    return out


def bounds(q: Codes, c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all rows: the codes' distance, less and more the lengths of both rests."""
    with np.errstate(all="ignore"):
        square = q.square[:, None] + c.square[None, :]
        near = np.sqrt(np.maximum(square - 2 * q.scale[:, None] * c.scale[None, :] * products(q.codes, c.codes), 0))
        # Rounding of the sums: a root takes half of the digits of what cancels.
        slack = q.rest[:, None] + c.rest[None, :] + 1e-6 * np.sqrt(square)
        return near - slack, near + slack


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, components summed in order, in double precision."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for k in range(x.shape[1]):
            d = x[:, k] - y[:, k]
            total += d * d
    return np.sqrt(total)


class Block:
    """Queries and their heaps of the ``k`` nearest candidates so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k, self.codes = ids, x, k, Codes(x)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]  # of negative distances and ids: the worst is first
        self.worst = np.full(len(ids), np.inf)

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        """One tile: all queries against the candidates ``y``."""
        low, high = bounds(self.codes, Codes(y))
        own = self.ids[:, None] == ids[None, :]
        high[own] = np.inf
        high[np.isnan(high)] = np.inf
        worst = self.worst
        if len(ids) > self.k:  # k candidates of this tile are no further than the k-th upper bound
            worst = np.minimum(worst, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        maybe = ~(low > worst[:, None]) & ~own
        for start in range(0, len(self.ids), 64):  # rows of survivors in memory stay few when many tie
            at, of = np.nonzero(maybe[start : start + 64])
            self._push(at + start, of, ids, y)

    def _push(self, at: np.ndarray, of: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        d = np.concatenate([distances(self.x[at[i : i + 100_000]], y[of[i : i + 100_000]]) for i in range(0, len(at), 100_000)]) if len(at) else np.zeros(0)
        found = ids[of]
        order = np.lexsort((found, d, at))
        at, d, found = at[order], d[order], found[order]
        first = np.searchsorted(at, at)  # where each query's survivors begin
        kept = np.arange(len(at)) - first < self.k
        for q, score, vec_id in zip(at[kept].tolist(), d[kept].tolist(), found[kept].tolist(), strict=True):
            heap, entry = self.heaps[q], (-score, -vec_id)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.worst[q] = -heap[0][0]

    def rows(self) -> pa.RecordBatch:
        found = [(int(q), -v, -s) for q, heap in zip(self.ids, self.heaps, strict=True) for s, v in heap]
        columns = [*zip(*found, strict=True)] if found else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a double matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of ``candidates`` to each vector of ``queries``, by Euclidean distance.

    Ranks begin at 1; ties go to the smaller id; a query's own id is no answer to it; with fewer candidates all are found.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors of
    different lengths don't meet. Of rows with one id the vector that is least in order counts. Empty tables give no rows;
    extra columns are not read. A task holds one block of queries and one tile: queries are repeated for every lane,
    candidates for every block of queries, and nothing is broadcast.
    """
    spark = candidates.sparkSession
    if k < 1:
        raise ValueError(f"k = {k}")

    def vectors(df: DataFrame) -> DataFrame:
        named = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
        once = named.where(F.col("vec_id").isNotNull() & usable("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        return once.withColumn("dim", F.size("embedding"))

    asked, there = vectors(queries), vectors(candidates)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    lanes = max(LANES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", number(blocks, 1)).withColumn("lane", every(lanes)).withColumn("asks", F.lit(0))
    right = there.withColumn("lane", number(lanes, 2)).withColumn("block", every(blocks)).withColumn("asks", F.lit(1))
    tiles = left.unionByName(right).repartition("dim", "block", "lane").sortWithinPartitions("dim", "block", "lane", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "block", "lane", "asks")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part, here = batch.slice(i, j - i), tuple(keys[:3, i].tolist())
                if here != key:
                    if block:
                        yield block.rows()
                    key, asking, block = here, [], None
                ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("embedding"))
                if keys[3, i] == 0:
                    asking.append((ids, x))
                elif asking:
                    block = block or Block(np.concatenate([a for a, _ in asking]), np.concatenate([b for _, b in asking]), k)
                    for s in range(0, len(ids), TILE_ROWS):
                        block.meet(ids[s : s + TILE_ROWS], x[s : s + TILE_ROWS])
        if block:
            yield block.rows()

    found = map_arrow(tiles, run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
