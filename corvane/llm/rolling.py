"""Rolling exact medians and median absolute deviations of time series, by persistent segment trees over ranks.

A series is cut into slots of time; a slot's task gets its own rows and the halo before it, as long as a window. Sparse
stretches have slots of an hour, dense ones slots far shorter than a window: what all windows of such a slot hold whole comes as
counts of equal values, so that a task holds the rows of two slots and a histogram, however many rows a window has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_arrow, written

WINDOW_US, HOUR_US = 15 * 60 * 1_000_000, 3_600_000_000
#: Rows of one hour of a series beyond which its slots are halved, down to 1,024 an hour, until each has SLOT_ROWS or fewer.
DENSE_ROWS, SLOT_ROWS, MOST_SLOTS = 1 << 17, 1 << 15, 1 << 10
#: Rows whose slots share one tree: many small slots are one batch of numpy work.
TREE_ROWS = 40_000
#: Cents beyond this size, of infinities and not-a-numbers too, count as missing: doubled differences stay exact.
MOST_CENTS = 1 << 60


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is read as it stands, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"CAST(CAST(CAST(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)")
    return F.unix_micros(name)


def cents(value: str) -> Column:
    """floor(100 * value + 0.5) as a long; null for null, not-a-number and what is too large."""
    c = F.lit(100.0) * F.col(value).cast("double") + F.lit(0.5)
    return F.when(F.abs(c) < F.lit(float(MOST_CENTS)), F.floor(c))


class RankTree:
    """A persistent segment tree over the ranks of ``values``, one version for each insertion, in their order.

    Version i holds the first i insertions; node (i, d) is the node of depth d on the path of insertion i. Its child off the
    path is that of the latest insertion before i that went there: paths are shared, not copied.
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray) -> None:
        self.values, rank = np.unique(values, return_inverse=True)
        n = len(rank)
        self.height = max(1, int(len(self.values)).bit_length())
        self.total = np.concatenate([[0], np.cumsum(weights)])
        self.left: list[np.ndarray] = []  # of node (i, d): the weight in its left child
        self.child: list[np.ndarray] = []  # of node (i, d), side s, at 2 i + s: an insertion; 0 is the empty node
        order, at = np.arange(n), np.arange(n)
        for d in range(self.height):
            prefix = (rank >> (self.height - d))[order]  # insertions by node, then by age
            side = (rank >> (self.height - d - 1) & 1)[order]
            first = np.maximum.accumulate(np.where(np.append(True, prefix[1:] != prefix[:-1]), at, 0)) if n else at
            child = np.zeros((n + 1, 2), np.int32)
            for s in (0, 1):
                latest = np.maximum.accumulate(np.where(side == s, at, -1)) if n else at
                child[order + 1, s] = np.where(latest >= first, order[latest] + 1, 0)
            w = np.concatenate([[0], np.cumsum(np.where(side == 0, weights[order], 0))])
            left = np.zeros(n + 1, np.int64)
            left[order + 1] = w[1:] - w[first]
            self.child.append(child.reshape(-1))
            self.left.append(left)
            order = order[np.argsort(prefix * 2 + side, kind="stable")]

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 1) of what version ``hi`` holds and version ``lo`` does not."""
        rank = np.zeros(len(k), np.int64)
        for left, child in zip(self.left, self.child, strict=True):
            below = left[hi] - left[lo]
            right = k > below
            k = np.where(right, k - below, k)
            hi, lo = child[2 * hi + right], child[2 * lo + right]
            rank = 2 * rank + right
        return self.values[rank]

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, side: str = "left") -> np.ndarray:
        """How many values less than ``value`` (``right``: or equal) lie between the two versions."""
        bound = np.searchsorted(self.values, value, side)  # at most 2^height - 1
        count = np.zeros(len(bound), np.int64)
        for d, (left, child) in enumerate(zip(self.left, self.child, strict=True)):
            right = bound >> (self.height - d - 1) & 1
            count += (left[hi] - left[lo]) * right
            hi, lo = child[2 * hi + right], child[2 * lo + right]
        return count

    def medians(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, doubled medians and doubled medians of |2 value - doubled median| of windows; of empty ones, zeros."""
        n = self.total[hi] - self.total[lo]
        m2, m4 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        some = np.flatnonzero(n)
        if len(some):
            lo, hi, size = lo[some], hi[some], n[some]
            k, even = (size + 1) // 2, size % 2 == 0
            m = self.select(lo, hi, k)
            m2[some] = m = m + np.where(even, self.select(lo, hi, size // 2 + 1), m)
            near, ball = self._radius(lo, hi, size, k, m)
            further = near.copy()
            rest = np.flatnonzero(even & (ball == k))  # the next one lies outside, on either side
            if len(rest):
                further[rest] = self._outside(lo[rest], hi[rest], size[rest], m[rest], near[rest])
            m4[some] = near + further
        return n, m2, m4

    def _radius(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, k: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bisects, for each window, the least radius around ``m`` that holds ``k`` doubled values; how many it holds."""
        first = (size - k) // 2 + 1
        v, w = 2 * self.select(lo, hi, first), 2 * self.select(lo, hi, first + k - 1)
        most = np.maximum(np.abs(m - v), np.abs(w - m))  # these k lie within
        beyond = first + k <= size
        least = np.abs(m - v)
        if beyond.any():
            least[beyond] = np.minimum(least, np.abs(2 * self.select(lo, hi, np.minimum(first + k, size)) - m))[beyond]  # fewer than k lie nearer
        least = np.minimum(least, most)
        open_ = np.flatnonzero(least < most)
        while len(open_):
            r = (least[open_] + most[open_]) // 2
            enough = self._within(lo[open_], hi[open_], m[open_], r) >= k[open_]
            most[open_[enough]] = r[enough]
            least[open_[~enough]] = r[~enough] + 1
            open_ = open_[least[open_] < most[open_]]
        return most, self._within(lo, hi, m, most)

    def _within(self, lo: np.ndarray, hi: np.ndarray, m: np.ndarray, r: np.ndarray) -> np.ndarray:
        return self.below(lo, hi, (m + r) // 2, "right") - self.below(lo, hi, -((r - m) // 2))

    def _outside(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, m: np.ndarray, r: np.ndarray) -> np.ndarray:
        a, b = self.below(lo, hi, -((r - m) // 2)), self.below(lo, hi, (m + r) // 2, "right")
        far = np.int64(1 << 62)
        before = np.where(a > 0, m - 2 * self.select(lo, hi, np.maximum(a, 1)), far)
        behind = np.where(b < size, 2 * self.select(lo, hi, np.minimum(b + 1, size)) - m, far)
        return np.minimum(before, behind)


def _slots(t: Column, hour: Column, per_hour: Column, window_us: int) -> Column:
    """The slots of ``hour`` (of ``per_hour`` equal slots) that begin behind ``t`` and have a window that holds it: their
    starts, and whether all their windows do."""
    size = (F.lit(HOUR_US) / per_hour).cast("long")
    begin = hour * F.lit(HOUR_US)
    low = F.greatest(F.lit(0), F.floor((t - begin) / size) + 1).cast("long")
    high = F.least(per_hour - 1, F.floor((t + F.lit(window_us - 1) - begin) / size)).cast("long")
    starts = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: begin + i * size))
    return F.transform(starts, lambda s: F.struct(s.alias("slot"), (t >= s + size - F.lit(window_us)).alias("whole")))


def _dealt(rows: DataFrame, window_us: int, dense_rows: int) -> DataFrame:
    """(series, slot, ts, cents, weight, id): every row in its own slot, with its id, and what halos get of it, without.

    The hours of a series with more than ``dense_rows`` rows are counted first; they are at most that much fewer than rows.
    """
    hour = F.floor(F.col("ts") / F.lit(HOUR_US))
    counts = rows.groupBy("series", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense_rows)
    halved = F.ceil(F.log2(F.col("n") / F.lit(float(SLOT_ROWS))))
    dense = written(counts.select("series", "hour", F.least(F.lit(MOST_SLOTS), F.greatest(F.lit(8), F.pow(F.lit(2), halved))).cast("long").alias("per_hour")), "dense")
    some_dense = not dense.isEmpty()
    placed = rows.withColumn("hour", hour)
    for name, shift in (("own_", 0), ("next_", 1)):
        if some_dense:
            found = dense.select(F.col("series").alias("s_"), (F.col("hour") - shift).alias("h_"), F.col("per_hour").alias(name))
            placed = placed.join(found, F.col("series").eqNullSafe(F.col("s_")) & (F.col("hour") == F.col("h_")), "left").drop("s_", "h_")
            placed = placed.withColumn(name, F.coalesce(name, F.lit(1).cast("long")))
        else:
            placed = placed.withColumn(name, F.lit(1).cast("long"))
    t = F.col("ts")
    size = (F.lit(HOUR_US) / F.col("own_")).cast("long")
    one = F.lit(1).cast("long")
    own = placed.select("series", (t - F.pmod(t, size)).alias("slot"), "ts", "cents", one.alias("weight"), "id", F.lit(True).alias("asks"))
    nothing = F.array().cast("array<struct<slot: bigint, whole: boolean>>")
    reached = lambda h, n: F.coalesce(_slots(t, h, n, window_us), nothing)
    copies = placed.where("cents is not null").select("series", "ts", "cents", F.explode(F.concat(reached(F.col("hour"), F.col("own_")), reached(F.col("hour") + 1, F.col("next_")))).alias("s"))
    none, halo = F.lit(None).cast("long"), F.lit(False)
    dealt = own.unionByName(copies.where("not s.whole").select("series", "s.slot", "ts", "cents", one.alias("weight"), none.alias("id"), halo.alias("asks")))
    if some_dense:  # else no slot is shorter than a window
        inside = copies.where("s.whole").groupBy("series", "s.slot", "cents").agg(F.count(F.lit(1)).alias("weight"))
        dealt = dealt.unionByName(inside.select("series", "slot", (F.col("slot") - 1).alias("ts"), "cents", "weight", none.alias("id"), halo.alias("asks")))
    return dealt


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of longs with zeros for nulls, and where it has values."""
    import pyarrow.compute as pc

    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()


def _answers(table: pa.Table, bounds: np.ndarray, window_us: int) -> pa.RecordBatch:
    """Results of the asking rows of ``table``: whole slots, sorted by time; ``bounds`` are the slots' first rows."""
    ts, (value, known), (weight, _), (ids, has_id) = table["ts"].to_numpy(), *(_numbers(table[c]) for c in ("cents", "weight", "id"))
    asks = table["asks"].to_numpy(zero_copy_only=False)
    group = np.zeros(len(ts), np.int64)
    group[bounds[1:]] = 1
    group = np.cumsum(group)
    # Windows never reach behind a slot's halo: versions of other slots cancel out in the difference.
    key = group * (HOUR_US + 4 * window_us) + (ts - table["slot"].to_numpy() + 2 * window_us)
    inserted = key[known]
    tree = RankTree(value[known], weight[known])
    at = np.flatnonzero(asks)
    hi = np.searchsorted(inserted, key[at], "right")
    lo = np.searchsorted(inserted, key[at] - window_us, "right")
    n, m2, m4 = tree.medians(lo, hi)
    empty = n == 0
    far = 2 * np.abs(2 * value[at] - m2) > 2 * m4
    long = lambda x, null: pa.array(x, pa.int64(), mask=null)
    return pa.RecordBatch.from_arrays(
        [long(ids[at], ~has_id[at]), table["series"].take(pa.array(at)).combine_chunks(), pa.array(n), long(m2, empty), long(m4, empty), pa.array(far, mask=empty | ~known[at])],
        names=["id", "series", "n", "median2", "mad4", "far"],
    )


def _starts(table: pa.Table) -> np.ndarray:
    """First rows of the slots of a sorted table."""
    series = table["series"].combine_chunks().dictionary_encode()
    series = series.combine_chunks() if isinstance(series, pa.ChunkedArray) else series
    number = series.indices.fill_null(-1).to_numpy()
    slot = table["slot"].to_numpy()
    return np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (number[1:] != number[:-1])))


def rolling_medians(rows: DataFrame, window_us: int = WINDOW_US, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """(id, series, n, median2, mad4, far) of every row of ``rows`` (id: long, series: string, ts: long microseconds, cents: long).

    A row's window holds the cents of its series' rows with a ts above its own less ``window_us`` (15 minutes at most) and at
    most its own. ``median2`` is the doubled median, ``mad4`` the doubled median of |2 cents - median2|, ``far`` whether
    2 |2 cents - median2| is above 2 ``mad4``. Rows without a ts are left out; those without cents ask and count for nothing;
    a window without cents has n = 0 and nulls. A null series is a series; equal rows are rows of their own; an empty table
    gives an empty one. Extra columns are not read. A task holds the rows of one slot and as many before it.
    """
    if not 0 < window_us <= WINDOW_US:
        raise ValueError(f"a window of {window_us} microseconds; at most {WINDOW_US}")
    base = rows.select("id", "series", "ts", "cents").where("ts is not null")
    dealt = _dealt(base, window_us, dense_rows).repartition("series", "slot").sortWithinPartitions("series", "slot", "ts", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TREE_ROWS:
                table = pa.Table.from_batches(held)
                starts = _starts(table)
                if len(starts) > 1:  # the last slot may go on
                    cut = int(starts[-1])
                    yield _answers(table.slice(0, cut), starts[:-1], window_us)
                    held = table.slice(cut).to_batches()
                    n = table.num_rows - cut
        if n:
            table = pa.Table.from_batches(held)
            yield _answers(table, _starts(table), window_us)

    return map_arrow(dealt, run, "id long, series string, n long, median2 long, mad4 long, far boolean")


def click_medians(clicks: DataFrame, window_us: int = WINDOW_US, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """(click_id, kind, n, median2, mad4, far) of every click of ``clicks`` (click_id, ts, kind, value), each click_id once.

    Of rows with one click_id the least by ts, kind and value counts, those without ts aside; null click_ids are one id.
    Values that are null, not-a-number, infinite or beyond 2^60 cents have no cents. See ``rolling_medians`` for the rest.
    """
    timed = clicks.select("click_id", micros(clicks, "ts").alias("ts"), "kind", cents("value").alias("cents")).where("ts is not null")
    once = timed.groupBy("click_id").agg(F.min(F.struct("ts", "kind", "cents")).alias("c"))
    rows = once.select(F.col("click_id").cast("long").alias("id"), F.col("c.kind").cast("string").alias("series"), "c.ts", "c.cents")
    found = rolling_medians(rows, window_us, dense_rows)
    return found.select(F.col("id").alias("click_id"), F.col("series").alias("kind"), "n", "median2", "mad4", "far")
