"""Self-join of documents by the Jaccard similarity of their word shingles, and the components of its links.

Documents with the same set count as one node. A global order puts rare shingles first; two sets that are similar enough
share one of the first ``n - ceil(t * n) + 1`` shingles of either, so only these prefixes are joined. The members of a
prefix shingle are compared in numpy by length, by position of the shared shingle and by a suffix filter: a bit for each
of 1,024 ranges of the hash space, whether the set has an odd number of elements there, so that differing bits bound the
distance of two sets from below. A task gathers what passes into families (its candidate links' components) and returns
one row for each member, never pairs.

The texts of a family then come together once, and its pairs are verified on the whole sets, nearest first; pairs that
links already connect are spared, so a family of m gives m - 1 links at most. This runs twice: first over the few rarest
shingles that a document shares, which unites most near copies, then over all shingles whose members are still in
different components, comparing those of different components without any limit. Every link between components is found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import let_go, map_arrow, runs, sliced, written
from corvane.llm.components import components
from corvane.llm.shingles import WordHashes, shingle_sets

#: Buckets of shingle counts that order shingles by rarity: as many whatever the corpus, 4 bytes each, broadcast. A shared
#: bucket changes the order, not the result: any order that all documents share is right.
BUCKETS = 1 << 18
#: Bits of the suffix filter.
BITS = 1024
#: Shared prefix shingles of a document that the first round looks at; what they leave apart is the second round's.
FIRST = 4
#: Members of a group that meet in one task; a larger group is dealt into parts, and parts into pairs where all must meet.
BLOCK = 1024
#: Elements of the whole sets that a part of a family holds, about.
ELEMENTS = 1 << 21
#: Rows up to which a table of ids is broadcast (about 16 to 40 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000

Threshold = tuple[int, int]


def required(n: np.ndarray, t: Threshold) -> np.ndarray:
    """Least overlap of two sets of ``n`` elements together for similarity t = p / q, in exact integers."""
    p, q = t
    return -(-(p * n) // (p + q))


def prefix_length(n: int, t: Threshold) -> int:
    p, q = t
    return n - -(-p * n // q) + 1


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


# -- sets ----------------------------------------------------------------------------------------------------------------


def digest(a: np.ndarray) -> tuple[int, int]:
    """128 bits of xxhash of a set, as two signed integers."""
    hi, lo = np.frombuffer(xxhash.xxh128_digest(a.tobytes()), ">i8").tolist()
    return hi, lo


def parities(a: np.ndarray, bits: int = BITS) -> bytes:
    """For each of ``bits`` ranges of the hash space (a power of two), whether the set has an odd number of elements there."""
    return np.packbits(np.bincount((a >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def rare_first(a: np.ndarray, rank: np.ndarray, t: Threshold) -> np.ndarray:
    """The prefix of a set: its rarest shingles in order of (rank, hash)."""
    first = prefix_length(len(a), t)
    if first < len(a):
        keep = np.flatnonzero(rank <= np.partition(rank, first - 1)[first - 1])
        a, rank = a[keep], rank[keep]
    return a[np.lexsort((a, rank))][:first]


def _described(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """doc_id, n, hi and lo (digest of the set; null if empty) of each document, and (bucket, c): documents with a shingle
    in each bucket of hashes, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known, total = WordHashes(), np.zeros(buckets, np.int64)
        names = ["doc_id", "n", "hi", "lo", "bucket", "c"]
        for batch in batches:
            for part in sliced(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), size, known)
                total += np.bincount((np.concatenate(sets) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
                marks = [digest(a) if len(a) else (None, None) for a in sets]
                void = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(a) for a in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), void, void], names=names)
        at = np.flatnonzero(total)
        void = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([void, void, void, void, pa.array(at), pa.array(total[at])], names=names)

    return written(map_arrow(docs, run, "doc_id bigint, n bigint, hi bigint, lo bigint, bucket bigint, c bigint"), "described")


def _ranks(described: DataFrame, buckets: int) -> np.ndarray:
    """Documents with a shingle in each bucket: at most ``buckets`` rows reach the driver."""
    got = described.where("bucket is not null").groupBy("bucket").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _prefixes(docs: DataFrame, nodes: DataFrame, ranks: np.ndarray, size: int, t: Threshold) -> DataFrame:
    """row (a number), node, n, prefix and bits of each different set."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known, count = WordHashes(), shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in sliced(batch, "text"):
                rows = []
                for a in shingle_sets(part.column("text").to_pylist(), size, known):
                    if not len(a) or (mark := digest(a)) in seen:
                        continue
                    seen.add(mark)  # copies within a task end here, so that no set is shuffled more than once a task
                    rows.append((*mark, len(a), rare_first(a, count[(a & np.uint64(len(count) - 1)).astype(np.int64)], t).view(np.int64), parities(a)))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["hi", "lo", "n", "prefix", "bits"])

    made = map_arrow(docs.select("text"), run, "hi bigint, lo bigint, n int, prefix array<bigint>, bits binary")
    different = made.dropDuplicates(["hi", "lo"]).join(nodes, ["hi", "lo"])
    # Numbers of the rows as written: short keys for what follows.
    return written(different.withColumn("row", F.monotonically_increasing_id()), "prefixes")


def _members(prefixes: DataFrame) -> DataFrame:
    """node, n, bits and shared: pos, h and c of a set's prefix shingles that another set has in its prefix too, c being the
    number of sets that do; sets without any are left out. Light rows alone are shuffled by shingle."""
    spread = prefixes.select("row", F.posexplode("prefix").alias("pos", "h"))
    # Elements of a set differ and sets differ, so a shingle that counts twice belongs to two sets.
    shared = spread.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    kept = spread.join(shared, "h").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "c"))).alias("shared"))
    return written(prefixes.select("row", "node", "n", "bits").join(kept, "row").drop("row"), "members")


# -- families ------------------------------------------------------------------------------------------------------------


class Filters:
    """Length, position and suffix filter between rows of arrays: sizes, positions of the shared shingle and bits."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, bits: np.ndarray, t: Threshold) -> None:
        self.n, self.pos, self.bits, self.t = n, pos, bits, t

    def passing(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) can be similar enough as far as the filters tell."""
        p, q = self.t
        a, b = self.n[i], self.n[j]
        need = required(a + b, self.t)
        # By length: the smaller set must suffice. By position: the shared shingle and what follows must suffice in either.
        ok = (p * np.maximum(a, b) <= q * np.minimum(a, b)) & (np.minimum(a - self.pos[i], b - self.pos[j]) >= need)
        k, spare = np.flatnonzero(ok), a + b - 2 * need
        for at in range(0, len(k), 1 << 13):
            part = k[at : at + (1 << 13)]
            one = self.bits[i] if np.isscalar(i) else self.bits[i[part]]
            apart = np.bitwise_count(one ^ self.bits[j[part]]).sum(1, dtype=np.int64)
            ok[part] = apart <= spare[part]
        return ok


class Families:
    """Union-find over the nodes that a task's candidate links join."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = above[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)


def _gather(filters: Filters, comp: np.ndarray, side: np.ndarray, begin: int, end: int, join: Callable[[int, int], None]) -> None:
    """Joins rows ``begin`` to ``end``, sorted by n, of one slot: every pair of different components (and sides, where the
    slot has two) that passes the filters ends in one family; pairs already in one are not compared."""
    own, sides = comp[begin:end], side[begin:end]
    two = sides.any() and not sides.all()
    label = np.arange(end - begin)
    p, q = filters.t
    upto = np.searchsorted(filters.n[begin:end], filters.n[begin:end] * q // p, "right")
    for i in range(end - begin - 1):
        free = (label[i + 1 : upto[i]] != label[i]) & (own[i + 1 : upto[i]] != own[i])
        if two:
            free &= sides[i + 1 : upto[i]] != sides[i]
        js = i + 1 + np.flatnonzero(free)
        if not len(js):
            continue
        js = js[filters.passing(begin + i, begin + js)]
        if len(js):
            label[np.isin(label, label[js])] = label[i]
            for j in js:
                join(begin + i, begin + int(j))


def _families(rows: DataFrame, t: Threshold) -> DataFrame:
    """(family, node, comp, n) of the rows (h, slot, side, node, comp, n, pos, bits) whose slots join them: a node has a
    row for each family of each task that it is in, and two candidates share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        families, about = Families(), {}
        for table, groups in runs(batches, ["h", "slot"]):
            node, comp, n, pos, side = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "comp", "n", "pos", "side"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
            filters = Filters(n, pos, bits, t)

            def join(i: int, j: int) -> None:
                families.join(int(node[i]), int(node[j]))
                for k in (i, j):
                    about[int(node[k])] = (int(comp[k]), max(int(n[k]), about.get(int(node[k]), (0, 0))[1]))

            two = np.array([a for a, b in groups if b - a == 2], np.int64)  # most slots are pairs: all of them at once
            two = two[comp[two] != comp[two + 1]]
            for i in two[filters.passing(two, two + 1)].tolist():
                join(i, i + 1)
            for a, b in groups:
                if b - a > 2:
                    _gather(filters, comp, side, a, b, join)
        if about:
            rows = [(families.root(x), x, c, n) for x, (c, n) in about.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["family", "node", "comp", "n"])

    dealt = rows.select("h", "slot", "side", "node", "comp", "n", "pos", "bits").repartition("h", "slot").sortWithinPartitions("h", "slot", "n", "node")
    return written(map_arrow(dealt, run, "family bigint, node bigint, comp bigint, n bigint").dropDuplicates(["family", "node"]), "families")


# -- dealing -------------------------------------------------------------------------------------------------------------


def _part(*seed: str | Column, parts: str) -> Column:
    return F.pmod(F.xxhash64(*seed), F.col(parts)).cast("int")


def _scattered(families: DataFrame, weight: Column, times: int = 2) -> DataFrame:
    """``families`` with slot and side: those above a weight of one are dealt into parts, ``times`` ways each, so that
    parts overlap."""
    large = written(families.groupBy("family").agg(F.ceil(F.sum(weight)).cast("int").alias("parts")).where("parts > 1"), "large")
    whole = families.join(small(large), "family", "left")
    spread = whole.withColumn("way", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(times - 1)))))
    slot = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.col("way") * F.col("parts") + _part("node", "way", parts="parts"))
    return spread.withColumn("slot", slot.cast("long")).withColumn("side", F.lit(0)).drop("way", "parts")


def _crossed(rows: DataFrame, key: str, weight: Column, heavy: Column) -> DataFrame:
    """``rows`` with slot and side: any two rows of different components of a group of ``key`` meet in a slot.

    A group above a weight of one, which only rows that are ``heavy`` belong to, is dealt: its largest component makes
    ``major`` parts, which need not meet each other, and the rest ``minor`` parts, which meet each other and those. A slot of
    two parts has a side for each. Such a group of one component has nothing to compare and goes.
    """
    shares = rows.where(heavy).groupBy(key, "comp").agg(F.sum(weight).alias("share"))
    groups = shares.groupBy(key).agg(F.max(F.struct("share", "comp")).alias("top"), F.sum("share").alias("w"), F.count(F.lit(1)).alias("comps")).where("w > 1")
    # Weights are sums of binary fractions: exact.
    large = written(groups.select(key, "comps", F.col("top.comp").alias("most"), F.ceil(F.col("w") - F.col("top.share")).cast("int").alias("minor"), F.ceil("top.share").cast("int").alias("major")), "large")
    whole = rows.join(small(large), key, "left").where("comps is null or comps > 1")
    own = F.when(F.col("comp") == F.col("most"), F.col("minor") + _part("node", parts="major")).otherwise(_part("node", parts="minor"))
    meets = F.when(F.col("own") >= F.col("minor"), F.sequence(F.lit(0), F.col("minor") - 1)).otherwise(F.sequence(F.lit(0), F.col("minor") + F.col("major") - 1))
    others = F.when(F.col("minor").isNull(), F.array(F.lit(0))).otherwise(meets)
    spread = whole.withColumn("own", own).withColumn("other", F.explode(others))
    slot = F.least("own", "other").cast("long") * (F.col("minor") + F.col("major")) + F.greatest("own", "other")
    return spread.withColumn("slot", F.coalesce(slot, F.lit(0)).cast("long")).withColumn("side", F.coalesce((F.col("own") > F.col("other")).cast("int"), F.lit(0))).drop("comps", "most", "minor", "major", "own", "other")


# -- links ---------------------------------------------------------------------------------------------------------------


def linked(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Pairs of rows whose sets are similar enough, as few as connect what similarity connects: a forest over ``comp``.

    Pairs of one component are spared, as are those of one side where there are two, and pairs that links found so far
    connect.
    """
    p, q = t
    order = np.argsort([len(a) for a in sets], kind="stable")
    n = np.array([len(sets[k]) for k in order], np.int64)
    bits = min(1 << 16, max(64, 1 << int(4 * n[-1]).bit_length()))
    filters = Filters(n, np.zeros(len(n), np.int64), np.frombuffer(b"".join(parities(sets[k], bits) for k in order), np.uint64).reshape(len(n), -1), t)
    label, sides = np.unique(comp[order], return_inverse=True)[1], side[order]
    two = sides.any() and not sides.all()
    upto = np.searchsorted(n, n * q // p, "right")
    out = []
    for i in range(len(n) - 1):
        free = label[i + 1 : upto[i]] != label[i]
        if two:
            free &= sides[i + 1 : upto[i]] != sides[i]
        js = i + 1 + np.flatnonzero(free)
        if not len(js):
            continue
        for j in js[filters.passing(i, js)].tolist():
            if label[j] != label[i]:
                a, b = sets[order[i]], sets[order[j]]
                overlap = len(np.intersect1d(a, b, assume_unique=True))
                if overlap * q >= (len(a) + len(b) - overlap) * p:
                    label[label == label[j]] = label[i]
                    out.append((int(order[i]), int(order[j])))
    return out


def _links(docs: DataFrame, rows: DataFrame, size: int, t: Threshold) -> DataFrame:
    """(a, b): components that a verified pair links, for ``rows`` (family, slot, side, node, comp). The texts of a slot
    come together; a doc_id that rows share brings all its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = WordHashes()
        for table, groups in runs(batches, ["family", "slot"]):
            found = set()
            for begin, end in groups:
                if end - begin < 2:
                    continue
                part = table.slice(begin, end - begin)
                comp, side = part.column("comp").to_numpy(), part.column("side").to_numpy()
                sets = shingle_sets(part.column("text").to_pylist(), size, known)
                keep = [k for k, a in enumerate(sets) if len(a)]
                if len(keep) > 1:
                    c = comp[keep]
                    found |= {(int(c[i]), int(c[j])) for i, j in linked([sets[k] for k in keep], c, side[keep], t)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(found), strict=True)], names=["a", "b"])

    placed = rows.select("family", "slot", "side", F.col("node").alias("doc_id"), "comp")
    texts = docs.join(small(written(placed, "placed")), "doc_id").select("family", "slot", "side", "comp", "text")
    dealt = texts.repartition("family", "slot").sortWithinPartitions("family", "slot")
    return written(map_arrow(dealt, run, "a bigint, b bigint"), "links")


def similar_components(docs: DataFrame, size: int, percent: int, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_shingles and component_id of each document: the least doc_id that links lead to, its own included.

    Two documents link if 100 * intersection >= ``percent`` * union of their sets of distinct shingles of ``size`` words
    (see ``shingle_sets`` for short texts). Null, empty and blank texts link with nothing. Rows with the same doc_id are one
    document with the links of all its texts; a row without doc_id has no component and links with nothing. Other columns
    are not read. The result has a row for each row of ``docs``; an empty table gives none.
    """
    g = math.gcd(percent, 100)
    t = (percent // g, 100 // g)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    described = _described(plain, size, buckets)
    light = described.where("bucket is null").select("doc_id", "n", "hi", "lo")
    nodes = written(light.where("hi is not null and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "nodes")
    members = _members(_prefixes(plain, nodes, _ranks(described, buckets), size, t))

    one, hot = F.lit(1.0 / BLOCK), F.col("c") > BLOCK
    weight = F.greatest(one, F.col("n") / ELEMENTS)
    few = members.withColumn("comp", F.col("node")).select("node", "comp", "n", "bits", F.inline(F.slice("shared", 1, FIRST)))
    parted = few.withColumn("parts", F.ceil(F.col("c") / BLOCK)).withColumn("slot", _part("node", "h", parts="parts").cast("long")).withColumn("side", F.lit(0))
    links = _links(plain, _scattered(_families(parted, t), weight), size, t)
    roots = written(components(links), "roots")

    joined = members.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    every = joined.select("node", "comp", "n", "bits", F.inline("shared"))
    rest = _families(_crossed(every, "h", one, hot), t)
    more = _links(plain, _crossed(rest, "family", weight, F.lit(True)), size, t)

    named = written(nodes.join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("comp")), "named")
    # Texts that share a doc_id are one document: their components are one, and a text without words belongs to it.
    several = light.where("doc_id is not null").groupBy("doc_id").agg(*[f(c).alias(f"{c}{k}") for c in ("hi", "lo") for k, f in enumerate((F.min, F.max))], F.count("hi").alias("c"), F.count(F.lit(1)).alias("rows"))
    several = several.where("hi0 <> hi1 or lo0 <> lo1 or (c > 0 and c < rows)").select("doc_id")
    theirs = written(light.join(several, "doc_id").join(named, ["hi", "lo"]).select("doc_id", "comp").distinct(), "theirs")
    least = theirs.groupBy("doc_id").agg(F.min("comp").alias("a"))
    same = theirs.join(least, "doc_id").select("a", F.col("comp").alias("b"))
    merged = written(components(more.unionByName(same)).withColumnRenamed("node", "comp"), "merged")
    final = named.join(merged, "comp", "left").select("hi", "lo", F.coalesce("root", "comp").alias("component"))
    wordless = light.where("hi is null").join(least.withColumnRenamed("a", "comp"), "doc_id", "left").join(merged, "comp", "left").select("doc_id", "n", F.coalesce("root", "comp").alias("component"))
    found = light.where("hi is not null").join(final, ["hi", "lo"], "left").select("doc_id", "n", "component").unionByName(wordless)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component the document of the least doc_id stays, one row for each doc_id.

    Of rows that share a kept doc_id the one of the least text stays (null first). Rows without doc_id and documents without
    words link with nothing and stay. Columns are those of ``docs``, whatever their names.
    """
    found = similar_components(docs, size, percent).where("doc_id is not null").select("doc_id", "component_id")
    ids = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.max("component_id").alias("component")), "kept")
    gone = ids.where("component <> doc_id").select("doc_id")
    again = ids.where("component = doc_id and c > 1").select("doc_id")
    apart, again = small(written(gone.unionByName(again), "apart")), small(written(again, "again"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Maps and variants have no order: rows of equal text are told apart by their digests as JSON.
    first = F.min_by(whole, F.struct(F.col("text"), F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)))
    repeated = docs.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_1")).agg(first.alias("_2")).select(*[F.col(f"_2.`{c}`") for c in docs.columns])
    return docs.join(apart, "doc_id", "left_anti").unionByName(repeated)
