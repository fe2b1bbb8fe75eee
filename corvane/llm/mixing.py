"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Every source has a target in words. The rates that meet the targets and stay nearest to one copy each, by relative
entropy, under at most ``MOST`` copies of a document, are ``min(MOST, exp(m * size))`` with one multiplier m a source: the
dual of the problem. Newton steps on all sources at once find the multipliers; a step is one aggregation over the
histogram of (source, size), which says as much as the documents. Rates then become whole copies: a document gets the
whole part of its rate, and one more if a hash of it lies below the rest plus a shift that two passes set for each source
so that its words come to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut, written

#: Copies of a document at most, and a source's target over its size.
MOST = 3
#: Newton steps after which the loop counts as broken; halving takes over where a step would leave its bracket, so that
#: this suffices.
STEPS = 80
#: Relative distance from the target at which a source's multiplier stands.
NEAR = 1e-7
#: Bins of a rounding pass.
BINS = 4096
#: Sources up to which the table of their parameters is broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 100_000
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source))


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each source of ``sized`` (key, source, size): key, source_size and target.

    Sources in order of code points, null last, weigh 1, 2, 3, repeating, and share the size of all; a target stops at
    ``most`` times its source's size and the others share what is left by weight. The windows here run over sources, not
    documents.
    """
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % 3 + 1)
    everything = Window.partitionBy()
    level = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    # If the sources before this one, those that reach their bounds first, are at their bounds, the others get this much a unit of weight.
    shared = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    filled = shared.withColumn("unit", (F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # The first that stays within its bound at that level fixes the level for all.
    free = filled.withColumn("level", F.min(F.when(F.col("unit") * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), "key", "unit"))).over(everything)["unit"])
    return free.select("key", "source_size", F.least(F.lit(most) * F.col("source_size"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).cast("double").alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    return rows.join(F.broadcast(sources) if count <= BROADCAST_SOURCES else sources, "key")


def multipliers(histogram: DataFrame, wanted: DataFrame, count: int, most: int = MOST) -> DataFrame:
    """``wanted`` with ``m``, the multiplier of each source; ``histogram`` has key, size and n, the number of documents."""
    scale = histogram.where("size > 0").groupBy("key").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("unit"), F.min("size").alias("least"))
    # Below the bracket's lower end no source keeps a word, at its upper end every document has its most copies.
    state = wanted.join(scale, "key", "left").select(
        "key", "source_size", "target", F.coalesce("unit", F.lit(1.0)).alias("unit"), F.lit(0.0).alias("x"),
        (-750 * F.coalesce(F.col("unit") / F.col("least"), F.lit(1.0))).alias("low"), (math.log(most) * F.coalesce(F.col("unit") / F.col("least"), F.lit(1.0))).alias("high"),
        ((F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size"))).alias("done"),
    )
    state = cut(state)
    tilt = F.col("x") * F.col("size") / F.col("unit")
    rate = F.least(F.lit(float(most)), F.exp(F.least(tilt, F.lit(700.0))))
    for step_number in range(STEPS + 1):
        if state.where(~F.col("done")).isEmpty():
            break
        if step_number == STEPS:
            raise RuntimeError(f"mixing: multipliers not found in {STEPS} steps")
        open_ = state.where(~F.col("done")).select("key", "unit", "x")
        moved = (
            _with_sources(histogram.where("size > 0"), open_, count)
            .select("key", (F.col("n") * F.col("size") * rate).alias("words"), F.when(rate < most, F.col("n") * F.col("size") * rate * F.col("size") / F.col("unit")).otherwise(0.0).alias("slope"))
            .groupBy("key").agg(F.sum("words").alias("words"), F.sum("slope").alias("slope"))
        )
        gap = F.log(F.greatest(F.col("words"), F.lit(1e-300)) / F.col("target"))
        low, high = F.when(gap < 0, F.col("x")).otherwise(F.col("low")), F.when(gap > 0, F.col("x")).otherwise(F.col("high"))
        step = F.col("x") - F.when(F.col("slope") > 0, gap * F.col("words") / F.col("slope"))
        inside = (step > low) & (step < high)
        near = F.abs(gap) < NEAR
        following = F.when(near, F.col("x")).when(inside, step).otherwise((low + high) / 2)
        fresh = _with_sources(moved, state.where(~F.col("done")), count).select("key", "source_size", "target", "unit", following.alias("x"), low.alias("low"), high.alias("high"), near.alias("done"))
        state = cut(state.where("done").unionByName(fresh))
    return state.select("key", "source_size", "target", (F.round("x", 9) / F.col("unit")).alias("m"))


def _shifts(rated: DataFrame, count: int) -> DataFrame:
    """The shift of each source: ``rated`` has key, target, size, whole (copies without the extra one) and flip, the shift
    above which a document gets its extra copy (null if it never does)."""
    fixed = rated.groupBy("key").agg(F.max("target").alias("target"), F.sum(F.col("size") * F.col("whole")).alias("sure"))

    def crossing(rows: DataFrame, base: DataFrame, low: Column, width: Column) -> DataFrame:
        """The bin of each source in which its words pass the target; one row for each (source, bin) is ranked."""
        binned = rows.groupBy("key", F.least(F.greatest(F.floor((F.col("flip") - low) / width * BINS), F.lit(0)), F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("key").orderBy("bin"))
        placed = _with_sources(binned.withColumn("upto", running), base.select("key", "target", "sure"), count)
        within = placed.where(F.col("sure") + F.col("upto") <= F.col("target")).groupBy("key").agg(F.max("bin").alias("full"), F.max("upto").alias("taken"))
        return base.select("key", "target", "sure", "low").join(within, "key", "left").select("key", "target", (F.col("sure") + F.coalesce("taken", F.lit(0))).alias("sure"), (F.col("low") + (F.coalesce("full", F.lit(-1)) + 1) * width / BINS).alias("low"))

    flips = rated.where(F.col("flip").isNotNull() & (F.col("size") > 0)).select("key", "flip", "size")
    first = cut(crossing(flips, fixed.withColumn("low", F.lit(-1.0)), F.lit(-1.0), F.lit(2.0)))
    width = 2.0 / BINS
    inside = _with_sources(flips, first.select("key", "low"), count).where((F.col("flip") >= F.col("low")) & (F.col("flip") < F.col("low") + width))
    second = crossing(inside, first, F.col("low"), F.lit(width))
    # Words taken stay at or below the target: a source misses it by the documents of one bin of the second pass at most.
    return second.select("key", F.col("low").alias("shift"))


def _sources(docs: DataFrame, doc_id: str, text: str, source: str, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Sizes of the documents (doc_id, source, size, key), and the plan of each source (key, source_size, target, m, shift)
    with its number of rows. Texts are read once, by the sizes."""
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")).withColumn("key", _key(F.col("source"))), "sizes")
    histogram = written(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    wanted = cut(targets(sized, most))
    count = wanted.count()
    found = cut(multipliers(histogram, wanted, count, most))
    shifts = _shifts(_rated(_with_sources(sized, found, count), most), count)
    return sized, cut(found.join(shifts, "key")), count


def _rated(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (doc_id, size, key and the plan of its source) with rate, whole and flip."""
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("m") * F.col("size"), F.lit(700.0)))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), "doc_id", "size", "key"), 12) / F.lit(float(1 << 52))
    return rows.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("flip", F.when(F.col("rate") < most, draw - (F.col("rate") - F.col("whole"))))


def _rounded(rows: DataFrame, plan: DataFrame, count: int, most: int) -> DataFrame:
    """``rows`` (doc_id, size, key) with the plan of their source, rate and copies: a function of these columns alone."""
    rated = _rated(_with_sources(rows, plan, count), most)
    return rated.withColumn("copies", (F.col("whole") + F.coalesce((F.col("flip") < F.col("shift")).cast("int"), F.lit(0))).cast("int"))


def source_targets(docs: DataFrame, text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """One row for each source of ``docs``: source, n_docs, source_size (words) and target, as ``mix`` takes them. Null and
    empty texts have size 0, a null source is one of its own, a table without words has targets 0, an empty one no rows."""
    sized = docs.select(_key(F.col(source)).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    by_source = sized.groupBy("key", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    kept = cut(by_source)  # texts are read once, what follows has a row for each source
    return kept.select("key", "source", "n_docs").join(targets(kept, most), "key").select("source", "n_docs", "source_size", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """doc_id, source, size (words), source_size, target (both of the source), rate, copies and taken (copies times size)
    of each document: one row for each row of ``docs``, which gives no other columns.

    Null and empty texts have size 0, a null source is a source of its own; a source without words has target 0. Rows that
    repeat are documents each. An empty table gives an empty result. Copies are whole, between 0 and ``most``, depend on
    the document's id, size and source alone besides the source's totals, and add up to within about one document of
    the target of each source. Documents are read once; what follows works on their sizes.
    """
    sized, plan, count = _sources(docs, doc_id, text, source, most)
    rounded = _rounded(sized, plan, count, most)
    return rounded.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; columns and their names are unchanged, whatever they are.

    Copies follow from a row's doc_id, source and size and from its source's plan, so rows that are equal in these share
    one decision, and texts join nothing but the plan of the sources. Nulls, empty texts and the empty table are as in
    ``mix``; an empty text is taken as its rate says, at no cost in words.
    """
    _, plan, count = _sources(docs, doc_id, text, source, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), _key(F.col(source).cast("string")).alias("key"), n_words(F.col(text)).alias("size"))
    taken = _rounded(rows, plan, count, most).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
