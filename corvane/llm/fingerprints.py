"""Document fingerprints: an exact digest of the canonical text, in DataFrame operations alone.

The canonical text is NFKC-normalised, case-folded and has its white space folded to single spaces. Its fingerprint is two
seeded xxhash64 values, 128 bits. Texts that share a fingerprint are compared byte by byte; should two differ, their
fingerprints get a SHA-256 of the canonical text behind them, so that equal fingerprints always mean equal canonical texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import unused, written

#: Documents of a range of ids, about, and ranges at most.
RANGE_ROWS, RANGES = 1000, 65_536
#: Repeated fingerprints up to which their table is broadcast (16 bytes each as text of 32); beyond it the join shuffles.
BROADCAST_FINGERPRINTS = 1_000_000
#: Parts of a repeated fingerprint's rows in a join that shuffles.
SALTS = 64


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    name = F.lit("com.ibm.icu.text.Normalizer")
    nfkc = lambda x: F.java_method(name, F.lit("compose"), x, F.lit(True))
    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(whole), F.lit(True)))
    # Of ASCII alone, all of that changes the capital letters only.
    plain = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(folded)
    return F.trim(F.regexp_replace(plain, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash64 as 32 hexadecimal digits."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(half("first half"), half("second half"))


def _fingerprint(canon: Column, collided: list[str]) -> Column:
    d = digest(canon)
    return F.when(d.isin(collided), F.concat(d, F.lit("-"), F.sha2(canon, 256))).otherwise(d) if collided else d


def collisions(docs: DataFrame, prints: DataFrame, text: str = "text", column: str = "fingerprint") -> list[str]:
    """Fingerprints of ``prints`` that different canonical texts of ``docs`` share: expected to be none at all.

    Only texts whose fingerprint occurs twice are compared, by the least and the greatest of each group's texts, so that
    a group of any size is one partial aggregate a task.
    """
    repeated = written(prints.groupBy(column).count().where("count > 1").select(F.col(column).alias("digest")), "repeated")
    few = repeated.count() <= BROADCAST_FINGERPRINTS
    canon = docs.select(canonical(F.col(text)).alias("canon")).withColumn("digest", digest(F.col("canon")))
    twice = canon.join(F.broadcast(repeated) if few else repeated, "digest", "left_semi")
    differing = twice.groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b")
    return [r["digest"] for r in differing.select("digest").collect()]


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; equal canonical texts, and they alone, have equal ones. Null counts as empty. Rows and
    other columns stay; an input column named ``fingerprint`` gives way."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "fingerprint"])
    canon = unused(kept, "canon")
    made = kept.withColumn(canon, canonical(F.col(text)))
    collided = collisions(docs, made.select(digest(F.col(canon)).alias("fingerprint")), text)
    return made.withColumn("fingerprint", _fingerprint(F.col(canon), collided)).drop(canon)


def with_following(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in descending order of ids, null last; after the last
    comes the first. A table of one row follows itself; rows that share an id follow each other in order of their texts.

    Ids are dealt into ranges by their quantiles, each range is one window, and the first row of a range also stands,
    marked, at the end of the range before it. Texts are shuffled once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    count = rows.select("doc_id").count()
    ranges = max(1, min(RANGES, math.ceil(count / range_rows)))
    asked = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.select(F.percentile_approx(place, F.array(*map(F.lit, asked)), F.lit(100_000)).alias("q")).first()["q"] or [])) if asked else []
    side = max(1, math.isqrt(len(bounds)))
    fine = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    below = lambda listed: f"size(filter({listed}, b -> b <= place_))"
    literal = lambda xs: "array(" + ",".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in xs) + ")"
    if bounds:
        # Two steps: which group of bounds, then which bound of it.
        coarse = f"greatest({below(literal([g[0] for g in fine]))}, 1)"
        nth = f"({coarse} - 1) * {side} + {below(f'element_at(array({",".join(map(literal, fine))}), {coarse})')}"
    else:
        nth = "0"
    dealt = rows.withColumn("place_", place).withColumn("range_", F.expr(nth).cast("int"))
    # One row for each range: where it begins, going down, and which range comes before it.
    heads = sorted((r["range_"], r["head"]) for r in dealt.groupBy("range_").agg(F.max("place_").alias("head")).collect())
    target = {h: heads[(i + 1) % len(heads)][0] for i, (_, h) in enumerate(heads)}
    spark = docs.sparkSession
    marks = spark.createDataFrame([(h, t) for h, t in target.items()], "place_ long, mark_ int")
    marked = dealt.join(F.broadcast(marks), "place_", "left")  # at most RANGES rows
    stands = F.when(F.col("mark_").isNull(), F.array(F.struct(F.col("range_").alias("r"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.col("range_").alias("r"), F.lit(False).alias("copy")), F.struct(F.col("mark_").alias("r"), F.lit(True).alias("copy"))))
    spread = marked.select("doc_id", "text", "place_", F.explode(stands).alias("at_")).select("doc_id", "text", "place_", "at_.r", "at_.copy")
    order = Window.partitionBy("r").orderBy("copy", F.desc("place_"), "text")
    return spread.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit(""))).where(~F.col("copy")).select("doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and group_id, the least doc_id of its fingerprint.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document's. An
    exact digest knows likeness 1 and 0 only; it is taken from the canonical texts, byte by byte. Null counts as empty.
    """
    pairs = with_following(docs, doc_id, text)

    def made(collided: list[str]) -> DataFrame:
        whole = pairs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "next_text").withColumn("n_chars", F.char_length("text").cast("long"))
        half = F.floor(F.col("n_chars") / 2).cast("int")
        edited = whole.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
        canon = edited.select("doc_id", "n_chars", "edited", canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("ce"), canonical(F.col("next_text")).alias("cn"))
        return canon.select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _fingerprint(F.col("c"), collided).alias("fingerprint"), _fingerprint(F.col("ce"), collided).alias("edited_fingerprint"),
            (F.col("c") == F.col("ce")).cast("double").alias("near_edited"), (F.col("c") == F.col("cn")).cast("double").alias("near_next"),
        )

    prints = written(made([]), "fingerprints")
    collided = collisions(docs, prints, text)
    if collided:
        prints = written(made(collided), "fingerprints")
    return _grouped(prints).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")


def _grouped(prints: DataFrame, most: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """``prints`` with group_id, the least doc_id of the row's fingerprint. Only repeated fingerprints are joined: by a
    broadcast up to ``most`` of them, counted; beyond it in SALTS parts of each, so that no group meets in one task."""
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
    repeated = written(least.where("c > 1").select("fingerprint", "least"), "groups")
    if repeated.count() <= most:
        joined = prints.join(F.broadcast(repeated), "fingerprint", "left")
    else:
        salted = repeated.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = prints.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALTS)).cast("int")).join(salted, ["fingerprint", "salt_"], "left")
    return joined.withColumn("group_id", F.coalesce("least", "doc_id"))
