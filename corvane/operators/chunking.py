"""Structural chunking: articles, clauses, fixed windows.

A text is cut by putting a mark before every heading and splitting at the marks, which keeps the left-to-right matching of
the pattern. Pieces are arrays in the document's row: merging, cutting and numbering are expressions, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.text import let

TARGET_WORDS, MIN_WORDS, WINDOW_WORDS, OVERLAP, HEAD_WORDS = 350, 32, 256, 0.25, 30

#: What chunks depend on besides their documents.
OPTIONS = {"version": 2, "target": TARGET_WORDS, "min": MIN_WORDS, "window": WINDOW_WORDS, "overlap": OVERLAP, "head": HEAD_WORDS}

#: Fixed patterns of the legal texts that the defaults are for: article and clause headings at line starts.
#: What a text without articles has nowhere.
ARTICLE_SIGN = "Điều"
ARTICLE = rf"(?md)^{T.SPACE}*(Điều{T.SPACE}+\p{{Nd}}+[a-zđ]?){T.SPACE}*[.:]?"
CLAUSE = rf"(?md)^{T.SPACE}*(\p{{Nd}}+)\.{T.SPACE}"
#: Fixed labels.
PREAMBLE, CLAUSE_LABEL, PART_LABEL, SUBPART_LABEL, TITLE_ONLY = "Phần mở đầu", "Khoản ", "Phần ", "phần ", "title-only"
#: A private character; "a" behind it stands for the character itself, "b" for a place to split at.
_MARK = "\ue000"

#: Chunk numbers of a document lie in a range of their own, so that no global sort is needed to number chunks.
CHUNKS_PER_DOC = 1 << 20


def marked_pieces(text: Column, pattern: str) -> Column:
    """What stands before the first match of ``pattern``, then a piece from each match to the next."""
    escaped = F.replace(text, F.lit(_MARK), F.lit(_MARK + "a"))
    pieces = F.split(F.regexp_replace(escaped, pattern, _MARK + "b$0"), _MARK + "b")
    return F.transform(pieces, lambda p: F.replace(p, F.lit(_MARK + "a"), F.lit(_MARK)))


def windows(text: Column, window: int = WINDOW_WORDS, overlap: float = OVERLAP) -> Column:
    """Windows of words: the text itself if it has no more than ``window``, else every ``window * (1 - overlap)`` words one
    of single-spaced words, until one reaches the end; a last one below MIN_WORDS is left out."""
    return F.transform(_counted_windows(text, window, overlap), lambda w: w["text"])


def _counted_windows(text: Column, window: int = WINDOW_WORDS, overlap: float = OVERLAP) -> Column:
    """An array of (text, n), the ``windows`` with their numbers of words."""
    stride = max(1, int(window * (1 - overlap)))

    def cut(listed: Column) -> Column:
        n = F.size(listed)
        # The last start is the first one whose window reaches the end.
        last = F.greatest(F.ceil((n - window) / F.lit(stride)), F.lit(0)).cast("int") * stride
        starts = F.filter(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: (i == 0) | (n - i >= MIN_WORDS))
        many = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(listed, i + 1, F.lit(window)), " ").alias("text"), F.least(n - i, F.lit(window)).alias("n")))
        return F.when(n <= window, F.array(F.struct(text.alias("text"), n.alias("n")))).otherwise(many)

    return let(T.words(text), cut)


def merged_label(first: Column, last: Column) -> Column:
    numbered = r"^(.*?)(\p{Nd}+)$"
    stem = lambda c: F.regexp_extract(c, numbered, 1)
    number = lambda c: F.regexp_extract(c, numbered, 2)
    alike = (number(first) != "") & (number(last) != "") & (stem(first) == stem(last))
    return F.when(first == last, first).when(alike, F.concat(stem(first), number(first), F.lit("-"), number(last))).otherwise(F.concat(first, F.lit(" + "), last))


def merge_small(pieces: Column, least: int = MIN_WORDS) -> Column:
    """An array of (label, body, n: words) with small pieces appended to the one before; a small first group joins the next."""

    def sized(p: Column) -> Column:
        return F.struct(p["label"].alias("label"), p["body"].alias("body"), T.n_words(p["body"]).alias("n"))

    def grouped(p: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i)["n"] >= least))

        def joined(s: Column) -> Column:
            words = F.aggregate(F.slice(p, F.lit(1), F.get(s, F.lit(1))), F.lit(0), lambda n, x: n + x["n"])
            return F.when((F.size(s) > 1) & (words < least), F.concat(F.slice(s, 1, 1), F.slice(s, F.lit(3), F.size(s)))).otherwise(s)

        def whole(s: Column) -> Column:
            one = lambda g: F.struct(merged_label(F.get(g, F.lit(0))["label"], F.element_at(g, -1)["label"]).alias("label"), F.array_join(F.transform(g, lambda x: x["body"]), "\n").alias("body"), F.aggregate(g, F.lit(0), lambda n, x: n + x["n"]).alias("n"))
            return F.transform(s, lambda at, k: let(F.slice(p, at + 1, F.coalesce(F.get(s, k + 1), F.size(p)) - at), one))

        return let(let(starts, joined), whole)

    return F.when(F.size(pieces) > 0, let(F.transform(pieces, sized), grouped)).otherwise(F.array().cast("array<struct<label: string, body: string, n: int>>"))


def clauses(parts: Column) -> Column:
    """An array of (label, body) of an article's parts, cut at clauses; what stands before the first clause is glued to it."""
    head = T.strip(F.get(parts, F.lit(0)))

    def clause(raw: Column, i: Column) -> Column:
        body = T.strip(raw)
        return F.struct(F.concat(F.lit(CLAUSE_LABEL), F.regexp_extract(raw, CLAUSE, 1)).alias("label"), F.when((i == 0) & (head != ""), F.concat(head, F.lit("\n"), body)).otherwise(body).alias("body"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), clause)


def _piece(tier: int, path: Column, body: Column, n: Column | None = None) -> Column:
    """``n``: the body's number of words, if it is known."""
    return F.struct(F.lit(tier).alias("tier"), path.alias("path"), body.alias("body"), (T.n_words(body) if n is None else n).cast("int").alias("n"))


def _numbered(texts: Column, tier: int, label: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(texts, lambda w, i: _piece(tier, F.concat(label, (i + 1).cast("string")), body(w)))


def _of_article(a: Column) -> Column:
    """The pieces of an article: itself, or its clauses or windows below its heading if it is long."""

    def cut(heading: Column) -> Column:
        headed = lambda x: F.when(F.startswith(x, heading), x).otherwise(F.concat(heading, F.lit("\n"), x))
        sub = lambda label: F.concat(label, F.lit(" > " + SUBPART_LABEL))

        def part(c: Column) -> Column:
            label = F.concat(a["label"], F.lit(" > "), c["label"])
            return F.when(c["n"] <= TARGET_WORDS, F.array(_piece(2, label, headed(c["body"])))).otherwise(_numbered(windows(c["body"]), 2, sub(label), headed))

        parted = lambda parts: F.when(F.size(parts) >= 3, F.flatten(F.transform(merge_small(clauses(parts)), part))).otherwise(_numbered(windows(a["body"]), 2, sub(a["label"]), headed))
        return let(marked_pieces(a["body"], CLAUSE), parted)

    heading = T.strip(F.substring_index(a["body"], "\n", 1))
    return F.when(a["n"] <= TARGET_WORDS, F.array(_piece(1, a["label"], a["body"], a["n"]))).otherwise(let(heading, cut))


def chunk(docs: DataFrame) -> DataFrame:
    """Chunks of ``docs`` (doc_id, name, link, passage): doc_id, chunk_id, ordinal, tier, path, n_words, text.

    Tier 0 is a title without a text, tier 1 an article, tier 2 a part of a long article, tier 3 a window of a text without
    articles. A null or blank passage counts as empty; with no title either it gives no chunk. One pass over the documents.
    """
    base = docs.select("doc_id", T.title("name", "link").alias("title"), T.clean("passage").alias("body"))
    cut = base.withColumn("parts", F.when(F.contains("body", F.lit(ARTICLE_SIGN)), marked_pieces(F.col("body"), ARTICLE)).otherwise(F.array("body")))
    named = F.transform("parts", lambda raw, i: F.struct(F.when(i == 0, F.lit(PREAMBLE)).otherwise(F.regexp_extract(raw, ARTICLE, 1)).alias("label"), T.strip(raw).alias("body"), ((i > 0) | (T.n_words(raw) >= HEAD_WORDS)).alias("kept")))
    articles = merge_small(F.filter(named, lambda p: p["kept"]))
    bare = F.when(F.col("title") != "", F.array(_piece(0, F.lit(TITLE_ONLY), F.col("title"))))
    flat = F.transform(_counted_windows(F.col("body")), lambda w, i: _piece(3, F.concat(F.lit(PART_LABEL), (i + 1).cast("string")), w["text"], w["n"]))
    pieces = F.when(F.col("body") == "", bare).when(F.size("parts") == 1, flat).otherwise(F.flatten(F.transform(articles, _of_article)))
    # The outer form: for the other one Spark infers a filter that would compute the pieces twice.
    each = cut.select("doc_id", "title", pieces.alias("pieces")).select("doc_id", "title", F.posexplode_outer("pieces").alias("ordinal", "p")).where("p is not null")
    tier, path, body = F.col("p.tier"), F.col("p.path"), F.col("p.body")
    header = F.concat_ws(" > ", F.when((F.col("title") != "") & (tier > 0), F.col("title")), F.when((path != "") & (tier > 0), path))
    suffix = F.when(tier == 0, F.lit("t0")).otherwise(F.col("ordinal").cast("string"))
    return each.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), suffix).alias("chunk_id"), F.col("ordinal").cast("int").alias("ordinal"), tier.alias("tier"), path.alias("path"),
        F.col("p.n").alias("n_words"), F.when(header != "", F.concat(header, F.lit("\n"), body)).otherwise(body).alias("text"),
    )


def with_index(chunks: DataFrame) -> DataFrame:
    """``chunks`` with chunk_idx: ascending in doc_id and ordinal, without gaps inside a document. A document of more than
    2^20 chunks is an error: its numbers would be another one's."""
    number = F.col("doc_id").cast("long") * CHUNKS_PER_DOC + F.col("ordinal")
    wrong = F.raise_error(F.concat(F.lit(f"more than {CHUNKS_PER_DOC} chunks in document "), F.col("doc_id").cast("string"))).cast("long")
    return chunks.withColumn("chunk_idx", F.when(F.col("ordinal") < CHUNKS_PER_DOC, number).otherwise(wrong))


def tier_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tier").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_words").alias("n_words"))
