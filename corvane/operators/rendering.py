"""Documents as structured HTML: reflowed lines, highlights, classes of structural units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

MOST_CHARS, SNIPPET = 400_000, 260

# Fixed patterns of the legal texts that the defaults are for.
OPENS = r"\A(Chương\s+[IVXLCDM\p{Nd}]|Điều\s+\p{Nd}|Mục\s+\p{Nd}|Phần\s+[IVXLCDM\p{Nd}]|\p{Nd}+\.\s|[a-zđ]\)\s|[-+*]\s)"
SEPARATOR = r"\A[-_=–—\s.]+\z"
#: Of a line's last two characters: a search in the whole line would begin anew at each of its characters.
ENDS = r"""[.;:!?]["')\]]?\z"""
UNITS = ((r"\AChương\s+[IVXLCDM\p{Nd}]", "<h2>", "</h2>"), (r"\AMục\s+\p{Nd}", "<h4>", "</h4>"), (r"\A\p{Nd}+\.\s", '<p class="khoan">', "</p>"), (r"\A[a-zđ]\)\s", '<p class="diem">', "</p>"))
HEADING = r"\AĐiều\s+(\p{Nd}+[a-zđ]?)"


def reflow(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines (keys, line_no, line) of each text: stripped, blank and separator lines left out, and a line joined to the one
    before unless it opens a structural unit or that one ends a sentence."""
    raw = docs.select(*keys, F.posexplode(F.split(T.text_of(text), "\n")).alias("i", "raw"))
    kept = raw.select(*keys, "i", T.strip("raw").alias("s")).where((F.col("s") != "") & ~F.col("s").rlike(SEPARATOR))
    order = Window.partitionBy(*keys).orderBy("i")
    before = F.lag("s").over(order)
    grouped = kept.withColumn("b_", before).withColumn("g_", F.sum(F.when(F.col("b_").isNull() | F.col("s").rlike(OPENS) | F.right("b_", F.lit(2)).rlike(ENDS), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, F.col("g_").cast("int").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ").alias("line"))


def highlight(escaped: Column, terms: list[str]) -> Column:
    """Marks whole occurrences of ``terms``, the longest first, in text that is escaped already."""
    if not terms:
        return escaped
    quoted = [T.quoted(t) for t in sorted(terms, key=lambda t: (-len(t), t))]
    # At most places the first letter tells that no term begins there, before anything looks at what stands around.
    begins = f"(?=[{''.join(sorted({T.quoted(t[0]) for t in terms}))}])" if all(terms) else ""
    return F.regexp_replace(escaped, f"(?iu){begins}{T.NOT_AFTER_WORD}({'|'.join(quoted)}){T.NOT_BEFORE_WORD}", "<mark>$1</mark>")


def anchor(label: Column) -> Column:
    number = F.regexp_extract(label, HEADING, 1)
    return F.when(number != "", F.concat(F.lit("dieu-"), number)).otherwise("")


def structured(lines: DataFrame, keys: list[str], terms: list[str] | None = None) -> DataFrame:
    """``lines`` (keys, line_no, line) with ``unit`` (tag) and ``html``; the first line of an article number has its anchor."""
    shown = highlight(T.escape_html("line"), terms or [])
    named = lines.withColumn("a_", anchor(F.col("line")))
    first = F.row_number().over(Window.partitionBy(*keys, "a_").orderBy("line_no")) == 1
    opening = F.when((F.col("a_") != "") & F.col("first_"), F.concat(F.lit("<h3 id='"), F.col("a_"), F.lit("'>"))).otherwise("<h3>")
    html, unit = F.concat(F.lit("<p>"), shown, F.lit("</p>")), F.lit("p")
    for pattern, start, end in reversed(UNITS):
        html = F.when(F.col("line").rlike(pattern), F.concat(F.lit(start), shown, F.lit(end))).otherwise(html)
        unit = F.when(F.col("line").rlike(pattern), F.lit(start.strip("<>"))).otherwise(unit)
    heading = F.col("line").rlike(HEADING) & ~F.col("line").rlike(UNITS[0][0])
    marked = named.withColumn("first_", first)
    return marked.withColumn("html", F.when(heading, F.concat(opening, shown, F.lit("</h3>"))).otherwise(html)).withColumn("unit", F.when(heading, F.lit("h3")).otherwise(unit)).drop("a_", "first_")


def focused(text: Column, focus: str = "", most: int = MOST_CHARS) -> tuple[Column, Column]:
    """A text of more than ``most`` characters from a quarter of that before the line that begins with ``focus``; and
    whether it was cut."""
    body = T.clean(text)
    at = F.lit(1)
    if focus:
        found = F.regexp_instr(body, F.lit("(?md)^" + T.whole_word(focus).removeprefix(T.NOT_AFTER_WORD)))
        at = F.greatest(F.lit(1), F.when(found > 0, found - most // 4).otherwise(1))
    return F.when(F.length(body) > most, F.substring(body, at, F.lit(most))).otherwise(body), F.length(body) > most


def render(docs: DataFrame, terms: list[str] | None = None, focus: str = "") -> DataFrame:
    """(doc_id, html, truncated, anchor) of ``docs`` (doc_id, passage)."""
    body, cut = focused(F.col("passage"), focus)
    base = docs.select("doc_id", body.alias("text"), cut.alias("truncated"))
    lines = structured(reflow(base, ["doc_id"]), ["doc_id"], terms)
    joined = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "html"))), lambda x: x["html"]), "\n").alias("html"))
    return base.select("doc_id", "truncated").join(joined, "doc_id", "left").select("doc_id", F.coalesce("html", F.lit('<p class="empty"></p>')).alias("html"), "truncated", anchor(F.lit(focus)).alias("anchor"))


def search_results(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a search shows of ranked documents: title, path, rounded score and a reflowed snippet of each best chunk."""
    best = ranked.join(chunks.select(F.col("chunk_idx").alias("best_chunk"), "path", "n_words", "tier", "text"), "best_chunk")
    body = best.select("qid", "rnk", F.regexp_replace("text", r"\A[^\n]*\n?", "").alias("text"))
    lines = reflow(body, ["qid", "rnk"])
    shown = lines.groupBy("qid", "rnk").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " "), F.lit(SNIPPET)).alias("snippet"))
    head = F.substring_index(F.substring_index("text", "\n", 1), " > ", 1)
    return best.join(shown, ["qid", "rnk"], "left").select("qid", "rnk", "doc_id", "path", F.round("score", 2).alias("score"), head.alias("title"), "n_words", "tier", F.coalesce("snippet", F.lit("")).alias("snippet"), "n_chunk")


def search_chunks(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """``search_results`` of ranked chunks (qid, chunk_idx, doc_id, score, rnk), one row for each chunk."""
    return search_results(top.select("qid", "doc_id", "score", "rnk", F.col("chunk_idx").alias("best_chunk"), F.lit(1).alias("n_chunk")), chunks)


def document_view(requested: DataFrame, docs: DataFrame, terms: list[str] | None = None, focus: str = "") -> DataFrame:
    """(doc_id, found, name, link, html, truncated, anchor) of each document asked for: ``requested`` has doc_id, ``docs``
    doc_id, name, link and passage. Documents that are not there have ``found`` false and nulls."""
    asked = requested.select("doc_id").distinct()
    held = docs.join(asked, "doc_id", "left_semi")
    shown = held.select("doc_id", T.title("name", "link").alias("name"), "link").join(render(held, terms, focus), "doc_id")
    return asked.join(shown.withColumn("found", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"), "name", "link", "html", "truncated", "anchor")
