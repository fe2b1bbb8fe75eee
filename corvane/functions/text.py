"""Text expressions. All are built-in column functions, so that they stay in generated code next to the scan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters, digits and underscores of any script. Java's \w knows ASCII alone.
TOKEN = r"[\p{L}\p{N}_]+"
#: White space of any script, with the separators that Java's \s leaves out.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same characters one by one, and a run of any others: printable ASCII is told first, as properties are slow.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
WORD = r"[!-~[^\s\x1c-\x1f\x85\p{Z}]]+"
#: Characters that make a word for boundary tests: explicit, as \b depends on the Java version.
NOT_AFTER_WORD, NOT_BEFORE_WORD = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def text_of(c: Column | str) -> Column:
    """Null counts as empty everywhere."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    return F.trim(text_of(c), F.lit(SPACES))


def tokens(c: Column | str) -> Column:
    """Lower-cased tokens in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(TOKEN), F.lit(0))


def upper(c: Column | str) -> Column:
    """Upper case letter by letter: one without an upper case of a single letter (such as the German sharp s) stays."""
    return F.array_join(F.transform(F.split(text_of(c), ""), lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(x)), "")


def words(c: Column | str) -> Column:
    """Runs of anything but white space, in order."""
    return F.filter(F.split(text_of(c), rf"{SPACE}+"), lambda w: w != "")


def n_words(c: Column | str) -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD))


def clean(c: Column | str) -> Column:
    """Without carriage returns; runs of blanks become one blank, runs of line ends one line end; stripped."""
    # Most texts have nothing to replace: a search for bytes tells so sooner than a pattern does.
    where_has = lambda t, signs, f: F.when(reduce(Column.__or__, [F.contains(t, F.lit(s)) for s in signs]), f(t)).otherwise(t)
    plain = let(F.replace(text_of(c), F.lit("\r"), F.lit("")), lambda t: where_has(t, ("  ", "\t"), lambda x: F.regexp_replace(x, r"[ \t]+", " ")))
    return strip(let(plain, lambda t: where_has(t, ("\n\n",), lambda x: F.regexp_replace(x, r"\n{2,}", "\n"))))


def title(name: Column | str, link: Column | str) -> Column:
    """The name, or the slug of a link that ends in a number and .aspx; hyphens become blanks; empty if neither is there."""
    slug = F.regexp_extract(text_of(link), r"/([^/]+?)-\p{Nd}+\.aspx", 1)
    return strip(F.replace(F.when(F.length(text_of(name)) > 0, text_of(name)).otherwise(slug), F.lit("-"), F.lit(" ")))


def snippet(c: Column | str, size: int) -> Column:
    """The text behind its first line, on one line, cut to ``size`` characters."""
    body = F.regexp_replace(text_of(c), r"\A[^\n]*\n?", "")
    return F.left(F.replace(body, F.lit("\n"), F.lit(" ")), F.lit(size))


def escape_html(c: Column | str) -> Column:
    out = text_of(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def quoted(term: str) -> str:
    """A pattern for ``term`` itself."""
    return "".join("\\" + ch if not (ch.isalnum() or ch.isspace() or ch == "_") else ch for ch in term)


def whole_word(term: str) -> str:
    """A pattern for ``term`` between non-word characters."""
    return NOT_AFTER_WORD + quoted(term) + NOT_BEFORE_WORD
