"""JSON recovery and inspection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recovered(c: Column, ddl: str) -> Column:
    """The text as a value of type ``ddl``: parsed whole, or from its first { to its last }; null if neither parses."""
    strict = F.when(F.try_parse_json(F.trim(c)).isNotNull(), F.from_json(F.trim(c), ddl))
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(strict, F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, ddl)))
