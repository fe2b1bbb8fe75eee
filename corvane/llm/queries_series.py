"""Query of the rolling medians: op12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import rolling
from corvane.llm.common import table


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median and the deviation of the 15 minutes up to every click, within clicks of its kind."""
    return rolling.click_medians(table(spark, sf_dir, "clicks"))


QUERIES = {"op12_rolling_median": op12_rolling_median}
ORACLES = {
    "op12_rolling_median": """WITH timed AS (SELECT click_id, min({'ts': ts, 'kind': kind, 'c': CAST(floor(100.0::DOUBLE * value + 0.5::DOUBLE) AS BIGINT)}) AS r FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
once AS (SELECT click_id, r.ts AS ts, r.kind AS kind, r.c AS c FROM timed),
held AS (SELECT *, list(c) FILTER (WHERE c IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 899999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS w FROM once),
sorted AS (SELECT *, list_sort(coalesce(w, [])) AS s FROM held),
mid AS (SELECT *, len(s)::BIGINT AS n, CASE WHEN len(s) > 0 THEN s[(len(s) + 1) // 2] + s[len(s) // 2 + 1] END AS median2 FROM sorted),
dev AS (SELECT *, list_sort(list_transform(s, lambda x: abs(2 * x - median2))) AS d FROM mid),
both_ AS (SELECT *, CASE WHEN n > 0 THEN d[(n + 1) // 2] + d[n // 2 + 1] END AS mad4 FROM dev)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * c - median2) > 2 * mad4 AS far FROM both_""",
}
