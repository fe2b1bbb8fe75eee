"""Rolling medians against sorted lists, on hand-made and given clicks."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries_series as Q
from corvane.llm import rolling
from tests.llm.sql import compare

W = rolling.WINDOW_US


def brute(rows, window=W):
    out = {}
    for i, k, t, c in rows:
        if t is None:
            continue
        w = sorted(x for _, kk, tt, x in rows if kk == k and tt is not None and x is not None and t - window < tt <= t)
        n = len(w)
        if not n:
            out[i] = (k, 0, None, None, None)
            continue
        m = w[(n + 1) // 2 - 1] + w[n // 2]
        d = sorted(abs(2 * x - m) for x in w)
        m4 = d[(n + 1) // 2 - 1] + d[n // 2]
        out[i] = (k, n, m, m4, None if c is None else 2 * abs(2 * c - m) > 2 * m4)
    return out


def made(seed, n=700):
    rnd = random.Random(seed)
    times = lambda: rnd.choice([None, rnd.randrange(-3 * 3600 * 10**6, 4 * 3600 * 10**6), W * rnd.randrange(-3, 9), 5 * 10**9, rnd.randrange(5 * 10**9, 5 * 10**9 + 10**8)])
    return [(i, rnd.choice(["a", "b", None]), times(), rnd.choice([None, rnd.randrange(-20, 60), rnd.randrange(-20, 60), 10**12])) for i in range(n)]


@pytest.mark.parametrize("dense", [1 << 17, 15])
def test_against_sorted_lists(spark, monkeypatch, dense):
    monkeypatch.setattr(rolling, "SLOT_ROWS", 3)  # slots of seconds where hours are dense
    rows = made(dense)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, series string, ts long, cents long, slot string")
    got = {r["id"]: (r["series"], r["n"], r["median2"], r["mad4"], r["far"]) for r in rolling.rolling_medians(df, dense_rows=dense).collect()}
    assert got == brute(rows)


def test_shorter_window_and_no_rows(spark):
    rows = made(5, 200)
    df = spark.createDataFrame(rows, "id long, series string, ts long, cents long")
    got = {r["id"]: (r["series"], r["n"], r["median2"], r["mad4"], r["far"]) for r in rolling.rolling_medians(df, window_us=1_000_000).collect()}
    assert got == brute(rows, 1_000_000)
    assert rolling.rolling_medians(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="window"):
        rolling.rolling_medians(df, window_us=W + 1)


def test_clicks_that_repeat_or_lack_values(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", 0.125), (1, "2024-01-01 00:00:00", "a", 0.125), (2, "2024-01-01 00:15:00", "a", 1.005), (3, "2024-01-01 00:14:59.999999", "a", None), (4, None, "a", 3.0), (5, "2024-01-01 00:14:59.999999", None, float("nan")), (None, "2024-01-01 00:00:01", "a", float("inf"))]
    clicks = spark.createDataFrame(rows, "click_id long, ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("id", F.lit("clash"))
    got = {r["click_id"]: tuple(r)[1:] for r in rolling.click_medians(clicks).collect()}
    assert got == {1: ("a", 1, 26, 0, False), 2: ("a", 1, 200, 0, False), 3: ("a", 1, 26, 0, None), 5: (None, 0, None, None, None), None: ("a", 1, 26, 0, None)}
    assert rolling.click_medians(clicks.where("false")).count() == 0


def test_time_without_a_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # 2:30 does not exist there on that day
        row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.000001' AS ts, TIMESTAMP_LTZ'2024-03-10 06:30:00 UTC' AS z")
        assert row.select(rolling.micros(row, "ts"), rolling.micros(row, "z")).first()[:] == (1710037800000001, 1710052200000000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_op12(spark):
    compare(spark, Q, "op12_rolling_median")
