"""Nearest neighbours against all distances, and the bounds that tiles prune by."""

import numpy as np
import pytest

from corvane.llm import nearest
from corvane.llm import queries_vectors as Q
from tests.llm.sql import compare


def distance(v, w):
    total = 0.0
    for a, b in zip(v, w, strict=True):  # sum() would compensate
        total += (a - b) * (a - b)
    return float(np.sqrt(total))


def brute(queries, candidates, k):
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = {}
    for q, v in queries:
        if q is not None and good(v):
            found = sorted((distance(v, w), c) for c, w in candidates if c is not None and c != q and good(w) and len(w) == len(v))
            for i, (d, c) in enumerate(found[:k]):
                out[q, i + 1] = (c, d)
    return out


def searched(spark, queries, candidates, k):
    frame = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, lane string")
    rows = nearest.nearest(frame(queries), frame(candidates), k).collect()
    assert len({(r["query_id"], r["rank"]) for r in rows}) == len(rows)
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}


@pytest.mark.parametrize("tile", [5, 2048])
def test_against_all_distances(spark, monkeypatch, tile):
    monkeypatch.setattr(nearest, "TILE_ROWS", tile)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(tile)
    vectors = rng.normal(size=(240, 6)) * np.exp(rng.normal(size=(240, 1)) * 3)
    vectors[40:110] = vectors[40]  # many copies: ties go to smaller ids
    vectors[110:130] = rng.integers(-2, 3, (20, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (306, [1.0, 2.0]), (307, [2.0, 2.0]), (308, [1e-320] * 6), (309, [1e200] * 6)]
    queries = [r for r in rows if r[0] is None or r[0] % 5 == 0 or r[0] > 299]
    assert searched(spark, queries, rows, 4) == brute(queries, rows, 4)


def test_few_candidates_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert searched(spark, rows, rows, 10) == brute(rows[:2] + rows[3:], rows[:2] + rows[3:], 10)
    assert searched(spark, rows, [], 3) == searched(spark, [], rows, 3) == {}
    with pytest.raises(ValueError, match="k = 0"):
        searched(spark, rows, rows, 0)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 3000)), rng.normal(size=(400, 3000)) * 10 ** rng.uniform(-3, 3, (400, 1))
    low, high = nearest.bounds(nearest.Codes(x), nearest.Codes(y))
    exact = np.array([[np.linalg.norm(a - b) for b in y] for a in x])
    assert (low <= exact).all() and (exact <= high).all() and ((high - low) / exact).max() < 0.03
    a, b = rng.integers(-127, 128, (9, 3000)).astype(np.int8), np.full((4, 3000), 127, np.int8)
    assert (nearest.products(a, b) == a.astype(np.int64) @ b.T.astype(np.int64)).all()


def test_op13(spark):
    compare(spark, Q, "op13_nearest")
