"""Hard negatives and nearest neighbours against brute force, and on odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactory.llm.hard_negatives import mine_hard_negatives
from redactory.llm.permutation_index import InvertedFiles, first, fit_cosines, fit_pivots, nearest_neighbours, sampled

SCHEMA = "vec_id long, label long, embedding array<double>, score string, rank string, uid string, s string, norm string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def vectors(n, width=8, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * np.exp(spread * rng.normal(size=(n, 1)))
    return [(i, int(rng.integers(0, 4)), [float(v) for v in row]) for i, row in enumerate(x)]


def negatives_by_hand(rows, is_anchor, k=5, m=3, low=50, high=95, scale=256.0):
    kept = []
    for i, label, v in rows:
        if None in (i, label) or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, label, [max(-(1 << 26), min(1 << 26, math.floor(scale * x))) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (i, label, v) in enumerate(kept):
        if not is_anchor(i):
            continue
        scored = [(-score(v, w), j, other) for b, (j, other, w) in enumerate(kept) if b != at]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:k]:
            fits = sorted((s, n) for s, n, other in scored if other != label and low * -p <= 100 * -s <= high * -p)[:m]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 5 == 0, **kw).collect())


ODD = [
    (None, 1, [1.0] * 8), (200, None, [1.0] * 8), (205, 1, None), (210, 1, [1.0, None] + [0.0] * 6), (215, 1, [float("nan")] * 8), (220, 1, [float("inf")] * 8), (225, 1, []), (230, 1, [0.0] * 8),
    (235, 2, [0.5] * 3), (240, 2, [1e30] * 8), (245, 2, [-1e30] * 8), (250, 3, [0.1] * 8), (250, 3, [0.1] * 8), (250, 2, [0.1] * 8), (255, 3, [0.1] * 8), (256, 1, [0.09] * 8),
]


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_negatives_equal_brute_force_in_one_cell_and_in_many(spark, spread):
    rows = vectors(150, seed=3, spread=spread) + ODD
    want = negatives_by_hand(rows, lambda i: i % 5 == 0)
    assert len(want) > 100
    assert mined(table(spark, rows)) == want
    assert mined(table(spark, rows), stripe_rows=40, block_rows=7) == want


def test_ties_go_to_the_smaller_id_and_few_rows_give_what_there_is(spark):
    same = [(i, 0, [1.0, 0.0]) for i in range(8)] + [(i, 1, [0.75, 0.0]) for i in (20, 19, 18, 17)]
    assert mined(table(spark, same)) == negatives_by_hand(same, lambda i: i % 5 == 0)
    few = [(0, 0, [1.0]), (1, 0, [1.0]), (2, 1, [0.6])]
    assert mined(table(spark, few)) == [(0, 1, 1, 2, 65536, 39168)]


def test_scores_beyond_doubles_stay_exact(spark):
    big = [(i, i % 2, [200_000.0 - i / 256, 200_000.0 + i / 256, 3.0 + i]) for i in range(40)]
    assert mined(table(spark, big), low=10, high=100) == negatives_by_hand(big, lambda i: i % 5 == 0, low=10, high=100)


def test_norm_bounds_end_a_cell_early(spark, monkeypatch):
    """Short vectors cannot reach any window: their buckets are never scored."""
    from redactory.llm import hard_negatives as h

    seen = []
    monkeypatch.setattr(h, "_scores", lambda a, b, bound, f=h._scores: seen.append(len(b)) or f(a, b, bound))
    import pyarrow as pa

    def rows(v, label, first):
        v = np.floor(256 * np.asarray(v)).astype(np.int32)
        return [(first + i, first + i, label, x.tobytes(), float(np.linalg.norm(x.astype(float)))) for i, x in enumerate(v)]

    long_rows = rows(np.full((2 * h.BUCKET_ROWS, 4), 1.0), 0, 0)
    short = rows(np.full((8 * h.BUCKET_ROWS, 4), 0.01), 1, 10_000)
    cell = pa.Table.from_pylist([dict(zip(h._ROWS.names, r)) for r in long_rows + short], schema=h._ROWS)
    windows = pa.array([[{"no": 1, "lo": 200_000, "hi": 250_000}]] * 4, pa.list_(pa.struct([("no", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])))
    search = {}
    monkeypatch.setattr(h, "in_cells", lambda a, b, s, j, fn, schema: search.setdefault("fn", fn) and spark.range(0).selectExpr("id AS uid", "1 AS no", "1L AS negative_score", "1L AS negative_id", "1L AS negative_uid"))
    h.best_negatives(None, None, 4, 3, 1, 1)
    list(search["fn"](cell.slice(0, 4).append_column("windows", windows), cell))
    assert sum(seen) <= 2 * h.BUCKET_ROWS


def test_empty_tables_of_vectors(spark):
    empty = table(spark, [])
    assert mined(empty) == []
    assert nearest_neighbours(empty, F.col("vec_id") % 5 == 0).collect() == []
    nothing = table(spark, [(1, 1, None), (2, 1, []), (3, 1, [0.0, 0.0])])
    assert nearest_neighbours(nothing, F.col("vec_id") % 5 == 0).collect() == []


def neighbours_by_hand(rows, is_query, k):
    kept = [(i, np.array(v, float)) for i, _, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(kept):
        if is_query(i):
            out[at] = (i, sorted((-float(v @ w), j) for b, (j, w) in enumerate(kept) if b != at)[:k])
    return out


def test_neighbours_of_few_rows_are_exact(spark):
    rows = vectors(60, seed=5) + [r for r in ODD if r[2] is None or len(r[2]) in (0, 8)]
    got = nearest_neighbours(table(spark, rows), F.col("vec_id") % 5 == 0, k=100).collect()
    want = sorted((i, rank, j) for i, found in neighbours_by_hand(rows, lambda i: i % 5 == 0, 100).values() for rank, (_, j) in enumerate(found, 1))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == want
    assert all(math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall_of_neighbours(spark, spread):
    """Also where norms differ by factors, and in several stripes and blocks."""
    rows = vectors(6000, width=32, seed=11, spread=spread)
    df = spark.createDataFrame([(i, v) for i, _, v in rows], "vec_id long, embedding array<double>")
    x = np.array([v for _, _, v in rows])
    for stripe_rows, block_rows in ((8192, 16384), (1500, 100)):
        got = nearest_neighbours(df, F.col("vec_id") % 40 == 0, stripe_rows=stripe_rows, block_rows=block_rows).toPandas()
        recall = []
        for q, found in got.groupby("query_id"):
            s = x @ x[q]
            s[q] = -np.inf
            best = np.lexsort((np.arange(len(s)), -s))[:20]
            found = found.sort_values("rank")
            assert list(found["rank"]) == list(range(1, 21)) and q not in set(found["vec_id"])
            assert np.allclose(found["score"], s[found["vec_id"]], rtol=1e-12) and list(found["score"]) == sorted(found["score"], reverse=True)
            recall.append(len(set(best) & set(found["vec_id"])) / 20)
        assert len(recall) == 150 and np.mean(recall) >= 0.9, np.mean(recall)


def test_footrule_of_inverted_files_equals_that_of_the_orders():
    random.seed(4)
    pivots, posted = 12, 5
    orders = np.array([random.sample(range(pivots), posted) for _ in range(200)])
    files = InvertedFiles(orders, pivots)
    asked = np.array(random.sample(range(pivots), 4))
    far = [(sum(abs((list(o).index(p) if p in o else posted) - i) for i, p in enumerate(asked)), r) for r, o in enumerate(orders)]
    assert set(first(files.gains(asked), 30)) == {r for _, r in sorted(far)[:30]}


def test_pivots_are_opposite_pairs(spark):
    x = sampled(spark.createDataFrame([(i, v) for i, _, v in vectors(3, width=6)], "vec_id long, embedding array<double>"), 6)
    p = fit_pivots(x)
    assert (np.diff(fit_cosines(x, p, 4, 3)) > 0).all()
    assert p.shape == (12, 6) and np.allclose(p[:6], -p[6:]) and np.allclose(p[:6] @ p[:6].T, np.eye(6))
