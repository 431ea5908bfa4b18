"""Angular filtering against a plain loop over all pairs."""

import math

import duckdb
import numpy as np
import pytest

from tallybook.llm import hard_negatives as H


def plain(rows):
    """(vec_id, label, vector) rows in table order."""
    ok = [(i, v, lab, [math.floor(256 * float(c)) for c in x]) for i, (v, lab, x) in enumerate(rows) if v is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, v, lab, x in ok:
        if v % 50:
            continue
        scored = sorted((-dot(x, y), w, j, m) for j, w, m, y in ok if j != i)
        for s, w, _, _ in [t for t in scored if t[3] == lab][:5]:
            hard = [t for t in scored if t[3] != lab and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(v, w, k + 1, t[1], -s, -t[0]) for k, t in enumerate(hard)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' as score", "1 as rid", "'y' as a")


def f32(x):
    return [float(np.float32(c)) for c in x]


@pytest.mark.parametrize("kind", ["clusters", "isotropic", "copies"])
def test_as_all_pairs(spark, kind):
    rng = np.random.default_rng(len(kind))
    n, d = 400, 12
    if kind == "clusters":
        mid = rng.normal(size=(9, d))
        x = mid[rng.integers(0, 9, n)] + rng.normal(size=(n, d)) * 0.15
        x *= rng.uniform(0.1, 3, n)[:, None]
    elif kind == "isotropic":
        x = rng.normal(size=(n, d))
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] * np.r_[np.zeros(20), np.ones(n - 20)][:, None]
    rows = [(int(i) * 5, int(rng.integers(0, 4)), f32(v)) for i, v in enumerate(x)]
    for size, at in ((H.BLOCK, H.ANCHORS), (64, 8)):
        assert result(H.mine(frame(spark, rows), size, at)) == plain(rows), size
    assert plain(rows)


def test_odd_rows(spark):
    """Nulls and non-finite components take no part; short, empty, zero and repeated vectors, ties, few positives, negative ids."""
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, f32(rng.normal(size=6))) for i in range(0, 150, 2)]
    rows += [(0, 0, rows[0][2]), (0, 0, rows[0][2]), (50, None, rows[3][2]), (100, 1, None), (None, 1, rows[1][2]), (7, 1, [1.0, None]), (9, 1, [float("nan")] * 6), (11, 1, [float("inf")] * 6)]
    rows += [(200, 9, f32([1, 2, 3])), (250, 8, []), (-50, 1, f32(rng.normal(size=6))), (300, 77, rows[5][2]), (301, 2, rows[5][2]), (302, 2, rows[5][2]), (350, 2, f32([300, -300, 1, 1, 1, 1]))]
    assert result(H.mine(frame(spark, rows), 16, 2)) == plain(rows)
    assert result(H.mine(frame(spark, []))) == []
    assert result(H.mine(frame(spark, [(1, 1, [1.0])]))) == []
    assert result(H.mine(frame(spark, [(50, 1, [0.5, 1.0])]))) == []


def test_bounds_hold_and_spare():
    """No score lies outside its bounds, and of clustered vectors most pairs with a low score are told by angles alone."""
    rng = np.random.default_rng(4)
    mid = rng.normal(size=(8, 16))
    x = np.floor(256 * (mid[rng.integers(0, 8, 300)] + rng.normal(size=(300, 16)) * 0.1) * rng.uniform(0.01, 5, 300)[:, None])
    x[0] = 0
    refs = mid / np.linalg.norm(mid, axis=1)[:, None]
    norm, theta = H.angles(x, refs)
    low, high = H.score_bounds(theta, norm, theta, norm)
    exact = x @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    cos = exact / np.maximum(np.outer(norm, norm), 1)
    ruled_out = high < 0.8 * np.outer(norm, norm)
    assert ruled_out[cos < 0.6].mean() > 0.8


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.sql(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({H.ORACLES['op12_hard_negatives']})").fetchall())
    assert result(H.query(spark, sf)) == want and want
