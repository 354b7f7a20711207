"""Exponion clustering against a full scan of all centroids in whole numbers."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edigrain.llm import centroids

SF = "/root/testdata/sf0.01"


def lloyd(x, start, rounds):
    """Python integers; ties go to the smaller number."""
    values = [list(map(int, c)) for c in start]
    find = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(values))
    for _ in range(rounds):
        own = [find(v)[1] for v in x]
        for j in range(len(values)):
            if mine := [v for v, a in zip(x, own) if a == j]:
                values[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(find(v)[1], find(v)[0]) for v in x], values


@pytest.mark.parametrize("kind", ["grid", "clusters", "large"])
def test_bounds_lose_nothing(kind):
    rng = np.random.default_rng(len(kind))
    if kind == "grid":  # many equal distances and equal vectors
        x = rng.integers(0, 3, size=(400, 2))
    elif kind == "clusters":
        x = (rng.integers(-400, 400, size=(12, 8))[rng.integers(12, size=500)] + rng.integers(-30, 30, size=(500, 8))).astype(np.int64)
    else:
        x = rng.integers(-centroids.MOST, centroids.MOST, size=(200, 4))
    values, moved, took = x[:15].copy(), None, 0
    state = centroids.Centroids(values)
    own, d, lower = state.nearest(x, np.arange(15))
    upper = np.sqrt(d) * (1 + centroids.MARGIN)
    for rounds in range(1, 7):
        new = values.copy()
        for a in np.unique(own):
            mine = x[own == a].tolist()
            new[a] = [sum(c) // len(mine) for c in zip(*mine)]
        moved = np.sqrt([float(centroids.squared(a[None], b[None])[0, 0]) for a, b in zip(new, values)]) * (1 + centroids.MARGIN)
        values = new
        own, upper, lower, n = centroids.Centroids(values, moved).step(x, own, upper, lower)
        took += n
        want, centers = lloyd(x.tolist(), x[:15], rounds)
        assert values.tolist() == centers and own.tolist() == [a for a, _ in want]
    assert took < 6 * 15 * len(x) * (0.5 if kind == "clusters" else 1.2)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{SF}/embeddings.parquet'")
    want = con.sql(centroids.SQL)
    got = centroids.op13_centroids(spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.integers(-9, 9, size=4) / 256).tolist()) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0]), (103, [None, 1.0, 1.0, 1.0]), (104, [float("nan"), 0.0, 0.0, 0.0]), (105, [float("-inf"), 0.0, 0.0, 0.0]), (106, [1e300, 0.0, 0.0, 0.0])]
    rows = [*good, good[3], (None, good[4][1]), (None, good[4][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "e", "cluster", "upper", "lower", "hash")})
    found, values = centroids.cluster_vectors(df, k=7, dims=4)
    x = [[round(256 * c) for c in v] for _, v in rows]
    start = sorted(range(30), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    start = sorted([*start, 30], key=lambda i: (hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest(), x[i]))[:7]
    want, centers = lloyd(x, [x[i] for i in start], 5)
    assert values.tolist() == centers
    assert sorted(map(tuple, found.collect()), key=lambda t: (t[0] is None, t[0] or 0, *t[1:])) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=lambda t: (t[0] is None, t[0] or 0, *t[1:]))
    few, centers = centroids.cluster_vectors(df.where("vec_id in (1, 2)"), k=7, dims=4)
    assert len(centers) == 2 and {r.distance for r in few.collect()} == {0}
    assert centroids.cluster_vectors(df.limit(0))[0].count() == 0
    one, _ = centroids.cluster_vectors(df.where("vec_id < 30"), k=1, dims=4)
    assert {r.cluster for r in one.collect()} == {0}
