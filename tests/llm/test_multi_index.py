"""Near-duplicate vectors against all pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edigrain.llm import multi_index

SF = "/root/testdata/sf0.01"


def brute(vectors, threshold=0.95):
    """n_links and least reachable place of each row."""
    x = multi_index.unit(np.array(vectors))
    links = x @ x.T >= threshold
    np.fill_diagonal(links, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(links, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            return links, root
        root = new


def at_cosine(rng, base, low, high):
    way = rng.normal(size=base.shape)
    way -= (way * base).sum(axis=1, keepdims=True) * base
    way /= np.sqrt((way * way).sum(axis=1, keepdims=True))
    c = rng.uniform(low, high, size=(len(base), 1))
    return c * base + np.sqrt(1 - c * c) * way


def planted(rng, dims=24):
    base = multi_index.unit(rng.normal(size=(900, dims)))
    tight = at_cosine(rng, np.repeat(base[:1], 500, axis=0), 0.985, 1.0)  # links all through
    loose = at_cosine(rng, np.repeat(base[1:2], 200, axis=0), 0.93, 0.99)  # links in part
    pairs = at_cosine(rng, base[100:500], 0.951, 1.0)
    chain = [base[2:3]]
    for _ in range(20):
        chain.append(at_cosine(rng, chain[-1], 0.96, 0.97))
    return np.concatenate([base, tight, loose, pairs, *chain[1:], base[600:650], base[600:650], 3.5 * base[700:710]])


@pytest.mark.parametrize("how", [{}, {"block_rows": 37, "part_rows": 50, "cell_rows": 8, "sample_rows": 600}])
def test_against_all_pairs(spark, how):
    x = planted(np.random.default_rng(5))
    links, root = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.id: r for r in multi_index.near_duplicates(df, **how).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert len(got) == len(x) and (found <= links.sum(axis=1)).all()
    assert found.sum() >= 0.995 * links.sum()
    same = np.array([got[i].component_id for i in range(len(x))]) == root
    assert same.mean() > 0.97 and same[900:1600].mean() > 0.97
    whole = {r.id: r for r in multi_index.near_duplicates(df, target_recall=1.0, **how).collect()}
    assert [whole[i].n_links for i in range(len(x))] == links.sum(axis=1).tolist() and [whole[i].component_id for i in range(len(x))] == root.tolist()


def test_bound_reaches_its_recall():
    rng = np.random.default_rng(6)
    x = multi_index.unit(rng.normal(size=(6000, 32)))
    index = multi_index.fit(x[:4096], 10**6, 0.95, 0.95, 512, 256)
    other = at_cosine(rng, x[4096:], 0.95, 0.95)
    row, cell = index.visits(x[4096:])
    seen = set(zip(row.tolist(), cell.tolist()))
    hit = np.mean([(i, c) in seen for i, c in enumerate(index.cells(other).tolist())])
    assert hit > 0.9 and len(row) < 0.2 * len(index.left) * len(index.right) * len(other)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select vec_id, list_transform(embedding, lambda x: x) as embedding from '{SF}/embeddings.parquet' union all select vec_id + 500, list_transform(embedding, lambda x: x * 2::FLOAT) from '{SF}/embeddings.parquet' where vec_id % 5 = 0")
    want = con.sql(multi_index.SQL)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    both = e.unionByName(e.where("vec_id % 5 = 0").select(F.col("vec_id") + 500, F.transform("embedding", lambda x: x * F.lit(2).cast("float")).alias("embedding")).toDF("vec_id", "embedding"))
    got = multi_index.near_duplicates(both).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    alone = duckdb.connect()
    alone.sql(f"create view embeddings as from '{SF}/embeddings.parquet'")
    query = multi_index.op12_near_vectors(spark, SF)
    want = alone.sql(multi_index.SQL)
    assert sorted(map(tuple, query.select(*want.columns).collect())) == sorted(want.fetchall())


def test_odd_rows(spark):
    rows = [
        (7, [1.0, 0.0]), (3, [1e200, 1e190]), (3, [0.0, 5e-310]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (1, None), (2, []), (4, [0.0, 0.0]), (5, [None, 1.0]),
        (6, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 0.0]), (None, None), (10, [1.0]), (11, [2.0]), (12, [-1.0]), (13, [1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "w", "h", "g", "cid", "cell", "given", "n", "root")})
    got = sorted(((r.id, r.n_links, r.component_id) for r in multi_index.near_duplicates(df).collect()), key=str)
    want = [(7, 1, 3), (3, 1, 3), (3, 2, 3), (9, 2, 3), (9, 2, 3), (10, 1, 10), (11, 1, 10), *((i, 0, i) for i in (1, 2, 4, 5, 6, 8, 12, 13, None, None))]
    assert got == sorted(want, key=str)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in multi_index.near_duplicates(one).collect()] == [(1, 0, 1)]
