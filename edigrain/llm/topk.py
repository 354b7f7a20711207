"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are cut into shards and queries into blocks. In each (shard, block)
task every dimension has a list of the shard's vectors sorted by that
component. A query walks the lists from the end its own component prefers,
scores each vector it meets first, and stops when the inner product of the
query with the values at the current depth - no unseen vector can score more -
is below its kth best score. Shard results meet in a ranked window per query.

Null, empty and repeated input: vectors that are null or hold a null or
non-finite component, or one beyond 2**27 after scaling (whose products need not
fit 64 bits), and rows without an id, take no part. Rows that bear a
query's id are its own and no candidates of it; repeated query rows with equal
vectors are one query; other repeated rows count one by one. Only vectors of
one length are compared. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

MOST = 1 << 27  # of a component's magnitude


def threshold_topk(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int, lists: np.ndarray, columns: np.ndarray, step: int = 32) -> list[tuple[int, int]]:
    """(score, id) of the k best rows for one query; ties go to the smaller id.
    lists[j, d] is the row at ascending place j of dimension d."""
    n, dims = vectors.shape
    seen = ids == query_id
    best: list[tuple[int, int]] = []
    up = query < 0
    used = np.flatnonzero(query != 0)
    depth = 0
    while depth < n:
        upto = min(n, depth + step)
        if len(used):
            asc = lists[depth:upto, used[up[used]]]
            desc = lists[n - upto : n - depth, used[~up[used]]]
            rows = np.concatenate([asc.ravel(), desc.ravel()])
        else:
            rows, upto = np.arange(n), n
        fresh = np.zeros(n, dtype=bool)
        fresh[rows] = True
        fresh &= ~seen
        rows = np.flatnonzero(fresh)
        seen |= fresh
        if len(rows):
            scores = vectors[rows] @ query
            if len(rows) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= cut
                rows, scores = rows[keep], scores[keep]
            best += list(zip(scores.tolist(), ids[rows].tolist()))
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
        depth = upto
        if len(best) == k and depth < n:
            edge = np.where(up, columns[depth], columns[n - 1 - depth])
            if float(edge @ query) < best[-1][0]:
                break
        step *= 2
    return best


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            exact = np.stack(left["v"].to_numpy())
            ids = left["id"].to_numpy()
            queries = np.stack(right["v"].to_numpy())
            peak = float(np.abs(exact).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, exact.shape[1])
            kind = np.float64 if peak < 2**53 else np.int64  # both are exact in range
            x, q = exact.astype(kind), queries.astype(kind)
            lists = np.argsort(x, axis=0, kind="stable")
            columns = np.take_along_axis(x, lists, axis=0)
            for i, (qid, qkey) in enumerate(zip(right["id"], right["qkey"])):
                out += [(qid, qkey, int(b), int(s)) for s, b in threshold_topk(x, ids, q[i], qid, k, lists, columns)]
        return pd.DataFrame(out, columns=["query_id", "qkey", "vec_id", "score"]).astype("int64")

    return run


def exact_topk(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates."""
    spark = df.sparkSession
    total = df.count()
    shards = max(1, -(-total // shard_rows))
    raw = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"), is_query.alias("is_query"))
    fine = F.col("id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= MOST))
    vecs = raw.where(F.coalesce(fine, F.lit(False))).select("id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"), "is_query", F.size("e").alias("dims"), F.xxhash64("id", "e").alias("qkey"))
    queries = vecs.where(F.coalesce("is_query", F.lit(False))).select("id", "v", "dims", "qkey").dropDuplicates(["id", "qkey"])
    blocks = max(1, -(-queries.count() // query_rows))
    left = vecs.select("id", "v", "dims", F.expr(f"pmod(xxhash64(id, v), {shards})").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("id", "v", "dims", "qkey", F.expr(f"pmod(qkey, {blocks})").cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    keys = ["shard", "block", "dims"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k), "query_id long, qkey long, vec_id long, score long")
    w = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir):
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
