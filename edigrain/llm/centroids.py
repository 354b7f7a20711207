"""Centroid clustering by Exponion search, exact in integers.

Vectors become integers, centroids are integers too, and squared distances are
exact. Each vector carries its centroid, an upper bound of the distance to it
and a lower bound of the distance to any other. After the centroids have moved,
a vector whose upper bound lies below its lower bound, or below half the way
from its centroid to the next, keeps it unseen. The others scan only centroids
in a ball around their own: its radius is twice the distance to it and the way
to the next centroid, so that it holds the nearest and the second nearest.
Centroids are sorted by distance for each centroid, so a ball is a prefix of a
list; prefixes are taken in powers of two, so that vectors of one centroid share
a few matrix products. Bounds have a margin for rounding and radii are
inclusive: equal distances always meet, and the smaller number wins.

Vectors never shuffle: a round reads and writes them with their state, one
generation after the other, and each task sends one sum a centroid, so a large
cluster is no hot key. The driver holds k centroids and k sums of `dims` numbers.

Odd input: vectors that are null, have another length, hold null or non-finite
components, or components beyond 2**27 after scaling (whose squared distances
need not fit 64 bits) take no part. Repeated rows are rows of their own. Seeds go
by the hash of the id and then, for rows of one id, by the vector; rows without
an id are seeds last. Fewer vectors than k make fewer centroids. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, table

MOST = 1 << 27  # of a component's magnitude
MARGIN = 1e-12  # relative, of distances in floating point


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows x and c, int64."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * peak * peak < 1 << 52:  # every sum is exact in doubles
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for j in range(len(c)):
        d = x - c[j]
        out[:, j] = (d * d).sum(axis=1)
    return out


class Centroids:
    """Centroids with the sorted lists of distances between them."""

    def __init__(self, values: np.ndarray, moved: np.ndarray | None = None):
        self.values, k = values, len(values)
        way = np.sqrt(squared(values, values).astype(np.float64)) * (1 - MARGIN)
        np.fill_diagonal(way, -1.0)  # each list begins with the centroid itself
        self.order = np.argsort(way, axis=1, kind="stable")
        self.way = np.take_along_axis(way, self.order, axis=1)
        self.next = np.maximum(self.way[:, 1], 0.0) if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if moved is None else moved
        top = np.argsort(-self.moved, kind="stable")[:2]
        self.others = np.full(k, self.moved[top[0]] if k else 0.0)  # the farthest that another one moved
        if k:
            self.others[top[0]] = self.moved[top[1]] if k > 1 else 0.0

    def nearest(self, x: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, lower bound of all others of columns)."""
        columns = np.sort(columns)
        d = squared(x, self.values[columns])
        at = d.argmin(axis=1)  # the first, so the smallest number
        second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - MARGIN) if len(columns) > 1 else np.full(len(x), np.inf)
        return columns[at], d[np.arange(len(x)), at], second

    def step(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(centroid, upper bound, lower bound) of each vector after the centroids
        have moved, and how many distances that took."""
        own = own.copy()
        upper = (upper + self.moved[own]) * (1 + MARGIN)
        lower = lower - self.others[own]
        took = 0
        for a in range(len(self.values)):
            mine = np.flatnonzero(own == a)
            safe = np.maximum(lower[mine], self.next[a] / 2) * (1 - MARGIN)
            mine = mine[upper[mine] >= safe]
            if not len(mine):
                continue
            upper[mine] = np.sqrt(squared(x[mine], self.values[a : a + 1])[:, 0].astype(np.float64)) * (1 + MARGIN)
            took += len(mine)
            mine = mine[upper[mine] >= np.maximum(lower[mine], self.next[a] / 2) * (1 - MARGIN)]
            if not len(mine) or len(self.values) == 1:
                continue
            size = np.searchsorted(self.way[a], (2 * upper[mine] + self.next[a]) * (1 + MARGIN), side="right")
            ring = np.minimum(1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64), len(self.values))
            for n in np.unique(ring).tolist():
                part = mine[ring == n]
                number, d, second = self.nearest(x[part], self.order[a, :n])
                took += n * len(part)
                own[part], upper[part], lower[part] = number, np.sqrt(d.astype(np.float64)) * (1 + MARGIN), second
        return own, upper, lower, took


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assign(centroids: Centroids, dims: int, last: bool):
    names = ["id", "v", "cluster", "upper", "lower"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dims)
            if "cluster" in batch.schema.names:
                own, upper, lower, _ = centroids.step(x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in names[2:]))
            else:
                own, d, lower = centroids.nearest(x, np.arange(len(centroids.values)))
                upper = np.sqrt(d.astype(np.float64)) * (1 + MARGIN)
            if last:
                d = np.empty(len(x), dtype=np.int64)
                for a in np.unique(own).tolist():
                    d[own == a] = squared(x[own == a], centroids.values[a : a + 1])[:, 0]
                yield pa.record_batch([batch.column("id"), pa.array(own, pa.int32()), pa.array(d)], ["id", "cluster", "distance"])
            else:
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower)], names)

    return run


def _sums(k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)  # the last is the count
        for batch in batches:
            x, own = _matrix(batch, dims), batch.column("cluster").to_numpy(zero_copy_only=False)
            for a in np.unique(own).tolist():
                total[a, :dims] += x[own == a].sum(axis=0)
                total[a, dims] += (own == a).sum()
        used = np.flatnonzero(total[:, dims])
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    return run


def means(state: DataFrame, values: np.ndarray) -> np.ndarray:
    """Componentwise floor of sum / count of each centroid's vectors; a centroid
    without vectors stays."""
    k, dims = values.shape
    parts = state.select("v", "cluster").mapInArrow(_sums(k, dims), "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "part"))
    total: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        total.setdefault(r.cluster, [0] * (dims + 1))[r.at] = int(r.total)
    out = values.copy()
    for a, sums in total.items():
        out[a] = [s // sums[dims] for s in sums[:dims]]
    return out


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster and squared distance of each vector that takes part; the
    centroids)."""
    raw = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    fine = (F.size("e") == dims) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= MOST))
    rows = raw.where(F.coalesce(fine, F.lit(False))).select("id", F.transform("e", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    by_hash = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    seeds = by_hash.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    out = f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not seeds:
        return df.sparkSession.createDataFrame([], out), np.zeros((0, dims), dtype=np.int64)
    values, moved = np.array([r.v for r in seeds], dtype=np.int64).reshape(-1, dims), None
    state, stored = rows, Generations(df.sparkSession)
    carried = f"id {rows.schema['id'].dataType.simpleString()}, v array<int>, cluster int, upper double, lower double"
    for _ in range(rounds):
        state = stored.write(state.mapInArrow(_assign(Centroids(values, moved), dims, False), carried))
        new = means(state, values)
        moved = np.sqrt([float(squared(a[None], b[None])[0, 0]) for a, b in zip(new, values)]) * (1 + MARGIN)
        values = new
    return stored.write(state.mapInArrow(_assign(Centroids(values, moved), dims, True), out)), values


def op13_centroids(spark, sf_dir):
    found, values = cluster_vectors(table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    own = [(a, total, sum(sums.values()), sha256(",".join(map(str, values[a].tolist())).encode()).hexdigest()) for a, total in sums.items()]
    clusters = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def _sql(k: int = 40, rounds: int = 5) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (SELECT row, vec_id, v, c, d FROM (
  SELECT x.row, x.vec_id, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
    row_number() OVER (PARTITION BY x.row ORDER BY d, m.c) AS nth FROM kept x CROSS JOIN m{r} m) WHERE nth = 1)""")
        if r < rounds:
            steps.append(f"""
m{r + 1} AS (SELECT m.c, coalesce(n.m, m.m) AS m FROM m{r} m LEFT JOIN (
  SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS m FROM (
    SELECT c, i, sum(x)::DOUBLE AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INTEGER AS c, v AS m FROM kept ORDER BY c LIMIT {k}),{",".join(steps)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} m USING (c)"""


SQL = _sql()
