"""Embedding near-duplicates through an inverted multi-index.

The two halves of a unit vector have a codebook each; the pairs of their cells
form a product grid, and every vector lies in one cell of it. A vector visits
the cells of the multi-sequence order, by the distances of both halves together,
as far as a bound that is fitted to a target recall. What it meets there is
verified by exact cosines.

1. Equal vectors are one class, with a weight.
2. Fit, on the driver, from a sample of `sample_rows` classes: both codebooks by
   k-means; the bound of the traversal, from pairs made to lie exactly at the
   threshold, the hardest ones, so that links are found at `target_recall` or
   better; and cores, the centers of groups that hold a good part of the sample.
3. A vector within half the threshold's angle of a core's center belongs to it.
   Members of one core all link, by the triangle inequality: they are counted and
   not compared, so a hot group of near copies costs no pairs. A vector visits a
   core only within one and a half of the angle; further out it links with none
   of its members. All others are in the grid, where the vector with the lower
   cell visits the other's.
4. The inhabitants and the visitors of each cell are counted first. Crowded cells
   are dealt to tasks by blocks of `block_rows` inhabitants and parts of
   `part_rows` visitors. A task counts links with matrix products and emits, for
   each row, the number of its links and one edge of a spanning forest, no pairs.
5. Components by star contraction; classes give their result to all their rows.

The fit grows with its parameters only: at most `sample_rows` vectors,
`most_codes` squared cells and one core in 32 rows of the sample, so the counts
of step 4 are a table of bounded size, and the one that is broadcast.

Odd input: vectors that are null, zero, or hold null or non-finite components,
and rows without an id, link with nothing and are their own component. Vectors
of different lengths are not compared; lengths outside the sample have one cell.
Rows of one id are rows of their own, and share no link by the id. Vectors are
scaled before their norm is taken, so that no square overflows or vanishes. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .graph import components

MARGIN = 1e-9  # of angles, for rounding
_PLACED = "dims int, cell long, home boolean, cid long, h long, w long, v binary"
_FOUND = "cid long, h long, n long, rcid long, rh long"


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), 0.0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k centers of the rows of x by k-means, fewer if they fall together."""
    centers = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        own = apart(x, centers).argmin(axis=1)
        used = np.unique(own)
        centers = np.stack([x[own == a].mean(axis=0) for a in used])
    return centers


def groups(x: np.ndarray, radius: float, least: int) -> np.ndarray:
    """Centers of groups of at least `least` rows within the radius (an angle) of
    them, densest first; each row counts once."""
    found, close = [], np.cos(radius)
    near = np.concatenate([x[a : a + 512] @ x.T >= np.cos(2 * radius) for a in range(0, len(x), 512)])
    open_rows = np.ones(len(x), dtype=bool)
    while True:
        size = near[:, open_rows].sum(axis=1) * open_rows
        at = int(size.argmax()) if len(size) else 0
        if not len(size) or size[at] < least:
            return np.array(found).reshape(-1, x.shape[1])
        center = x[near[at] & open_rows].sum(axis=0)
        center /= np.sqrt((center * center).sum())
        inside = (x @ center >= close) & open_rows
        if inside.sum() >= least:
            found.append(center)
        open_rows &= ~inside
        open_rows[at] = False


@dataclass
class Index:
    """What the driver fits for vectors of one length."""

    left: np.ndarray
    right: np.ndarray
    stop: float
    cores: np.ndarray
    angle: float  # of the threshold

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return apart(x[:, :half], self.left), apart(x[:, half:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the multi-sequence order as far as the bound: with both
        lists sorted, each place of the first takes a prefix of the second."""
        a, b = self.halves(x)
        a -= a.min(axis=1, keepdims=True)
        b -= b.min(axis=1, keepdims=True)
        i, j = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, i, axis=1), np.take_along_axis(b, j, axis=1)
        rows, cells = [], []
        live = np.arange(len(x))
        for place in range(len(self.left)):
            live = live[a[live, place] <= self.stop]
            if not len(live):
                break
            take = (b[live] <= self.stop - a[live, place][:, None]).sum(axis=1)
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            row = np.repeat(live, take)
            rows.append(row)
            cells.append(i[row, place] * len(self.right) + j[row, at])
        none = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(none + rows), np.concatenate(none + cells)

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.cores.T, -1.0, 1.0))

    def core_of(self, angles: np.ndarray) -> np.ndarray:
        """The nearest core that holds each row, or -1."""
        if not angles.shape[1]:
            return np.full(len(angles), -1)
        at = angles.argmin(axis=1)
        return np.where(angles[np.arange(len(at)), at] <= self.angle / 2 - MARGIN, at, -1)


def fit(x: np.ndarray, total: int, threshold: float, target_recall: float, cell_rows: int, most_codes: int) -> Index:
    """An index from the sampled unit vectors x of total ones."""
    rng, angle = np.random.default_rng(0), float(np.arccos(threshold))
    cores = groups(x, angle / 2 - MARGIN, 32)
    index = Index(np.zeros((1, 0)), np.zeros((1, 0)), 0.0, cores, angle)
    free = x[index.core_of(index.angles(x)) < 0] if len(cores) else x
    free = free if len(free) else x
    k = int(min(max(4, round((total / cell_rows) ** 0.5)), most_codes, max(1, len(free) // 16)))
    half = x.shape[1] // 2
    index.left, index.right = codebook(free[:, :half], k, rng), codebook(free[:, half:], k, rng)
    base = free[:2048]
    way = rng.normal(size=base.shape)
    way -= (way * base).sum(axis=1, keepdims=True) * base
    way /= np.maximum(np.sqrt((way * way).sum(axis=1, keepdims=True)), 1e-300)
    other = threshold * base + (1 - threshold**2) ** 0.5 * way
    a, b = index.halves(base)
    row, cell = np.arange(len(base)), index.cells(other)
    need = a[row, cell // len(index.right)] - a.min(axis=1) + b[row, cell % len(index.right)] - b.min(axis=1)
    index.stop = float(np.quantile(need, target_recall)) if target_recall < 1 else float("inf")
    return index


def _vectors(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors of that length as stored)."""
    col = batch.column("v")
    sizes = np.asarray(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat, start = col.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(sizes) - sizes
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield dims, rows, flat[start[rows][:, None] + np.arange(dims)]


def _place(indexes: dict[int, Index], kind: str, carry: bool):
    """Rows where they live and where they visit; with their vectors, or counted
    as (dims, cell, homes, visitors) of a task."""

    def places(dims: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, row = len(x), np.arange(len(x))
        index = indexes.get(dims)
        if index is None:
            return row, np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        angles = index.angles(x)
        core, own = index.core_of(angles), index.cells(x)
        at, cell = index.visits(x)
        away = (core[at] < 0) & (cell > own[at])
        near, other = np.nonzero((angles <= 1.5 * index.angle + MARGIN) & ((core[:, None] < 0) | (np.arange(angles.shape[1])[None, :] < core[:, None])))
        rows = np.concatenate([row, at[away], near])
        return rows, np.concatenate([np.where(core < 0, own, -1 - core), cell[away], -1 - other]), np.arange(len(rows)) < n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for dims, which, v in _vectors(batch, kind):
                for a in range(0, len(which), 2048):
                    part = v[a : a + 2048]
                    row, cell, home = places(dims, unit(part.astype(np.float64)))
                    if carry:
                        at = pa.array(which[a + row])
                        stored = pa.array([x.tobytes() for x in part], pa.binary()).take(pa.array(row))
                        own = [batch.column(c).take(at) for c in ("cid", "h", "w")]
                        yield pa.record_batch([pa.array(np.full(len(row), dims), pa.int32()), pa.array(cell), pa.array(home), *own, stored], ["dims", "cell", "home", "cid", "h", "w", "v"])
                    else:
                        cells, at = np.unique(cell, return_inverse=True)
                        for c, n, m in zip(cells.tolist(), np.bincount(at, home).tolist(), np.bincount(at, ~home).tolist()):
                            have = counts.setdefault((dims, c), [0, 0])
                            have[0] += int(n)
                            have[1] += int(m)
        if not carry:
            rows = [(d, c, n, m) for (d, c), (n, m) in counts.items()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["dims", "cell", "homes", "visitors"])

    return run


def _core_members(indexes: dict[int, Index], kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, which, v in _vectors(batch, kind):
                index = indexes.get(dims)
                if index is None or not len(index.cores):
                    continue
                core = index.core_of(index.angles(unit(v.astype(np.float64))))
                inside = np.flatnonzero(core >= 0)
                at = pa.array(which[inside])
                yield pa.record_batch([pa.array(np.full(len(inside), dims), pa.int32()), pa.array(core[inside], pa.int32()), *(batch.column(c).take(at) for c in ("cid", "h", "w"))], ["dims", "core", "cid", "h", "w"])

    return run


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links, a column of its
    component: the same one for all that are connected (-1: no link)."""
    rows, columns = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    m = links[np.ix_(rows, columns)]
    label = np.arange(len(columns))
    while len(columns):
        low = np.where(m, label[None, :], len(columns)).min(axis=1)
        new = np.minimum(label, np.where(m, low[:, None], len(columns)).min(axis=0))
        if (new == label).all():
            break
        label = new
    row_of, column_of = np.full(links.shape[0], -1), np.full(links.shape[1], -1)
    if len(columns):
        row_of[rows], column_of[columns] = columns[low], columns[label]
    return row_of, column_of


def _compare(threshold: float, kind: str, step: int = 512):
    def run(group: pa.Table) -> pa.Table:
        def part(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            ids, h, w = (rows.column(c).to_numpy() for c in ("cid", "h", "w"))
            return np.frombuffer(b"".join(rows.column("v").to_pylist()), dtype=kind).reshape(len(ids), -1 if len(ids) else 1), ids, h, w

        role = group.column("role").to_numpy()
        x, xid, xh, xw = part(group.filter(pa.array(role <= 1)))
        y, yid, yh, yw = part(group.filter(pa.array(role == 2)))
        inner = bool((role == 1).any())
        x = unit(x.astype(np.float64)) if len(x) else x
        out: list[tuple[np.ndarray, ...]] = []
        total = np.zeros(len(x), dtype=np.int64)

        def note(links: np.ndarray, qid: np.ndarray, qh: np.ndarray, n: np.ndarray) -> None:
            row, column = forest(links)
            for ids, h, count, to in ((qid, qh, n, row), (xid, xh, np.zeros(len(x), dtype=np.int64), column)):
                at = np.flatnonzero(to >= 0)
                at = at if ids is qid else at[to[at] != at]
                out.append((ids[at], h[at], count[at], xid[to[at]], xh[to[at]]))

        for a in range(0, len(x) if inner else 0, step):
            links = x[a : a + step] @ x.T >= threshold
            links[np.arange(len(links)), np.arange(a, a + len(links))] = False
            if links.any():
                note(links, xid[a : a + step], xh[a : a + step], links @ xw)
        for a in range(0, len(y) if len(x) else 0, step):
            links = unit(y[a : a + step].astype(np.float64)) @ x.T >= threshold
            if links.any():
                note(links, yid[a : a + step], yh[a : a + step], links @ xw)
                total += yw[a : a + step] @ links
        at = np.flatnonzero(total)
        out.append((xid[at], xh[at], total[at], xid[at], xh[at]))
        return pa.table({c: np.concatenate([o[i] for o in out]).astype(np.int64) for i, c in enumerate(("cid", "h", "n", "rcid", "rh"))})

    return run


def link_counts(classes: DataFrame, indexes: dict[int, Index], threshold: float, kind: str, block_rows: int, part_rows: int) -> DataFrame:
    """(cid, h, n, rcid, rh): numbers of links to be added up, and edges."""
    seen = classes.mapInArrow(_place(indexes, kind, False), "dims int, cell long, homes long, visitors long")
    cells = seen.groupBy("dims", "cell").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
    blocks = F.ceil(F.col("homes") / block_rows).cast("int")
    # inhabitants of one block visit the later blocks of their cell
    cells = cells.where("homes > 0").select("dims", "cell", blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil((F.col("visitors") + F.when((blocks > 1) & (F.col("cell") >= 0), F.col("homes")).otherwise(0)) / part_rows).cast("int")).alias("parts"))
    placed = classes.mapInArrow(_place(indexes, kind, True), _PLACED).join(F.broadcast(cells), ["dims", "cell"])  # at most most_codes ** 2 cells and the cores, for each length
    deal = lambda c, n: F.expr(f"pmod(xxhash64(cid, h, '{c}'), {n})").cast("int")
    placed = placed.withColumn("own_block", F.when(F.col("home"), deal("block", "blocks")).otherwise(-1)).withColumn("own_part", deal("part", "parts"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # role 0: inhabitant, 1: inhabitant that also meets those of its block, 2: visitor
    lives = F.transform(every(F.col("parts")), lambda p: F.struct(F.col("own_block").alias("block"), p.alias("part"), F.when((p == 0) & (F.col("cell") >= 0), 1).otherwise(0).alias("role")))
    goes = F.transform(F.filter(every(F.col("blocks")), lambda b: b > F.col("own_block")), lambda b: F.struct(b.alias("block"), F.col("own_part").alias("part"), F.lit(2).alias("role")))
    to = F.when(F.col("home") & (F.col("cell") >= 0), F.concat(lives, goes)).when(F.col("home"), lives).otherwise(goes)
    dealt = placed.withColumn("to", F.explode(to)).select("dims", "cell", "to.block", "to.part", "to.role", "cid", "h", "w", "v")
    return dealt.groupBy("dims", "cell", "block", "part").applyInArrow(_compare(threshold, kind), _FOUND)


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, target_recall: float = 0.99,
    sample_rows: int = 4096, cell_rows: int = 512, most_codes: int = 256, block_rows: int = 4096, part_rows: int = 16384,
) -> DataFrame:
    """id, n_links and component_id of every row of df."""
    spark = df.sparkSession
    kind = "float32" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "float64"
    e = F.col(vector_col).cast("array<float>" if kind == "float32" else "array<double>")
    raw = df.select(F.col(id_col).alias("given"), F.col(id_col).cast("long").alias("id"), e.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    keyed = raw.withColumn("h", F.when(F.coalesce(whole, F.lit(False)), F.xxhash64("v"))).withColumn("g", F.when(F.col("h").isNotNull(), F.xxhash64(F.lit("second"), "v")))
    classes = materialize(keyed.where("h is not null").groupBy("h", "g").agg(F.min("id").alias("cid"), F.count("*").alias("w"), F.first("v").alias("v")))
    sample = classes.orderBy(F.xxhash64("h", "g")).limit(sample_rows).select("v").collect()
    total, by_length = classes.count(), {}
    for r in sample:
        by_length.setdefault(len(r.v), []).append(r.v)
    indexes = {dims: fit(unit(np.array(x, dtype=np.float64)), total * len(x) // len(sample), threshold, target_recall, cell_rows, most_codes) for dims, x in by_length.items()}
    found = materialize(link_counts(classes, indexes, threshold, kind, block_rows, part_rows))
    members = classes.mapInArrow(_core_members(indexes, kind), "dims int, core int, cid long, h long, w long")
    cores = members.groupBy("dims", "core").agg(F.sum("w").alias("all"), F.min(F.struct("cid", "h")).alias("root"))
    inside = materialize(members.join(F.broadcast(cores), ["dims", "core"]).select("cid", "h", (F.col("all") - F.col("w")).alias("n"), F.col("root.cid").alias("rcid"), F.col("root.h").alias("rh")))
    both = found.unionByName(inside)
    roots = components(both.select(F.struct("cid", "h").alias("a"), F.struct(F.col("rcid").alias("cid"), F.col("rh").alias("h")).alias("b")))
    counts = both.groupBy("cid", "h").agg(F.sum("n").alias("n"))
    rooted = roots.select(F.col("node.cid").alias("cid"), F.col("node.h").alias("h"), F.col("root.cid").alias("root"))
    result = classes.select("h", "g", "cid", "w").join(counts, ["cid", "h"], "left").join(rooted, ["cid", "h"], "left")
    result = materialize(result.select("h", "g", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component_id")))
    return keyed.select("given", "id", "h", "g").join(result, ["h", "g"], "left").select(F.col("given").alias("id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op12_near_vectors(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a AS node, least(a, b) AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT d.vec_id, count(l.b) AS n_links, coalesce(min(r.root), d.vec_id) AS component_id, d.vec_id = coalesce(min(r.root), d.vec_id) AS kept
FROM embeddings d LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) r ON r.node = d.vec_id LEFT JOIN l ON l.a = d.vec_id GROUP BY d.vec_id
"""
