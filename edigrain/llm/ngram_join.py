"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word shingles; two documents link when
their sets' Jaccard similarity reaches `percent`. The result is each document's
connected component.

1. Equal sets are one (a 64-bit set id); all that follows works on distinct sets.
2. Partition into groups of similar sets, losing no link: sizes fall into
   intervals such that linked sets lie in one or in neighbouring ones. For each
   such neighbourhood the greatest difference d of linked sets is known, and the
   shingles are dealt by hash into more than d classes, so that linked sets
   agree in the whole content of some class. Shingles of very many documents say
   little and stay out of the classes, unless they are most of a set: leaving
   some out makes no difference greater. Sets that share the fingerprint of
   a class get into one candidate group (connected components over these).
   Within a slice of input, sets that share a fingerprint are joined at once and
   only one of them is shuffled, so a hot fingerprint stays small.
3. Each group stores a token-group matrix: the token union of every subgroup
   found so far. A set is a query against it: its overlap with a union bounds
   its similarity to every member, and only subgroups whose bound qualifies are
   opened and compared exactly. Groups above `block` sets are cut into blocks;
   blocks are linked first within, then through one set of each subgroup; of
   what is still apart, counts in hashed cells bound the overlap of any two sets
   of two blocks, and those that may link are compared. What goes to the blocks is
   the text of a set, or its hashes where these are shorter: hashes do not
   compress, and most sets of a large corpus share a group with some other.

Null, empty and odd input: documents without words, or with null text, have an
empty set and link with nothing; shorter texts than `k` words are one shingle. A
very long text is a block of the join by itself. An empty table gives an empty
result.
component_id is the smallest id in the component; rows without an id take part,
but name a component only if it has no other. Repeated rows are kept. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, discard, materialize, mix64, slices, table, tidy, word_hashes
from .graph import components

BASE = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    sizes, symbols = word_hashes([t.lower() if t else t for t in texts])  # bytes: ASCII letters only
    roll = RollingHash(symbols, BASE)
    grams = roll.windows(k)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        elif n:
            out.append(roll.at(np.array([at]), n) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def size_intervals(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Starts of size intervals, of about (100 / percent) squared. Sizes that may
    link are in one interval, or in neighbours, the greater then near its start."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * 10_000 // percent**2)))
    return np.array(out, dtype=np.int64)


def neighbourhoods(size: int, percent: int, starts: np.ndarray) -> list[int]:
    """The interval of a size, and the one before if that one's sets may reach."""
    j = interval_of(size, starts)
    return [j, j - 1] if j and percent * size < 100 * int(starts[j]) else [j]


def interval_of(size: int, starts: np.ndarray) -> int:
    return int(np.searchsorted(starts, size, side="right") - 1)


BUCKET_BITS = 20


def _bucket_counts(k: int):
    """Documents by bucket of their shingles' hashes, a total for each task in
    pieces: the size is fixed, whatever the input."""

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        if total.any():
            pieces = total.astype(np.uint32).reshape(64, -1)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(np.arange(64), pa.int32()), "counts": pa.array([x.tobytes() for x in pieces], pa.binary())})

    return run


def _add_counts(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in rows.column("counts").to_pylist())
    return pa.table({"piece": rows.column("piece").slice(0, 1), "total": pa.array([int(total.sum())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def common_buckets(texts: DataFrame, k: int, deviations: int = 6) -> np.ndarray:
    """Flags of the buckets that hold more than the mean by so many of its square
    roots: those of shingles that many documents have. Which buckets they are
    decides on speed alone; any choice loses no link."""
    counts = texts.mapInArrow(_bucket_counts(k), "piece int, counts binary").groupBy("piece").applyInArrow(_add_counts, "piece int, total long, counts binary")
    got = counts.collect()  # 64 pieces of a fixed size
    out = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for r in got:
        piece = np.frombuffer(r["counts"], dtype=np.int64)
        out[r["piece"] * len(piece) : (r["piece"] + 1) * len(piece)] = piece
    return out > max(out.mean() + deviations * np.sqrt(out.mean()), 16)


def class_fingerprints(own: np.ndarray, percent: int, starts: np.ndarray, common: np.ndarray | None = None) -> list[np.ndarray]:
    """Fingerprints of a set without its common shingles if they leave three
    tenths of it, of the whole set if they leave less than 65 hundredths: of two
    linked sets, both then show the one or both the other. A set whose rare
    shingles lie in too few classes shows the whole set too: where two linked sets
    are both like that, their agreement in the rare ones may be in empty classes
    only, which say nothing and are no key."""
    rare = own if common is None else own[~common[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]]
    out, thin = [], False
    if 10 * len(rare) >= 3 * len(own):
        out, thin = _class_fingerprints(rare, len(own), percent, starts, 0)
    if thin or 100 * len(rare) < 65 * len(own):
        out = out + _class_fingerprints(own, len(own), percent, starts, 1)[0]
    return out


def _class_fingerprints(own: np.ndarray, size: int, percent: int, starts: np.ndarray, mode: int) -> tuple[list[np.ndarray], bool]:
    """(fingerprints of the classes of a set in each of its neighbourhoods, where
    linked sets differ in d shingles at most; whether d + 1 classes or more had
    shingles in all of them). Each shingle in which two sets differ spoils one
    class, so of d + 1 classes with shingles one agrees at least, and empty ones
    stay out. Of d + 1 + spare classes, a set need not show `spare` of them: those
    of one shingle, which say little, stay out too if all that stay out are no
    more than that. Of two linked sets, what the one that hides more shows, the
    other shows too. Only sets of few shingles, in whole-set mode, may have to show
    empty classes."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(own))])
    out, thin = [], False
    for p in neighbourhoods(size, percent, starts):
        largest = int(starts[p + 1]) - 1
        d = (largest + largest * 100 // percent) * (100 - percent) // (100 + percent)
        spare = min(d, 2) + (d + 1) // 4
        n = d + 1 + spare
        step = (1 << 64) // n + 1
        edges = np.minimum(np.arange(n + 1, dtype=object) * step, (1 << 64) - 1).astype(np.uint64)
        at = np.searchsorted(own, edges)
        at[-1] = len(own)
        held = at[1:] - at[:-1]
        hide = next((h for h in (1, 0) if np.count_nonzero(held <= h) <= spare), -1)
        if hide < 0 and mode == 0:
            hide, thin = 0, True
        which = np.flatnonzero(held > hide)
        salt = mix64(which.astype(np.uint64) + np.uint64(p << 40 | mode << 60))
        out.append(mix64((sums[at[1:]] - sums[at[:-1]])[which] ^ salt))
    return out, thin


_SIG, _EDGE = 0, 1


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set, 0 for the empty one."""
    sums = np.array([np.sum(mix64(x ^ np.uint64(BASE))) + np.uint64(len(x)) if len(x) else 0 for x in sets], dtype=np.uint64)
    return np.where(sums == 0, sums, mix64(sums))


def _fingerprint(k: int, percent: int, common: np.ndarray):
    """(kind, a, b): class fingerprints with a set each, and links."""

    def rows(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def run(batches):
        starts = size_intervals(percent)
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            sid = set_ids(sets)
            _, first = np.unique(sid, return_index=True)
            sigs, owners = [], []
            for i in first.tolist():
                if len(sets[i]):
                    for f in class_fingerprints(sets[i], percent, starts, common):
                        sigs.append(f)
                        owners.append(np.full(len(f), sid[i], dtype=np.uint64))
            if not sigs:
                continue
            sig, owner = np.concatenate(sigs), np.concatenate(owners)
            order = np.lexsort((owner, sig))
            sig, owner = sig[order], owner[order]
            lead = np.ones(len(sig), dtype=bool)
            lead[1:] = sig[1:] != sig[:-1]
            yield rows(_SIG, sig[lead], owner[lead])
            low = owner[lead][np.cumsum(lead) - 1]
            joined = np.unique(np.stack([owner, low], axis=1)[~lead & (owner != low)], axis=0)
            if len(joined):
                yield rows(_EDGE, np.ascontiguousarray(joined[:, 0]), np.ascontiguousarray(joined[:, 1]))

    return run


def _describe(k: int, percent: int):
    """(id, sid, n, lots): the set of each row, its size and neighbourhoods."""

    def run(batches):
        starts = size_intervals(percent)
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            n = np.array([len(x) for x in sets], dtype=np.int64)
            lots = [neighbourhoods(x, percent, starts) for x in n.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(set_ids(sets).view(np.int64)), pa.array(n), pa.array(lots, pa.list_(pa.int32()))], ["id", "key", "sid", "n", "lots"])

    return run


def _runs(batches):
    """Links of every owner to the first owner of its fingerprint; the rows come
    sorted by fingerprint, and a run may go on in the next batch. Links among
    the rows pass through."""
    last_sig = last_owner = None
    for batch in batches:
        ready = batch.column("kind").to_numpy() == _EDGE
        sig, owner = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        pairs = [np.stack([sig[ready], owner[ready]], axis=1)]
        sig, owner = sig[~ready], owner[~ready]
        if len(sig):
            lead = np.ones(len(sig), dtype=bool)
            lead[1:] = sig[1:] != sig[:-1]
            firsts = owner[lead].copy()
            if last_sig is not None and sig[0] == last_sig:
                firsts[0] = last_owner
            low = firsts[np.cumsum(lead) - 1]
            last_sig, last_owner = sig[-1], firsts[-1]
            pairs.append(np.stack([owner, low], axis=1)[owner != low])
        own = np.unique(np.concatenate(pairs), axis=0)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[:, 0])), pa.array(np.ascontiguousarray(own[:, 1]))], ["a", "b"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


CELLS = 1 << 25


def columns_for(sets: list[np.ndarray], rows: int) -> int:
    """Columns of a matrix of so many rows: tokens are hashed to them, so that an
    overlap may count too much but never too little, and memory is bounded."""
    want = 4 * max((len(s) for s in sets), default=1)
    return int(max(1 << 10, min(1 << want.bit_length(), CELLS // max(1, rows))))


def overlaps(matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the columns `at` each row holds."""
    if matrix.shape[0] * len(at) <= 1 << 22:
        return np.count_nonzero(matrix[:, at], axis=1)
    return np.array([np.count_nonzero(row[at]) for row in matrix], dtype=np.int64)


class TokenGroupMatrix:
    """Subgroups of linked sets, with the token union of each as a matrix row."""

    def __init__(self, columns: int, percent: int):
        self.columns, self.percent = np.uint64(columns), percent
        self.matrix = np.zeros((4, columns), dtype=bool)
        self.members: list[list[int]] = []
        self.sets: list[np.ndarray] = []

    def add(self, own: np.ndarray) -> None:
        """Query one set, join it to every subgroup it links with."""
        at = (own % self.columns).astype(np.int64)
        number = len(self.sets)
        self.sets.append(own)
        bound = overlaps(self.matrix[: len(self.members)], at)
        hits = [g for g in np.flatnonzero(100 * bound >= self.percent * len(own)).tolist() if self.members[g] and any(similar(own, self.sets[m], self.percent) for m in reversed(self.members[g]))]
        if not hits:
            if len(self.members) == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            hits = [len(self.members)]
            self.members.append([])
        head = hits[0]
        for g in hits[1:]:
            self.members[head] += self.members[g]
            self.members[g] = []
            self.matrix[head] |= self.matrix[g]
            self.matrix[g] = False
        self.members[head].append(number)
        self.matrix[head, at] = True


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the position of the first set of its component."""
    tgm = TokenGroupMatrix(columns_for(sets, 2 * len(sets)), percent)
    order = np.argsort([len(s) for s in sets], kind="stable")
    for i in order.tolist():
        tgm.add(sets[i])
    root = np.zeros(len(sets), dtype=np.int64)
    for group in tgm.members:
        if group:
            own = order[group]
            root[own] = own.min()
    return root


_HASHES, _TEXT = b"\0", b"\1"


def pack(sets: list[tuple[bytes, int]], k: int) -> list[bytes]:
    """(text, size) of each set as its text, or as its hashes if they take less; the
    last byte tells which."""
    short = [i for i, (t, n) in enumerate(sets) if 8 * n < len(t)]
    hashes = dict(zip(short, shingle_sets([sets[i][0] for i in short], k)))
    return [hashes[i].tobytes() + _HASHES if i in hashes else t + _TEXT for i, (t, _) in enumerate(sets)]


def unpack(own: list[bytes], k: int, max_bytes: int = 4 << 20) -> list[np.ndarray]:
    """The sets again, about max_bytes of texts at a time."""
    out = [np.frombuffer(x, dtype=np.uint64, count=len(x) // 8) if x[-1:] == _HASHES else None for x in own]
    part, size = [], 0
    for i in [*(i for i, x in enumerate(out) if x is None), None]:
        if part and (i is None or size + len(own[i]) > max_bytes):
            for j, x in zip(part, shingle_sets([own[j][:-1] for j in part], k)):
                out[j] = x
            part, size = [], 0
        if i is not None:
            part.append(i)
            size += len(own[i])
    return out


def _link(k: int, percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sid = pdf["sid"].to_numpy()
        root = link_sets(unpack(pdf["own"].tolist(), k), percent)
        return pd.DataFrame({"a": sid, "b": sid[root]})

    return run


def _across(k: int, percent: int):
    """Links between two blocks of one group, only between parts still apart."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            sets = unpack(right["own"].tolist(), k)
            roots, place = np.unique(right["root"].to_numpy(), return_inverse=True)
            columns = np.uint64(columns_for(sets, len(roots)))
            matrix = np.zeros((len(roots), int(columns)), dtype=bool)
            for g, s in zip(place, sets):
                matrix[g, (s % columns).astype(np.int64)] = True
            done = set()
            for sid, root, own in zip(left["sid"], left["root"], unpack(left["own"].tolist(), k)):
                at = (own % columns).astype(np.int64)
                bound = overlaps(matrix, at)
                for g in np.flatnonzero(100 * bound >= percent * len(own)).tolist():
                    if roots[g] == root or (root, g) in done:
                        continue
                    if any(similar(own, sets[m], percent) for m in np.flatnonzero(place == g)):
                        done.add((root, g))
                        out.append((sid, right["sid"].iloc[int(np.flatnonzero(place == g)[0])]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


CELLS_OF_SKETCH = 1024


def _sketch(k: int):
    """Counts of a set's shingles in hashed cells: the sum of the lesser counts
    of two sets is at least their overlap."""

    def run(batches):
        for batch in slices(batches, "own"):
            sets = unpack(batch.column("own").to_pylist(), k)
            out = [np.bincount((x % np.uint64(CELLS_OF_SKETCH)).astype(np.int64), minlength=CELLS_OF_SKETCH).astype(np.uint16).tobytes() for x in sets]
            names = ["grp", "blk", "sid", "root"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array([len(x) for x in sets], pa.int32()), pa.array(out, pa.binary())], [*names, "n", "sketch"])

    return run


def _suspects(percent: int):
    """The sets of two blocks that may link with one of another part there."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = (np.stack([np.frombuffer(x, dtype=np.uint16) for x in df["sketch"]]) for df in (left, right))
            na, nb = left["n"].to_numpy(), right["n"].to_numpy()
            ra, rb = left["root"].to_numpy(), right["root"].to_numpy()
            hit = np.zeros(len(right), dtype=bool)
            keys = [left[c].iloc[0] for c in ("grp", "blk", "blk2")]
            for i in range(len(left)):
                near = np.flatnonzero((rb != ra[i]) & (100 * np.minimum(nb, na[i]) >= percent * np.maximum(nb, na[i])))
                both = np.minimum(b[near], a[i]).sum(axis=1, dtype=np.int64)
                near = near[100 * both >= percent * (nb[near] + na[i] - both)]
                if len(near):
                    hit[near] = True
                    out.append((*keys, left["sid"].iloc[i], 0))
            out += [(*keys, x, 1) for x in right["sid"].to_numpy()[hit]]
        return pd.DataFrame(out, columns=["grp", "blk", "blk2", "sid", "side"]).astype("int64")

    return run


_PLACES = "array<struct<grp:long,blk:int,m:long>>"


def _packed(k: int):
    """(sid, places, own) of each set. Rows of one id and text follow each other and
    count once; any that come twice all the same would link with themselves."""

    def run(batches):
        last = None
        for batch in slices(batches, "text"):
            sid = batch.column("sid").to_numpy()
            lead = np.ones(len(sid), dtype=bool)
            lead[1:] = sid[1:] != sid[:-1]
            lead[0] = sid[0] != last
            last = sid[-1]
            batch = batch.filter(pa.array(lead))
            own = pack(list(zip(batch.column("text").to_pylist(), batch.column("n").to_pylist())), k)
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("places"), pa.array(own, pa.binary())], ["sid", "places", "own"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, block: int = 1500, tokens: int = 3_000_000) -> DataFrame:
    """id, n_shingles and component_id of each row."""
    return _components(docs, id_col, text_col, k, percent, block, tokens).select("id", "n_shingles", "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, block: int = 1500, tokens: int = 3_000_000) -> DataFrame:
    """Those, and part, which tells components apart, and key, a hash of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if rows.schema["id"].dataType.simpleString() != "string":
        rows = rows.withColumn("id", F.col("id").cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("key", F.xxhash64("text"))
    own = materialize(rows.mapInArrow(_describe(k, percent), f"id {kind}, key long, sid long, n long, lots array<int>"))
    common = common_buckets(rows.select("text"), k)
    sigs = rows.select("text").mapInArrow(_fingerprint(k, percent, common), "kind tinyint, a long, b long").repartition("a").sortWithinPartitions("a", "b")
    groups = materialize(components(sigs.mapInArrow(_runs, "a long, b long")))  # node, root: candidate groups of sets
    del sigs
    tidy(docs.sparkSession)
    # one document of each distinct set in a group brings the set itself
    heads = own.where(F.col("n") > 0).groupBy("sid").agg(F.min(F.struct("id", "key")).alias("head"), F.max("n").alias("n"), F.first("lots").alias("lots")).join(groups, F.col("sid") == F.col("node")).select("sid", "head", "n", F.explode("lots").alias("lot"), F.col("root").alias("grp"))
    # sets link within a neighbourhood of sizes only: a group for each
    # blocks hold about `block` sets, and not more than about `tokens` shingles; a
    # hash deals a large group into even blocks without sorting it anywhere
    size = heads.groupBy("grp", "lot").agg(F.count("*").alias("held"), F.greatest(F.count("*"), F.ceil(F.sum("n") * block / tokens)).alias("m")).where("held > 1")
    # a large group's sets meet its size in sixteen tasks
    salt = F.expr("pmod(xxhash64(sid, 2), 16)").cast("int")
    heads = heads.withColumn("salt", salt).join(size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["grp", "lot", "salt"])
    heads = materialize(heads.select("sid", "head", "n", "m", F.xxhash64("grp", "lot").alias("grp"), F.expr(f"pmod(xxhash64(sid), ceil(m / {block}))").cast("int").alias("blk")))
    wanted = heads.groupBy("sid").agg(F.min("head").alias("head"), F.max("n").alias("n"), F.collect_list(F.struct("grp", "blk", "m")).alias("places"))
    # the wanted ids grow with the corpus: never broadcast
    texts = rows.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))).select("sid", "n", F.col("places").cast(_PLACES).alias("places"), "text")
    # texts go from here to their blocks at once, and are dealt by nothing in between
    packed = texts.mapInArrow(_packed(k), f"sid long, places {_PLACES}, own binary")
    blocked = materialize(packed.select("sid", "own", F.explode("places").alias("at")).select("at.grp", "at.blk", "sid", "at.m", "own"))
    del packed, texts
    tidy(docs.sparkSession)
    links = materialize(blocked.groupBy("grp", "blk").applyInPandas(_link(k, percent), "a long, b long"))
    over = blocked.where(F.col("m") > block)
    if over.limit(1).count():
        sets = over.select("sid", "own").dropDuplicates(["sid"])
        places = over.select("grp", "blk", "sid", "m")  # joined without the sets
        heads2 = places.join(links.where(F.col("a") == F.col("b")).select(F.col("a").alias("sid")).distinct(), "sid", "left_semi")
        heads2 = heads2.select("grp", "sid", F.expr(f"pmod(xxhash64(sid, 1), ceil(m / {2 * block}))").cast("int").alias("lot")).join(sets, "sid")
        links = materialize(links.unionByName(heads2.select("grp", "lot", "sid", "own").groupBy("grp", "lot").applyInPandas(_link(k, percent), "a long, b long")))
        roots = components(links).withColumnRenamed("node", "sid")
        parts = places.drop("m").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        apart = parts.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("grp")
        parts = materialize(parts.join(apart, "grp", "left_semi").select("grp", "blk", "sid", "root"))
        blks = parts.select("grp", "blk").distinct()
        pairs = blks.join(blks.withColumnRenamed("blk", "blk2"), "grp").where("blk <= blk2")
        # counts in hashed cells tell which sets need comparing at all
        keys = ["grp", "blk", "blk2"]
        small = materialize(parts.join(sets, "sid").select("grp", "blk", "sid", "root", "own").mapInArrow(_sketch(k), "grp long, blk int, sid long, root long, n int, sketch binary"))
        cols = [*keys, "sid", "root", "n", "sketch"]
        left = small.join(pairs, ["grp", "blk"]).select(cols).toDF(*cols)
        right = small.withColumnRenamed("blk", "blk2").join(pairs, ["grp", "blk2"]).select(cols).toDF(*cols)
        near = materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_suspects(percent), "grp long, blk long, blk2 long, sid long, side long"))
        cols = [*keys, "sid", "own", "root"]
        named = parts.select("grp", "sid", "root")
        left = near.where("side = 0").drop("side").join(named, ["grp", "sid"]).join(sets, "sid").select(cols).toDF(*cols)
        right = near.where("side = 1").drop("side").join(named, ["grp", "sid"]).join(sets, "sid").select(cols).toDF(*cols)
        more = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_across(k, percent), "a long, b long")
        links = links.unionByName(materialize(more))
    linked = components(links.where("a <> b"))
    discard(blocked)
    tidy(docs.sparkSession)
    named = own.join(linked, own["sid"] == F.col("node"), "left").select("id", "key", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("part"), F.expr("pmod(xxhash64(id, key), 16)").cast("int").alias("salt"))
    least = named.where(F.col("part").isNotNull()).groupBy("part").agg(F.min("id").alias("low"), F.count("*").alias("held")).where(F.col("held") > 1).select("part", "low")
    out = named.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["part", "salt"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"), "part", "key")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns kept, that name their component: one of each
    group of linked documents stays. Rows of one id stay apart if they are not
    linked, and one of them stays if they are; of rows without words, which link
    with nothing, one of each (id, text) stays. Rows without an id, which cannot be
    told apart, all stay."""
    parts = materialize(_components(docs, id_col, text_col, k, percent))
    kept = parts.where(F.col("component_id") == F.col("id")).groupBy("id", F.coalesce("part", "key").alias("part")).agg(F.min("key").alias("kept_key"))
    kept = kept.select(F.col("id").alias("kept_id"), "kept_key")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.xxhash64(F.col(text_col).cast("binary")).alias("key"))
    met = rows.join(kept, (F.col("i") == F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    # exact repeats of a kept row are told by a count, so that only they are dealt again
    again = parts.where(F.col("component_id") == F.col("id")).groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again_id"), F.col("key").alias("again_key"), F.lit(True).alias("again"))
    met = met.join(again, (F.col("i") == F.col("again_id")) & (F.col("key") == F.col("again_key")), "left")
    first = met.where(F.col("again").isNotNull()).dropDuplicates(["i", "key"]).select("row.*")
    return met.where(F.col("again").isNull()).select("row.*").unionByName(first).unionByName(docs.where(F.col(id_col).isNull()))


def op3_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id FROM sets s
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
