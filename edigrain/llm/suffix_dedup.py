"""Suffix-array dedup of byte strings.

A byte is removed if a string of `width` bytes that covers it also starts in a
document with a smaller id. Documents are dealt into shards of about
`shard_bytes`.

Within a shard, a suffix array decides: suffixes are sorted by their first eight
bytes, then refined by the ranks of the suffixes 8, 16, 32 ... bytes on (Larsson
and Sadakane), only groups still tied taking part. Kasai's scan, run over many
pieces of the text in step, gives the common prefixes of neighbours; neighbours
that share `width` bytes form a group, and all its places in documents greater
than its least lose these bytes. Left out of the array are the stretches of text
in which no window can repeat, as its anchor (see below) stands once in the shard.

Across shards, sorted lists are merged by binary search, each key's place in the
merged list telling which shards hold it. So that not every byte is a key, only
anchors are: of each window of `width` bytes, its gram of `gram` bytes with the
least hash. Equal windows have equal anchors, and consecutive windows with one
anchor form a run (see runs.py). Shards send, in sorted and packed lists dealt by
range:

1. anchors (5 bytes each), and learn which of them another shard has too;
2. of these anchors, their runs (64-bit fingerprints) with the least id that holds
   them, and learn the least id of all shards, and which anchors have several
   runs;
3. of runs of such anchors that no smaller document holds whole, the fingerprints
   of their single windows, and learn the least id of each.

A reply is as long as the list sent and in its order, so it holds no keys. A list
has one entry of a key for each shard, however often the shard holds it: a
passage that a third of all documents share is one entry a shard. Lists shorten
as shards and ranges grow in number; from some 10 TB on, give larger
`shard_bytes` and `range_keys`.

Null, empty and odd input: null and empty texts have no bytes. Rows without an
id count as greater than all ids. Repeated rows, and rows with one id, don't
remove from each other; each gets its row. A text longer than a shard is a shard
of its own, whole. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, table
from .runs import Runs
from .substring_dedup import ranges

_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64))
LAST = (1 << 63) - 1
#: Kinds of lists.
ANCHORS, KINDS, RUNS, WINDOWS, HEARD = range(5)
_LIST = "step int, part int, shard long, keys binary, vals binary"
_REPLY = "step int, part int, shard long, vals binary"


def _bytes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if not len(texts) or pa.types.is_large_binary(texts.type):
        own = [t or b"" for t in texts.to_pylist()]
        return np.frombuffer(b"".join(own), dtype=np.uint8), np.array([len(t) for t in own], dtype=np.int64)
    one = pa.compute.fill_null(texts, b"").combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    edges = np.frombuffer(one.buffers()[1], dtype=np.int32)[one.offset : one.offset + len(one) + 1].astype(np.int64)
    data = np.frombuffer(one.buffers()[2] or b"", dtype=np.uint8)
    return data[edges[0] : edges[-1]], np.diff(edges)


def key8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, zeros after the end."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, dtype=np.uint8)])
    out = np.empty(n, dtype=np.uint64)
    for i in range(min(8, n)):
        own = out[i::8]
        own[:] = padded[i : i + 8 * len(own)].view(">u8")
    return out


def suffix_array(text: np.ndarray, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each, places that share with another place the
    most of 8, 16, 32 ... bytes that are no more than `width`, in text order)."""
    n = len(text)
    keys = key8(text)
    order = np.argsort(keys)
    keys = keys[order]
    lead = np.ones(n, dtype=bool)
    lead[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(lead)
    size = np.diff(np.append(first, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, size)  # a group's rank is its first place
    at = np.flatnonzero(np.repeat(size > 1, size))
    group = np.repeat(first[size > 1], size[size > 1])
    h, sharing = 8, np.arange(n)
    while len(at):
        own = order[at]
        if h <= width:
            sharing = np.sort(own)
        further = np.where(own + h < n, rank[np.minimum(own + h, n - 1)] + n, n - 1 - own)  # past the end: the shorter first
        pair = group.astype(np.uint64) << np.uint64(32) | further.astype(np.uint64)
        by = np.argsort(pair)
        own, pair = own[by], pair[by]
        order[at] = own
        new = np.ones(len(at), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        rank[own] = np.repeat(at[start], size)
        group = np.repeat(at[start][size > 1], size[size > 1])
        at = at[np.repeat(size > 1, size)]
        h *= 2
    return order, rank, sharing


def kasai(text: np.ndarray, order: np.ndarray, cap: int, places: np.ndarray | None = None, most: int = 512) -> np.ndarray:
    """Common prefix, up to cap, of each suffix in `order` with the one before; of
    suffixes at other places than `places` (sorted) 0. The places are cut into
    stretches of up to `most`; each follows Kasai's scan from its first place."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.int16), np.full(cap + 1, -1, dtype=np.int16)])
    other = padded.copy()
    other[n:] = -2
    common = np.zeros(n, dtype=np.int64)
    places = np.arange(n) if places is None else places
    new = np.ones(len(places), dtype=bool)
    new[1:] = places[1:] != places[:-1] + 1
    lead = np.flatnonzero(new)
    inner = np.arange(len(places)) - np.repeat(lead, np.diff(np.append(lead, len(places))))
    lead = np.flatnonzero(inner % most == 0)
    at, stop = places[lead], places[lead] + np.diff(np.append(lead, len(places)))
    held = np.zeros(len(at), dtype=np.int64)
    while len(at):
        prev = before[at]
        more = (prev >= 0) & (held < cap)
        more &= padded[np.minimum(at + held, n + cap)] == other[np.minimum(np.maximum(prev, 0) + held, n + cap)]
        held = held + more
        done = ~more
        common[at[done]] = np.where(prev[done] >= 0, held[done], 0)
        held = np.where(done, np.maximum(np.where(prev >= 0, held, 0) - 1, 0), held)
        at = at + done
        live = at < stop
        if not live.all():
            at, stop, held = at[live], stop[live], held[live]
    return common[order]


def repeats_within(text: np.ndarray, sizes: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Places of windows that also start in a smaller document of the same text."""
    if len(text) < 2:
        return np.zeros(0, dtype=np.int64)
    order, _, sharing = suffix_array(text, width)
    common = kasai(text, order, width, sharing)
    joined = np.flatnonzero(common >= width)
    if not len(joined):
        return joined
    member = np.zeros(len(text), dtype=bool)
    member[joined] = member[joined - 1] = True
    at = np.flatnonzero(member)
    place = order[at]
    lead = np.flatnonzero(common[at] < width)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, place, side="right")
    whole = ends[owner] - place >= width
    own = np.where(whole, doc[owner], LAST)
    least = np.repeat(np.minimum.reduceat(own, lead), np.diff(np.append(lead, len(at))))
    return place[whole & (own > least)]


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    out = np.sort(values)
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    return out[new]


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, number of each value)."""
    order = np.argsort(values)
    own = values[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    which = np.empty(len(own), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return own[new], which


def stretches(runs: Runs, keep: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes, sizes, documents) of the stretches that these runs cover."""
    start, end, doc = runs.start[keep], runs.start[keep] + runs.count[keep] + width - 1, runs.doc[keep]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    lead = np.flatnonzero(new)
    return start[lead], end[np.append(lead[1:], len(start)) - 1][: len(lead)] - start[lead], doc[lead]


def _parts(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, first, end) of sorted keys, dealt by range."""
    edges = np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    return [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]


def _pack5(keys: np.ndarray) -> np.ndarray:
    """The upper 40 bits. Keys that only differ below count as one, which can make
    more anchors shared, or of several runs, but none fewer."""
    return keys.view(np.uint8).reshape(-1, 8)[:, 3:]


def _unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, 3:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _lists(shard: int, parts: int, *lists) -> pa.Table:
    """Packed lists of (step, sorted keys, values or None)."""
    step, part, keys, vals = [], [], [], []
    for kind, own, with_ in lists:
        for p, a, b in _parts(own, parts):
            step.append(kind)
            part.append(p)
            keys.append((_pack5(own[a:b]) if kind in (ANCHORS, KINDS) else own[a:b]).tobytes())
            vals.append(None if with_ is None else with_[a:b].tobytes())
    return pa.table({"step": pa.array(step, pa.int32()), "part": pa.array(part, pa.int32()), "shard": pa.array([shard] * len(step), pa.int64()), "keys": pa.array(keys, pa.binary()), "vals": pa.array(vals, pa.binary())})


def merge_lists(lists: pa.Table) -> pa.Table:
    """Merge the shards' sorted lists of one range, and reply to each of them.
    Replies of earlier lists (HEARD) pass through."""
    step = lists.column("step")[0].as_py()
    if step >= HEARD:
        return pa.table({"step": pa.array([step - HEARD] * lists.num_rows, pa.int32()), "part": lists.column("part"), "shard": lists.column("shard"), "vals": lists.column("vals")})
    read = _unpack5 if step in (ANCHORS, KINDS) else lambda b: np.frombuffer(b, dtype=np.uint64)
    keys = [read(b) for b in lists.column("keys").to_pylist()]
    if step == ANCHORS:
        every = np.sort(np.concatenate([distinct(k) for k in keys]))
        several = np.append(distinct(every[1:][every[1:] == every[:-1]]), np.uint64(LAST) * np.uint64(2))
        replies = [np.packbits(several[np.searchsorted(several[:-1], k)] == k).tobytes() for k in keys]
    else:
        merged = distinct(np.concatenate(keys))
        place = [np.searchsorted(merged, k) for k in keys]
        kind = np.uint64 if step == KINDS else np.int64
        vals = [np.frombuffer(b, dtype=kind) for b in lists.column("vals").to_pylist()]
        low, high = np.full(len(merged), np.iinfo(kind).max, dtype=kind), np.zeros(len(merged), dtype=kind)
        for p, v in zip(place, vals):
            np.minimum.at(low, p, v)
            if step == KINDS:
                np.maximum.at(high, p, v)
        replies = [np.packbits((low[p] != high[p]) | (low[p] == 0)).tobytes() if step == KINDS else np.where(low[p] < v, low[p], LAST).tobytes() for p, v in zip(place, vals)]
    return pa.table({"step": lists.column("step"), "part": lists.column("part"), "shard": lists.column("shard"), "vals": pa.array(replies, pa.binary())})


def _heard(lists: pa.Table, back: pa.Table) -> pa.Table:
    """Lists, and what was heard before, to be sent along."""
    old = pa.table({"step": pa.array([x + HEARD for x in back.column("step").to_pylist()], pa.int32()), "part": back.column("part"), "shard": back.column("shard"), "keys": pa.array([None] * back.num_rows, pa.binary()), "vals": back.column("vals")})
    return pa.concat_tables([lists, old.cast(lists.schema)])


class Shard:
    """A shard's runs, and what the replies say of them. Everything is in the
    order of keys, so it does not depend on the order of rows."""

    def __init__(self, docs: pa.Table, back: pa.Table, width: int, gram: int, parts: int):
        self.text, self.sizes = _bytes(docs.column("text"))
        self.doc = docs.column("doc").to_numpy()
        self.runs = Runs(self.text, self.sizes, width, gram, _SYMBOL)
        self.back, self.parts, self.width = back, parts, width
        anchors, which = numbered(self.runs.anchor)
        shared = self._read(ANCHORS, anchors)
        own = np.flatnonzero(shared[which])
        self.anchors = anchors[shared]
        self.start, self.count = self.runs.start[own], self.runs.count[own]
        self.anchor = (np.cumsum(shared) - 1)[which[own]]
        self.again = np.flatnonzero(np.bincount(which, minlength=len(anchors))[which] > 1)  # runs whose anchor the shard has again
        self.print, self.owner = self.runs.print[own], self.doc[self.runs.doc[own]]
        self.prints, self.kind = numbered(self.print)

    def _read(self, step: int, keys: np.ndarray) -> np.ndarray:
        own = self.back.filter(pa.compute.equal(self.back.column("step"), step)) if self.back.num_rows else self.back
        got = dict(zip(own.column("part").to_pylist(), own.column("vals").to_pylist()))
        if step in (ANCHORS, KINDS):
            out = [np.unpackbits(np.frombuffer(got[p], dtype=np.uint8), count=b - a).astype(bool) for p, a, b in _parts(keys, self.parts)]
            return np.concatenate([np.zeros(0, dtype=bool), *out])
        return np.concatenate([np.zeros(0, dtype=np.int64), *(np.frombuffer(got[p], dtype=np.int64) for p, _, _ in _parts(keys, self.parts))])

    def least(self, of: np.ndarray, n: int) -> np.ndarray:
        """Least id of the documents that hold each run."""
        out = np.full(n, LAST, dtype=np.int64)
        np.minimum.at(out, of, self.owner)
        return out

    def hear_runs(self) -> None:
        """low: the least id of each run, if less than the shard's own; unsettled:
        runs of anchors with several runs that no smaller document holds whole."""
        self.low = self._read(RUNS, self.prints)[self.kind]
        self.unsettled = np.flatnonzero(self._read(KINDS, self.anchors)[self.anchor] & (self.low == LAST))

    def repeats(self) -> np.ndarray:
        """Places of windows that also start in a smaller document of the shard."""
        first, size, doc = stretches(self.runs, self.again, self.width)
        part = np.repeat(first, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        return part[repeats_within(self.text[part], size, self.doc[doc], self.width)]

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, fingerprints, ids) of the windows of runs."""
        at, window = self.runs.windows(self.start[runs], self.count[runs])
        return at, window, np.repeat(self.owner[runs], self.count[runs])


def _send_anchors(width: int, gram: int, parts: int):
    def run(docs: pa.Table) -> pa.Table:
        text, sizes = _bytes(docs.column("text"))
        return _lists(docs.column("shard")[0].as_py(), parts, (ANCHORS, distinct(Runs(text, sizes, width, gram, _SYMBOL).anchor), None))

    return run


def _send_runs(width: int, gram: int, parts: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        s = Shard(docs, back, width, gram, parts)
        low, high = np.full(len(s.anchors), np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(len(s.anchors), dtype=np.uint64)
        np.minimum.at(low, s.anchor, s.print)
        np.maximum.at(high, s.anchor, s.print)
        own = _lists(docs.column("shard")[0].as_py(), parts, (KINDS, s.anchors, np.where(low == high, low, np.uint64(0))), (RUNS, s.prints, s.least(s.kind, len(s.prints))))
        return _heard(own, back)

    return run


def _send_windows(width: int, gram: int, parts: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        s = Shard(docs, back, width, gram, parts)
        s.hear_runs()
        own = s.unsettled[s.owner[s.unsettled] == s.least(s.kind, len(s.prints))[s.kind[s.unsettled]]]  # its first holder stands for a run
        _, window, doc = s.windows(own)
        keys, which = numbered(window)
        least = np.full(len(keys), LAST, dtype=np.int64)
        np.minimum.at(least, which, doc)
        return _heard(_lists(docs.column("shard")[0].as_py(), parts, (WINDOWS, keys, least)), back)

    return run


def _remove(width: int, gram: int, parts: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        s = Shard(docs, back, width, gram, parts)
        s.hear_runs()
        whole = s.low != LAST
        at, window, _ = s.windows(s.unsettled)
        keys, which = numbered(window)
        lost = (s._read(WINDOWS, keys) != LAST)[which]
        start = np.concatenate([s.start[whole], at[lost], s.repeats()])
        size = np.concatenate([s.count[whole] + width - 1, np.full(len(start) - int(whole.sum()), width)])
        edge = np.zeros(len(s.text) + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        sums, spans, removed = [], [], []
        here = 0
        for n in s.sizes.tolist():
            own, off = s.text[here : here + n], gone[here : here + n]
            removed.append(int(off.sum()))
            sums.append(hashlib.sha256((own[~off] if removed[-1] else own).tobytes()).hexdigest())
            spans.append(ranges(off) if removed[-1] else [])
            here += n
        return pa.table({
            "id": docs.column("id"), "n_bytes": pa.array(s.sizes), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()),
            "kept_sha256": pa.array(sums, pa.string()), "spans": pa.array([",".join(f"{a}:{b}" for a, b in x) for x in spans], pa.string()),
        })

    return run


def remove_earlier_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 24, shard_bytes: int = 2 << 20, range_keys: int = 1 << 20) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans ("first byte:end",
    removed) of each row."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    shards = total // shard_bytes + 1
    parts = max(16, 2 * total // (width - gram) // range_keys + 1)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.expr(f"pmod(xxhash64(`{id_col}`, `{text_col}`), {shards})").alias("shard"),
    ).repartition("shard").groupBy("shard")
    how = (width, gram, parts)
    merge = lambda lists: lists.groupBy("step", "part").applyInArrow(merge_lists, _REPLY)
    back = merge(rows.applyInArrow(_send_anchors(*how), _LIST))
    back = merge(rows.cogroup(back.groupBy("shard")).applyInArrow(_send_runs(*how), _LIST))
    back = merge(rows.cogroup(back.groupBy("shard")).applyInArrow(_send_windows(*how), _LIST))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.cogroup(back.groupBy("shard")).applyInArrow(_remove(*how), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def op6_suffix_dedup(spark, sf_dir):
    return remove_earlier_strings(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
