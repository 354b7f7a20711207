"""Substring dedup with repeated-phrase automata.

1. Documents are dealt into shards of about `shard_rows`. Each shard reports its
   distinct runs of windows (see runs.py) with their numbers.
2. Recurring passages are confirmed corpus-wide: a run that occurs twice or more
   is one; where an anchor occurs in different runs, their single windows are
   counted too, and the stretches of a run whose windows recur are passages.
3. A shard's confirmed passages - one place of each, however often the shard has
   it - are compiled into an Aho-Corasick automaton over its words, and all
   documents of the shard are streamed through it, which locates every
   occurrence. A shard bounds the automaton, and every shard has its own.
4. Words covered by an occurrence are removed.

A word is its bytes between ASCII spaces; a window that occurs twice within one
document counts as recurring. Passages are confirmed by two 64-bit fingerprints
(anchor and run, or anchor and window).

Null, empty and odd input: null and empty texts have no words. Texts shorter
than a window keep all words. Repeated rows, and rows with one id, are different
documents; each gets its own row. Rows without an id are kept. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, word_hashes
from .runs import Prints, Runs, first_of

def _places(docs: pa.Table, refs: pa.Table, offset: np.ndarray) -> np.ndarray:
    """Array places of refs (dk, start): any row with that key will do."""
    row = {k: i for i, k in enumerate(docs.column("dk").to_pylist())}
    doc = np.fromiter((row[k] for k in refs.column("dk").to_pylist()), dtype=np.int64, count=refs.num_rows)
    return offset[doc] + refs.column("start").to_numpy()


def _report(width: int, gram: int):
    def run(docs: pa.Table) -> pa.Table:
        sizes, symbols = word_hashes(docs.column("text").to_pylist())
        runs = Runs(symbols, sizes, width, gram)
        pick, n = first_of(runs.anchor, runs.print)
        dk = docs.column("dk").to_numpy()
        return pa.table({
            "shard": pa.array(np.full(len(pick), docs.column("shard")[0].as_py()), pa.int64()),
            "anchor": runs.anchor[pick].view(np.int64), "print": runs.print[pick].view(np.int64), "n": pa.array(n, pa.int64()),
            "dk": dk[runs.doc[pick]], "start": pa.array(runs.start[pick] - runs.offset[runs.doc[pick]], pa.int32()), "count": pa.array(runs.count[pick], pa.int32()),
        })

    return run


_REPORT = "shard long, anchor long, print long, n long, dk long, start int, count int"


def _single(width: int):
    """Distinct windows of a shard's open runs, with their numbers: a run that
    stands for equal ones elsewhere counts as often as they are."""

    def run(docs: pa.Table, refs: pa.Table) -> pa.Table:
        if not docs.num_rows or not refs.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("shard", "anchor", "window", "n")})
        sizes, symbols = word_hashes(docs.column("text").to_pylist())
        prints = Prints(symbols, sizes, width)
        count = refs.column("count").to_numpy().astype(np.int64)
        _, window = prints.windows(_places(docs, refs, prints.offset), count)
        own = np.repeat(np.arange(len(count)), count)
        anchor = refs.column("anchor").to_numpy()[own]
        order = np.lexsort((window, anchor))
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = (anchor[order][1:] != anchor[order][:-1]) | (window[order][1:] != window[order][:-1])
        first = np.flatnonzero(lead)
        n = np.add.reduceat(refs.column("n").to_numpy()[own][order], first)
        return pa.table({"shard": pa.array(np.full(len(first), docs.column("shard")[0].as_py()), pa.int64()), "anchor": anchor[order[first]], "window": window[order[first]].view(np.int64), "n": pa.array(n, pa.int64())})

    return run


_SINGLE = "shard long, anchor long, window long, n long"
#: Kinds of what a shard gets back: a passage, an open run, a recurring window.
_WHOLE, _OPEN, _WINDOW = 0, 1, 2


def recurring_windows(prints: Prints, place: np.ndarray, count: np.ndarray, recurring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of the run) of the windows of open runs that recur."""
    at, window = prints.windows(place, count)
    own = np.repeat(np.arange(len(count)), count)
    known = np.sort(recurring)
    near = np.minimum(np.searchsorted(known, window), len(known) - 1)
    hit = known[near] == window
    return at[hit], own[hit]


def stretches(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the stretches of following windows of one group."""
    if not len(at):
        return at, at
    order = np.lexsort((at, group))
    at, group = at[order], group[order]
    lead = np.ones(len(at), dtype=bool)
    lead[1:] = (group[1:] != group[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(lead)
    return at[first], at[np.append(first[1:], len(at)) - 1] - at[first] + 1


def passages_of(prints: Prints, docs: pa.Table, sizes: np.ndarray, refs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(places, words) of the passages of a shard. Runs that the shard has once
    are joined with those that follow them; one that it has several times is a
    passage of its own, as its other places may be followed by something else."""
    kind = refs.column("kind").to_numpy()
    runs = refs.filter(pa.array(kind != _WINDOW))
    place, count, many = _places(docs, runs, prints.offset), runs.column("count").to_numpy().astype(np.int64), runs.column("n").to_numpy() > 1
    is_open = runs.column("kind").to_numpy() == _OPEN
    recurring = refs.column("dk").to_numpy()[kind == _WINDOW].view(np.uint64)
    at, own = prints.windows(place[~is_open], count[~is_open])[0], np.repeat(np.flatnonzero(~is_open), count[~is_open])
    if is_open.any() and len(recurring):
        more, which = recurring_windows(prints, place[is_open], count[is_open], recurring)
        at, own = np.concatenate([at, more]), np.concatenate([own, np.flatnonzero(is_open)[which]])
    doc = np.searchsorted(prints.offset + sizes, at, side="right")
    joined, single = stretches(at[~many[own]], doc[~many[own]]), stretches(at[many[own]], own[many[own]])
    return np.concatenate([joined[0], single[0]]), np.concatenate([joined[1], single[1]]) + prints.width - 1


def build_automaton(passages: list[list[bytes]]) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """Automaton over word numbers that reports the lengths of found passages."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for words in passages:
        automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words), len(words))
    automaton.make_automaton()
    return automaton, numbers


def covered(words: list[bytes], automaton: ahocorasick.Automaton, numbers: dict[bytes, int]) -> np.ndarray:
    """Words of a document that an occurrence of a passage covers."""
    get = numbers.get
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for end, size in automaton.iter(tuple([get(w, 0) for w in words])):
        edge[end - size + 1] += 1
        edge[end + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def _remove(width: int):
    def run(docs: pa.Table, refs: pa.Table) -> pa.Table:
        texts = docs.column("text").to_pylist()
        words = [t.split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        automaton = None
        if refs.num_rows and docs.num_rows:
            prints = Prints(word_hashes(texts)[1], sizes, width)
            at, n = passages_of(prints, docs, sizes, refs)
            doc = np.searchsorted(prints.offset + sizes, at, side="right")
            inner = at - prints.offset[doc]
            passages = [words[d][s : s + m] for d, s, m in zip(doc.tolist(), inner.tolist(), n.tolist())]
            automaton, numbers = build_automaton(passages)
        removed, sums, spans = [], [], []
        for own in words:
            gone = covered(own, automaton, numbers) if automaton is not None and len(own) >= width else np.zeros(len(own), dtype=bool)
            kept = own if not gone.any() else [w for w, g in zip(own, gone.tolist()) if not g]
            removed.append(int(gone.sum()))
            sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append(",".join(f"{a}:{b}" for a, b in ranges(gone)) if removed[-1] else "")
        return pa.table({"id": docs.column("id"), "n_words": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string()), "spans": pa.array(spans, pa.string())})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, gram: int = 8, shard_rows: int = 1000) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and spans ("first word:end", removed)
    of each row."""
    shards = max(1, -(-docs.count() // shard_rows))
    dk = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), dk.alias("dk"))
    rows = rows.withColumn("shard", F.expr(f"pmod(dk, {shards})")).repartition("shard")
    found = rows.groupBy("shard").applyInArrow(_report(width, gram), _REPORT).repartition("anchor")
    run, anchor = Window.partitionBy("anchor", "print"), Window.partitionBy("anchor")
    found = found.withColumn("total", F.sum("n").over(run)).withColumn("nth", F.row_number().over(run.orderBy("dk", "start")))
    found = found.withColumn("kinds", F.min("print").over(anchor) != F.max("print").over(anchor)).where((F.col("total") > 1) | F.col("kinds"))
    open_runs = found.where(F.col("kinds") & (F.col("nth") == 1)).select("shard", "anchor", "dk", "start", "count", F.col("total").alias("n"))
    single = rows.groupBy("shard").cogroup(open_runs.groupBy("shard")).applyInArrow(_single(width), _SINGLE).repartition("window")
    window = single.withColumn("total", F.sum("n").over(Window.partitionBy("window", "anchor"))).where(F.col("total") > 1)
    kind = F.when(F.col("total") > 1, _WHOLE).otherwise(_OPEN)
    back = found.select("shard", "dk", "start", "count", "n", kind.alias("kind")).unionByName(window.select("shard", F.col("window").alias("dk"), F.lit(0).alias("start"), F.lit(0).alias("count"), F.lit(0).cast("long").alias("n"), F.lit(_WINDOW).alias("kind")))
    out = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, spans string"
    return rows.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_remove(width), out)


def op1_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
