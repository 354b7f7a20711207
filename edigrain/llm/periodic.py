"""Periodic runs of words, by Main and Lorentz's divide and conquer.

A run is a stretch of words with smallest period q that is at least
`min_exponent` periods and `min_words` words long and that no neighbouring word
extends. Words are interned to numbers. A stretch is halved again and again; at
each midpoint two Z-functions tell, for every period, how far the repetition
with a whole period on one side reaches to the left and to the right. That is
the extended run already; one that ends at the edge of its part, but not of the
whole, crosses a midpoint further up and is found there. Intervals found with
several periods keep the smallest.

What is halved are only the stretches that may hold a run: each word of a run,
but for its last period, comes again within a period, so for periods up to
2, 4, 8, ... a run lies in an unbroken stretch of words that come again that
soon. This leaves out no run; common prose leaves little to halve.

Documents are independent: there is no shuffle, and a task holds one slice of
texts (one text, if that is longer).

Odd input: null, empty and blank texts have no words and no run; repeated rows
and null ids are rows like others; of runs of one length the first is the
longest, then that of the smallest period; an empty table gives an empty result;
other columns are not read. A text is handled whole, in memory that grows with
its words and time that grows with words times their logarithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, table

Run = tuple[int, int, int]  # first word, word after the last, period


def z_function(s: list[int], upto: int) -> list[int]:
    """Lengths of the longest prefixes of s that start at its first upto places."""
    n = len(s)
    z = [0] * min(upto, n)
    left = right = 0
    for i in range(1, len(z)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        j = i + k
        while j < n and s[j] == s[k]:
            k += 1
            j += 1
        z[i] = k
        if j > right:
            left, right = i, j
    return z


def crossing(left: list[int], right: list[int], exponent: int) -> Iterator[Run]:
    """(words left, words right of the middle, period) of the repetitions across
    the middle that hold a whole period right of it."""
    most = min(len(right), (len(left) + len(right)) // exponent)
    ahead = z_function(right, most + 1)
    ahead += [0] * (most + 1 - len(ahead))
    p = left[::-1]
    behind = z_function([*p, -1, *right[:most][::-1], *p], len(p) + 1 + most)
    end = len(p) + 1 + most
    for q in range(1, most + 1):
        reach = behind[end - q] + ahead[q]
        if reach >= (exponent - 1) * q:
            yield behind[end - q], q + ahead[q], q


def candidates(ids: np.ndarray, min_words: int, exponent: int) -> list[tuple[int, int]]:
    """Disjoint stretches of words; each run lies in one of them."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, n, dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found, limit = [], 1
    while limit // 2 + 1 <= n // exponent:
        step = np.diff(np.concatenate([[0], (gap <= limit).view(np.int8), [0]]))
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = last - first >= max((exponent - 1) * (limit // 2 + 1), min_words - limit)
        found += zip(first[long].tolist(), np.minimum(last[long] + limit, n).tolist())
        limit *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def find_runs(ids: np.ndarray, min_words: int = 6, exponent: int = 4) -> list[Run]:
    """All runs, by first word and period. ids are not negative; exponent is 2 at
    least."""
    if len(ids) < min_words:
        return []
    best: dict[tuple[int, int], int] = {}
    for first, last in candidates(ids, min_words, exponent):
        s = ids[first:last].tolist()
        stack = [(0, len(s))]
        while stack:
            a, b = stack.pop()
            if b - a < max(min_words, exponent):
                continue
            mid = (a + b) // 2
            left, right = s[a:mid], s[mid:b]
            both = [(mid - x, mid + y, q) for x, y, q in crossing(left, right, exponent)]
            both += [(mid - y, mid + x, q) for x, y, q in crossing(right[::-1], left[::-1], exponent)]
            for start, end, q in both:
                if end - start >= min_words and (start > a or a == 0) and (end < b or b == len(s)):
                    key = (first + start, first + end)
                    best[key] = min(q, best.get(key, q))
            stack += [(a, mid), (mid, b)]
    return sorted(((a, b, q) for (a, b), q in best.items()), key=lambda x: (x[0], x[2]))


def _scan(min_words: int, exponent: int):
    schema = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, runs, kept = [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or b"").split()
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
                own = find_runs(ids, min_words, exponent)
                if own:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, [a + q for a, _, q in own], 1)
                    np.add.at(edge, [b for _, b, _ in own], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                counts.append(len(ids))
                runs.append([{"start": a, "length": b - a, "period": q} for a, b, q in own])
                kept.append(b" ".join(words))
            yield pa.record_batch([batch.column("id"), pa.array(counts, pa.int64()), pa.array(runs, schema), pa.array(kept, pa.binary())], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, min_exponent: int = 4) -> DataFrame:
    """id, n_words, runs (start, length, period) by start and then period, and
    collapsed: the words that no run repeats, joined by spaces."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return rows.mapInArrow(_scan(min_words, min_exponent), out).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text of the query: where crc32 of the id's decimal text ends in 0, the
    words from a on repeat with period p; other texts stay as they are. a and p
    follow from the hash and from the number of words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        unit = F.slice(words, a + 1, p)
        whole = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(whole, 1, n - a)), " ")

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # a lambda names the list of words, so that it is made once
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise("")), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
