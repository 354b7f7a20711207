"""Periodic runs against a search that tries every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edigrain.llm import periodic
from edigrain.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(words, min_words=6, exponent=4):
    """A run of q is a maximal stretch in which words q apart agree."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        same, i = [words[k] == words[k + q] for k in range(n - q)], 0
        while i < n - q:
            if not same[i]:
                i += 1
                continue
            j = i
            while j < n - q and same[j]:
                j += 1
            if j - i + q >= max(min_words, exponent * q):
                best.setdefault((i, j + q), q)  # the smallest comes first
            i = j
    return sorted(((a, b, q) for (a, b), q in best.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 1), (3, 10)])
def test_every_run_is_found(exponent, least):
    rng = random.Random(exponent)
    for _ in range(400):
        words = []
        while len(words) < rng.randint(0, 90):
            unit = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(1, 8))]
            words += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
        assert periodic.find_runs(np.array(words, dtype=np.int64), least, exponent) == brute(words, least, exponent)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha(b"".join(b"%d,%d,%d\n" % (a, b - a, q) for a, b, q in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = {tuple(r) for r in periodic.op11_periodic_runs(spark, SF).collect()}
    short = {r for r in got if len((docs[r[0]] or "").split()) < 1500}
    assert len(got) == len(docs) and len(short) > 150 and sum(r[1] > 0 for r in short) > 5
    assert short == {expected(k, docs[k]) for k in {r[0] for r in short}}


def test_odd_rows(spark):
    long = "x y z " * 40_000 + "tail"
    rows = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (4, long), (5, "a b c d e"), (5, "a b c d e"), (None, "b " * 7), (None, None), (6, "日本 " * 6 + "é"), (7, "u" + " u" * 9), (8, "a a a a a a b b b b b b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "runs", "n_words", "start", "collapsed", "top")})
    got = {(r.id, r.n_words): r for r in periodic.periodic_runs(docs).collect()}
    runs = {k: [tuple(x) for x in r.runs] for k, r in got.items()}
    assert runs[4, 120_001] == [(0, 120_000, 3)] and got[4, 120_001].collapsed == "x y z tail"
    assert runs[None, 7] == [(0, 7, 1)] and runs[6, 7] == [(0, 6, 1)] and runs[7, 1] == [] and runs[8, 12] == [(0, 6, 1), (6, 6, 1)]
    assert all(runs[k] == [] for k in ((1, 0), (2, 0), (3, 0), (5, 5), (None, 0))) and periodic.periodic_runs(docs).count() == len(rows)
    assert got[8, 12].collapsed == "a b" and got[1, 0].collapsed == ""
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    ids = spark.createDataFrame([(i, t) for i in [*range(40), None] for t in (None, "", "one", "a b c d e f g h")], "doc_id long, text string")
    made = {(r.doc_id, r.text): r.made for r in ids.withColumn("made", periodic.planted(F.col("doc_id"), F.col("text"))).collect()}
    assert all(made[i, None] is None and made[i, ""] == "" for i in range(40)) and made[None, "one"] == "one"
