"""Dedup operators against brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from edigrain.llm import ngram_join, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, line = text(60), text(40)
    out = [(i, text(rng.randint(1, 120))) for i in range(40)]
    out += [(100 + i, f"{text(rng.randint(0, 50))} {shared} {text(rng.randint(0, 50))}") for i in range(12)]
    out += [(200 + i, f"{line}\n{text(20)}") for i in range(10)]
    out += [(300, text(40) + " " + line[:150] + " \n " + line[:150]), (301, (line + " ") * 5), (302, "a " * 400)]
    out += [(400, None), (401, ""), (402, " \t "), (403, "é ß 日本 " * 30), (None, shared), (100, out[40][1]), (100, out[40][1]), (500, line + "\0\0" + line)]
    return out


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("dk", "shard", "count", "start", "sid", "row"):  # names the operators use inside
        df = df.selectExpr("*", f"1 AS `{c}`")
    return df


@pytest.mark.parametrize("shard_rows", [1000, 7])
def test_substring_dedup(spark, rows, shard_rows):
    width = 12
    got = Counter(tuple(r)[:4] for r in substring_dedup.remove_repeats(_frame(spark, rows), width=width, gram=4, shard_rows=shard_rows).collect())
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    want = Counter()
    for (i, _), w in zip(rows, words):
        gone = set()
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] > 1:
                gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1500])
def test_suffix_dedup(spark, rows, shard_bytes):
    width = 20
    got = Counter(tuple(r)[:5] for r in suffix_dedup.remove_earlier_strings(_frame(spark, rows), width=width, gram=6, shard_bytes=shard_bytes).collect())
    data = [(i if i is not None else 1 << 62, i, (t or "").encode()) for i, t in rows]
    low = {}
    for k, _, b in sorted(data, key=lambda x: x[0]):
        for j in range(len(b) - width + 1):
            low.setdefault(b[j : j + width], k)
    want = Counter()
    for k, i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - width + 1):
            if low[b[j : j + width]] < k:
                gone[j : j + width] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n, letters in ((1, 2), (50, 1), (300, 2), (400, 200)):
        text = rng.integers(0, letters, size=n).astype(np.uint8)
        b = text.tobytes()
        order, rank, _ = suffix_dedup.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        assert rank[order].tolist() == list(range(n))
        common = suffix_dedup.kasai(text, order, 16, most=7)
        for x, y, c in zip(order, order[1:], common[1:]):
            k = 0
            while k < 16 and max(x, y) + k < n and b[x + k] == b[y + k]:
                k += 1
            assert c == k


def _sets(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [1500, 4])
@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_components(spark, block, k, percent):
    rng = random.Random(5)
    vocab = [f"W{i}" for i in range(300)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 9, 20, 40, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(None, "a b"), (900, None), (901, ""), (902, " \n"), (5, rows[5][1]), (5, "other text of the same id"), (903, rows[7][1].lower())]
    sets = [_sets(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    want = Counter((i, len(sets[a]), low.get(find(a))) for a, (i, _) in enumerate(rows))
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(_frame(spark, rows), k=k, percent=percent, block=block).collect())
    assert got == want


def test_keep_one_each(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y z"), (3, "x y z"), (4, None), (None, "q r s")]
    out = ngram_join.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(out.collect(), key=str) == sorted([(1, "a b c d e f g h"), (3, "x y z"), (4, None), (None, "q r s")], key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_earlier_strings(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
