"""What the n-gram join writes to disk: texts, not hashes, and not for longer than it needs."""

import os
import random

import numpy as np

from edigrain.llm import ngram_join


def test_pack_and_unpack():
    texts = [b"One two three four five six seven", b"a " * 4000, b"x", "é ß 日本 ".encode() * 30, b"w1 w2 w3 w4 w5 w6 " * 900]
    sets = ngram_join.shingle_sets(texts, 5)
    packed = ngram_join.pack([(t, len(s)) for t, s in zip(texts, sets)], 5)
    assert all(len(p) <= min(len(t), 8 * len(s)) + 1 for p, t, s in zip(packed, texts, sets))
    for most in (1, 40, 1 << 20):
        assert all(np.array_equal(a, b) for a, b in zip(ngram_join.unpack(packed, 5, most), sets, strict=True))


def test_blocks_hold_texts_and_go(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"{i:03d}" for i in range(1000)]
    rows = []
    for i in range(0, 120, 2):  # pairs that differ in a word
        words = rng.choices(vocab, k=400)
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:-1] + ["end"]))]
    again = rows[7]
    written, plain = [], ngram_join.materialize

    def watched(df):
        out = plain(df)
        if {"blk", "own"} <= set(out.columns):
            files = [f.removeprefix("file://") for f in out.inputFiles()]
            written.append((out.count(), sum(map(os.path.getsize, files)), files))
        return out

    monkeypatch.setattr(ngram_join, "materialize", watched)
    docs = spark.createDataFrame(rows + [again] * 30 + [(again[0], "another text of this id")], "doc_id long, text string")
    got = ngram_join.jaccard_components(docs, k=5, percent=80).collect()
    want = sorted([(i, i - i % 2) for i, _ in rows] + [(again[0], again[0] - 1)] * 30 + [(again[0], again[0])])
    assert sorted((r["id"], r["component_id"]) for r in got) == want
    [(n, size, files)] = written
    assert n == len(rows)
    assert size < sum(len(t) for _, t in rows)  # eight bytes a shingle are twice as much
    assert not any(map(os.path.exists, files))
