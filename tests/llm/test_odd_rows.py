"""Every operator and pipeline stage over null, empty, very long and repeated
texts, empty tables, and extra columns whose names the operators use inside."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edigrain.llm import decontaminate, langid, mixing, ngram_join, secrets, substring_dedup, suffix_dedup, tokens, topk, toxicity

CLASHES = ("id", "key", "row", "i", "k", "dk", "shard", "doc", "part", "salt", "n", "start", "sid", "hit", "spans", "score", "toxic", "words", "windows", "text_key", "predicted", "size", "value", "query_id")
RNG = random.Random(9)
VOCAB = [f"w{i}" for i in range(500)]
ITEM = " ".join(RNG.choice(VOCAB) for _ in range(40))
LONG = " ".join(RNG.choice(VOCAB) for _ in range(60_000)) + " " + ITEM
KEY = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(44))
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, ITEM), (5, ITEM), (6, ITEM + " more"), (7, "short"), (None, None), (None, ITEM), (8, "é日本 \U0001f600"), (9, f"secret: {KEY}"), (4, "another text of four")]


def _frame(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def _items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")


def _toxic_model():
    return toxicity.Model({"w1$": 2.0}, (-2.0, 1.0, 0.5, 0.1, 0.1, 0.1, 0.1, 0.0))


def _lang_model(spark):
    return langid.fit(spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(20)] + [(50 + i, "der Hund und die Katze", "de") for i in range(20)], "doc_id long, text string, lang string"), F.lit(True))


OPERATORS = {
    "substring": lambda s, d: substring_dedup.remove_repeats(d),
    "language": lambda s, d: langid.label_languages(d, _lang_model(s)),
    "jaccard": lambda s, d: ngram_join.jaccard_components(d),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "suffix": lambda s, d: suffix_dedup.remove_earlier_strings(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, _toxic_model()),
    "tokens": lambda s, d: tokens.count_tokens(d, tokens.load_pieces()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, name):
    run = OPERATORS[name]
    got = sorted(map(str, run(spark, _frame(spark)).collect()))
    assert len(got) == len(ROWS)
    assert got == sorted(map(str, run(spark, _frame(spark, clash=False)).collect()))  # other columns change nothing
    assert run(spark, _frame(spark, [])).count() == 0


def test_long_texts_are_whole(spark):
    found = {r.doc_id for r in decontaminate.contaminated(_frame(spark), _items(spark)).collect()}
    assert found == {4, 5, 6, None}  # the item ends the long text
    assert decontaminate.contaminated(_frame(spark, []), _items(spark)).count() == 0
    gone = {(r.id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_earlier_strings(_frame(spark)).collect()}
    assert gone[4, len(LONG)] == 0 and gone[5, len(ITEM)] == len(ITEM)  # 4 is less
    words = {(r.id, r.n_words): r.n_removed for r in substring_dedup.remove_repeats(_frame(spark)).collect()}
    assert words[4, 60_040] == 40 and words[6, 41] == 40


def test_topk_over_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    odd = [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan"), 0.0, 0.0, 0.0]), (350, [float("inf"), 0.0, 0.0, 0.0]), (450, [1e300, 0.0, 0.0, 0.0]), (400, good[50][1])]
    rows = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASHES if c != "query_id"})
    got = topk.exact_topk(rows, F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50, 100, 400} and {r.vec_id for r in got if r.query_id == 400 and r["rank"] == 1} <= {50} | set(range(120))
    assert topk.exact_topk(rows.limit(0), F.col("vec_id") % 50 == 0).count() == 0


STAGES = {
    "toxicity": lambda s, d: toxicity.keep_clean(d, _toxic_model()),
    "ngram_join": lambda s, d: ngram_join.keep_one_each(d),
    "decontamination": lambda s, d: decontaminate.keep_uncontaminated(d, _items(s)),
    "secrets": lambda s, d: secrets.redact_secrets(d),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage(spark, name):
    run = STAGES[name]
    rows = _frame(spark)
    out = run(spark, rows)
    assert sorted(out.columns) == sorted(rows.columns)
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    whole = sorted(ROWS, key=str)
    assert run(spark, _frame(spark, [])).count() == 0
    if name == "secrets":
        assert len(kept) == len(whole) and not any(KEY in (t or "") for _, t in kept) and (4, LONG) in kept
    elif name == "decontamination":
        assert kept == [x for x in whole if ITEM not in (x[1] or "")]
    elif name == "ngram_join":  # 5 and 6 link; the row without an id stays
        assert kept == sorted([x for x in set(ROWS) if x[0] != 6], key=str)
    else:
        assert set(kept) <= set(ROWS) and {(1, None), (2, ""), (7, "short")} <= set(kept)


def test_mixing_over_odd_rows(spark):
    assert mixing.mix(_frame(spark), mixing.WEIGHTS).where("doc_id = 4").count() > 0
    assert mixing.mix(_frame(spark, []), mixing.WEIGHTS).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "secrets", "mixing"]
