"""Learned and statistical operators: held-out accuracy, brute force, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edigrain.llm import decontaminate, langid, mixing, secrets, tokens, topk, toxicity
from edigrain.llm.common import table, train_row

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    out = langid.op2_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_language_spans_and_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and then the dog ran", "en") for i in range(20)] + [(100 + i, "der Hund und die Katze sitzen auf der Matte", "de") for i in range(20)] + [(200 + i, "кот сидит на ковре и смотрит", "ru") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the cat and the dog sat on the mat der Hund und die Katze sitzen auf der Matte кот сидит на ковре"), (None, "кот")], "doc_id long, text string")
    got = {r.id: r for r in langid.label_languages(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "ru"
    assert [s.split(":")[2] for s in got[4].spans.split(",")] == ["en", "de", "ru"]
    assert langid.label_languages(odd, langid.fit(docs.limit(0), F.lit(True))).where("lang_pred != 'und'").count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    path = langid.viterbi(scores, np.array([0, 4]), np.array([4, 5]), 0.7)
    for a, b in ((0, 4), (4, 9)):
        best = max(np.ndindex(*[3] * (b - a)), key=lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:])))
        assert path[a:b].tolist() == list(best)


def test_toxicity_held_out(spark):
    out = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.97
    assert set(out.predicted) <= {0, 1} and out.score.between(0, 1).all()


def test_toxicity_grammar():
    lexicon, machine = toxicity.Lexicon({"fool$": 2.0, "rott": 1.0}), toxicity.grammar()
    score = lambda t: sum(s for _, s in toxicity.document_features(t, lexicon, machine)[1])
    assert score("what a fool") == 2.0 and score("rotten") == 1.0 and score("foolish") == 0
    assert score("you fool") == 3.0
    assert score("he is not a fool") < score("he is a fool")
    assert score("they said fool") < score("they are fool")
    assert score("i kill time") == 0 and score("i will hurt you. you i hurt") == 2.0
    assert score("") == 0


def test_toxicity_learns_settings(spark):
    """Words that void an insult, close before it or ahead in its clause, and the
    same scores without the grammar."""
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in ("ta", "mo", "ri", "se", "lu") for b in ("ran", "pel", "dis", "kov", "mun")]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    make = {
        0: lambda: (f"{words(30)}. {words(4)} gribble {words(3)}. {words(8)}", 1), 1: lambda: (f"{words(30)}. {words(4)} zorp gribble {words(3)}. {words(8)}", 0),
        2: lambda: (f"{words(30)}. quoth {words(4)} gribble {words(3)}. {words(8)}", 0), 3: lambda: (f"{words(40)}. zorp. quoth", 0), 4: lambda: (f"{words(30)}. zorp {words(6)} gribble. quoth", 1),
    }
    rows = [(i, *make[(0, 0, 4, 1, 2, *[3] * 11)[i % 16]]()) for i in range(1600)]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    right = {}
    for settings in (True, False):
        model = toxicity.fit(docs, labels, F.col("id") < 1200, settings=settings)
        got = {r.id: r.score >= 0.5 for r in toxicity.score_toxicity(docs, model).collect()}
        right[settings] = np.mean([got[i] == bool(y) for i, t, y in rows if i >= 1200 and "gribble" in t])
        if settings:
            assert model.context["zorp"] == toxicity.NEGATION and model.context["quoth"] == toxicity.REPORT
            assert model.factors[toxicity.NEGATION] < 0.3 and model.factors[toxicity.REPORT] < 0.3
    assert right[True] > 0.95 > right[False] + 0.2


INNOCENT = ["The world of work and words: the transport of trade goods is discussed.", "Das Wort der Arbeit ist klar.", "They destroy old records and the virus will kill them, he said.", "El perdón y la clase de trabajo. La distancia y el patrón."]


def test_toxicity_on_given_documents(spark):
    """Held out: no worse with settings than without; whole words; no innocent
    beginnings; the query equals its parts applied one text at a time."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels, train_row("id"))
    alone = toxicity.fit(docs, labels, train_row("id"), settings=False)
    assert model.entries and all(len(w.rstrip("$")) >= 4 for w in model.entries)
    assert model.factors == toxicity.NEUTRAL or not set(model.context) & {"the", "of", "and", "de", "is"}
    score, _ = toxicity.Scorer(model)(INNOCENT)
    assert (score < 0.3).all()
    label = {r.doc_id: r.toxic for r in labels.collect()}
    wrong = []
    for m in (model, alone):
        got = toxicity.score_toxicity(docs, m).where("pmod(crc32(cast(cast(id as string) as binary)), 4) = 2").collect()
        wrong.append(sum(r.predicted != label[r.id] for r in got if r.id in label))
    assert wrong[0] <= wrong[1]
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    out = toxicity.op7_toxicity(spark, SF).collect()
    small = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), train_row("id"))
    lexicon, machine = toxicity.Lexicon(small.entries, small.context), toxicity.grammar(factors=small.factors)
    assert len(out) == len(texts)
    for r in out:
        x, _ = toxicity.document_features(texts[r.doc_id] or "", lexicon, machine)
        want = 1 / (1 + np.exp(-(small.weights[0] + np.dot(small.weights[1:], x)))) if small.weights else 0.0
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_lexicon_prefers_words():
    grams = [("clown$", 50, 0, 3.0), ("clown", 50, 0, 3.0), ("clow", 50, 0, 3.0), ("clo", 60, 200, 2.0), ("idiot$", 20, 0, 3.0), ("idiots$", 20, 0, 3.0), ("idiot", 80, 1, 3.0), ("idio", 80, 1, 3.0)]
    assert toxicity.choose_lexicon(grams, 100, 10_000, 10) == {"clown$": 3.0, "idiot": 3.0}
    assert list(toxicity.choose_lexicon(grams, 100, 10_000, 1)) == ["idiot"]
    assert toxicity.choose_lexicon([], 1, 1, 5) == {}


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, None), (9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, train_row("id"))
    assert [r.score for r in toxicity.score_toxicity(docs, model).collect()] == [0.0] * 4


def test_secrets_base_and_random(spark):
    rng = random.Random(1)
    key = "".join(rng.choice(secrets.ALPHABETS["base64"]) for _ in range(48))
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(7)) for _ in range(60))
    rows = [(i, prose) for i in range(200)]
    rows += [(900, f"x Password: 'abc.def-123456' y"), (901, "AKIAABCDEFGHIJKLMN and AKIA123"), (902, "é 0123456789abcdef0123"), (903, f"{prose} key {key} end"), (904, None), (905, ""), (906, "ſecret=abcdefghijklmnop token=short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x"))
    got = {r.id: r for r in secrets.scan_secrets(docs).where("id >= 900").collect()}
    assert got[900].spans == "assign:2:27" and got[901].spans == "access:0:18" and got[902].spans == "hex:2:22"
    assert got[903].spans.startswith("random:") and got[904].spans == got[905].spans == got[906].spans == ""
    masked = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert masked[901].text == "[secret] and AKIA123" and masked[904].text is None and masked[0].text == prose and masked[0].spans == "x"
    assert len(masked) == len(rows)


@pytest.mark.parametrize("words", [12, 80, 1500])
@pytest.mark.parametrize("encoding,length", [("alnum62", 32), ("base64", 44), ("lower36", 30), ("base32", 32), ("base64url", 43), ("HEX", 40)])
def test_secrets_at_random_places(spark, words, encoding, length):
    rng = random.Random(f"{words}{encoding}")
    texts = [r.text for r in table(spark, SF, "documents").where("text is not null and lang in ('en', 'de')").orderBy("doc_id").limit(300).collect()]
    vocab = sorted({w for t in texts for w in t.split() if w.isalpha() and 2 <= len(w) <= 14})
    word = lambda: rng.choice(vocab)
    harmless = [
        lambda: word() + word().capitalize() + word().capitalize() + word().capitalize() + str(rng.randrange(10**8)) + "A", lambda: "/".join([word(), word(), word(), f"v{rng.randrange(9)}", word()]),
        lambda: "-".join([word(), word(), word(), word(), str(rng.randrange(3000))]), lambda: word() + word() + word() + word(),
    ]
    rows, keys, decoys = [], {}, 0
    for i in range(200):
        own = [word() for _ in range(words)]
        for make in rng.sample(harmless, 3):
            own.insert(rng.randrange(len(own) + 1), make())
            decoys += len(own[-1]) >= 20
        key = "".join(rng.choice(secrets.ALPHABETS[encoding]) for _ in range(length))
        at = rng.randrange(len(own) + 1)
        text = " ".join([*own[:at], key, *own[at:]])
        start = len(" ".join([*own[:at], ""]))
        keys[i] = f"random:{start}:{start + length}"
        rows.append((i, text))
    got = {r.id: set(r.spans.split(",")) - {""} for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(keys[i] in got[i] for i in keys)
    wrong = sum(len(got[i] - {keys[i]}) for i in keys)
    assert hits >= 0.93 * 200 and wrong <= max(2, 0.02 * hits), (hits, wrong)


def test_secrets_base_is_the_contract(spark):
    import re

    texts = [r.text or "" for r in table(spark, SF, "documents").select("text").collect()]
    for t in texts:
        base = secrets.base_spans(t)
        got = sorted(base + secrets.candidates(t, base)[0])
        want = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert got == sorted(want)


def test_token_counts_equal_a_unigram_tokenizer(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    pieces = tokens.load_pieces()
    tk = Tokenizer(Unigram([("<unk>", -1.0)] + pieces, 0))
    rows = [(1, "hello world 日本 a日b\nhello"), (2, None), (3, ""), (4, "x" * 300 + " \U0001f600\U0001f600"), (5, "hello world")]
    got = {r.id: (r.n_words, r.n_tokens) for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), pieces).collect()}
    for i, t in rows:
        words = (t or "").split()
        assert got[i] == (len(words), sum(len(tk.encode(tokens.MARK + w).tokens) for w in words))


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 100), ("a", "x", "s2", 10), ("a", "y", "s3", 1000), ("b", "x", "s4", 5)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.alloc for r in mixing.budgets(leaves, {"domain": {"a": 1, "b": 3}, "lang": {"x": 3, "y": 1}}, F.lit(400), 2).collect()}
    # b can give 10 of its 300; a gets 390: x 220 at most of 292, s2 20 of its half
    assert got == {"s4": 10, "s1": 200, "s2": 20, "s3": 170}


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "d e", None, "s"), (4, "f g h i", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, mixing.WEIGHTS, share=2.0, epochs=2).collect()
    assert Counter((r.doc_id, r.epoch) for r in out) == Counter({(1, 0): 2, (1, 1): 2, (None, 0): 1, (None, 1): 1, (4, 0): 1, (4, 1): 1})
    assert mixing.mix(docs.limit(0), mixing.WEIGHTS).count() == 0


def _leaks(docs, items, k=5):
    import re

    norm = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    out = {}
    for i, t in docs:
        w = norm(t)
        for j, u in items:
            v = norm(u)
            if not v or len(w) < min(k, len(v)):
                continue
            for a in range(max(1, len(w) - len(v) + 1)):
                x, y = grams(w[a : a + len(v)]), grams(v)
                both = sum((x & y).values())
                s = both / (sum(x.values()) + sum(y.values()) - both)
                if s >= 0.8:
                    out[i, j] = max(out.get((i, j), 0), s)
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(j, " ".join(text(n))) for j, n in enumerate([1, 3, 5, 8, 20, 40, 40, 90])] + [(50, None), (51, "!!"), (52, "x y x y x y x y")]
    docs = [(i, " ".join(text(60))) for i in range(10)]
    for i in range(40):
        v = items[rng.randrange(8)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            v[rng.randrange(len(v))] = rng.choice(vocab)
        docs.append((100 + i, " ".join(text(rng.randint(0, 30)) + v + text(rng.randint(0, 30))).upper()))
    docs += [(200, None), (201, ""), (202, items[5][1]), (202, items[5][1]), (203, "x y x y x y x y x")]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: round(v, 9) for k, v in _leaks(docs, items).items()}


def test_decontamination_without_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.keep_uncontaminated(docs, items).count() == 1


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (7, rows[7][1]), (None, rows[1][1]), (205, [1.0, 2.0]), (206, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    for shard in (4096, 16):
        got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(df, F.col("vec_id") % 10 == 0, k=3, shard_rows=shard).collect())
        vecs = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
        want = Counter()
        for i, q in vecs:
            if i % 10 == 0:
                best = sorted(((-int(v @ q), j) for j, v in vecs if j != i and len(v) == len(q)))[:3]
                want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
        assert got == want


@pytest.mark.parametrize("name", ["op3_ngram_join", "op4_mixing", "op9_topk"])
def test_against_sql(spark, name):
    import duckdb

    from edigrain.llm import entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    kept, total = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    kept = kept.cache()
    assert 0.6 * total < kept.count() < total
    assert decontaminate.contaminated(kept, table(spark, SF, "benchmark")).count() == 0
    assert secrets.scan_secrets(kept).where("n_assign + n_access + n_hex > 0").count() == 0
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and set(out.columns) == {"doc_id", "epoch", "domain", "lang", "source", "n_tokens"}


def test_decoys_come_from_whole_texts():
    from edigrain.llm import secrets

    filler = ["plain ordinary words which stand along without meaning or order whatever happens later"] * 40
    early, late = " ".join(filler), " ".join(filler[:20] + ["quite other sentences follow between these places nobody looked before"] + filler[20:])
    assert secrets.decoys([early], [[]]) != secrets.decoys([late], [[]])
    words = [w for own in secrets.stretches(late, []) for w in own]
    assert words == secrets.WORD.findall(late)[: len(words)] and len(late.split()) - len(words) < 60
    assert sum(1 for _ in secrets.stretches(" ".join(filler * 10), [])) > 9 * sum(1 for _ in secrets.stretches(early, []))
