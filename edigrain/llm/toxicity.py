"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (a learned lexicon of whole words and word
beginnings, each with a weight), threat, target, negation, reported speech and
plain; punctuation ends a clause. Four small transducers - negation, reported
speech, target and threat - are composed into one, which reads each clause
that holds an insult or a threat and multiplies the weight of what it matches
by a factor for its setting. A document's features are sums over its matched
clauses; a logistic fit on labelled rows turns them into a score.

All of it is learned from labelled rows. A word or a beginning of words is an
insult if it tells toxic documents from others; a beginning must tell by more
documents than those of the words that it covers, and what only goes along with
insults is none.
Among documents that hold the same insult, a word shortly before it that makes
the label unlikelier is a negation, one further ahead in the clause reports
speech, and one that makes it likelier is a target; comparing within an insult
keeps a language from passing for a setting. A few such words of five languages
are known beforehand. The factor of a setting is how much of an insult's effect
on the log-odds of the label is left in it. Settings count only if, on labelled
rows that they were not learned from, they lower the loss of the fit by more than
chance: else every factor is neutral, insults weigh the same in all settings, and
threats, which are known beforehand and not learned, weigh nothing.

Learning uses a bounded sample of about `max_labelled` labelled rows, chosen by
a hash of doc_id; the lexicon has at most `max_lexicon` entries, and
`max_context` words of settings.

Null, empty and odd input: null and empty texts have no matches and get the
score of such a text. Very long texts are read whole. Labels that are null, and
labels of unknown documents, teach nothing; without labels every score is 0.
Repeated rows are scored one by one; a document with repeated labels teaches
once for each. Of equally telling words the first in order is taken. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, slices, table, train_row

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
PREFIXES = range(3, 9)

WORDS = {
    THREAT: "kill hurt destroy stab shoot punish töten verletzen tuer blesser matar herir",
    TARGET: "you your yours yourself u he she they them him her du dich dir ihr euch tu toi vous te tú usted ustedes",
    NEGATION: "not never no nobody isn don doesn nicht kein keine nie pas jamais nunca jamás",
    REPORT: "said says wrote quoted reported claimed called sagte schrieb dit écrit dijo escribió",
}
FIXED = {w: k for k, ws in WORDS.items() for w in ws.split()}


class Transducer:
    """arcs[(state, symbol)] = (next state, factor); a missing arc keeps the
    state with factor 1. State 0 starts each clause."""

    def __init__(self, arcs: dict[tuple, tuple], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: int) -> tuple:
        return self.arcs.get((state, symbol), (state, 1.0))


def compose(parts: list[Transducer]) -> Transducer:
    """One transducer whose states are tuples and whose factors are products."""
    start = tuple(p.start for p in parts)
    arcs, todo, done = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in range(END):
            moves = [p.step(s, symbol) for p, s in zip(parts, state)]
            to = tuple(m[0] for m in moves)
            arcs[state, symbol] = (to, math.prod(m[1] for m in moves))
            if to not in done:
                done.add(to)
                todo.append(to)
    return Transducer(arcs, start)


#: What is left of an insult in each setting, and the weight of a threat, until
#: labels tell; and where they tell nothing.
FACTORS = {NEGATION: 0.3, REPORT: 0.5, TARGET: 1.5, THREAT: 2.0}
NEUTRAL = {NEGATION: 1.0, REPORT: 1.0, TARGET: 1.0, THREAT: 0.0}
SCOPE = 3


@dataclass(frozen=True)
class Model:
    """entries: insults with weights; context: words of settings; factors of
    settings; weights of the logistic fit (none without labels)."""

    entries: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    context: dict[str, int] = field(default_factory=dict)
    factors: dict[int, float] = field(default_factory=lambda: dict(FACTORS))


def grammar(scope: int = SCOPE, factors: dict[int, float] = FACTORS) -> Transducer:
    """Negation changes what follows within `scope` words, reported speech what
    follows in its clause, and so does a target; a threat counts only with a
    target before it."""
    negation = {}
    for s in range(scope + 1):
        negation[s, NEGATION] = (scope, 1.0)
        for symbol in (PLAIN, TARGET, REPORT):
            negation[s, symbol] = (max(0, s - 1), 1.0)
        for symbol in (INSULT, THREAT):
            negation[s, symbol] = (0, factors[NEGATION] if s else 1.0)
    reported = {(0, REPORT): (1, 1.0), (1, INSULT): (1, factors[REPORT]), (1, THREAT): (1, factors[REPORT])}
    target = {(0, TARGET): (1, 1.0), (1, INSULT): (1, factors[TARGET])}
    threat = {(0, TARGET): (1, 1.0), (0, THREAT): (0, 0.0), (1, THREAT): (1, factors[THREAT])}
    return compose([Transducer(x) for x in (negation, reported, target, threat)])


class Lexicon(dict):
    """word -> (symbol, weight); the longest learned beginning of a word wins.
    Words met are kept, up to a bound."""

    def __init__(self, entries: dict[str, float], context: dict[str, int] | None = None):
        super().__init__()
        self.entries = entries
        self.known = FIXED | (context or {})

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 150_000:
            self.clear()
        if word in ".!?;\n":
            out = (END, 0.0)
        elif word + "$" in self.entries:
            out = (INSULT, self.entries[word + "$"])
        else:
            hit = next((word[:n] for n in reversed(PREFIXES) if word[:n] in self.entries and len(word) >= n), None)
            out = (INSULT, self.entries[hit]) if hit else (self.known.get(word, PLAIN), 1.0)
        self[word] = out
        return out


def document_features(text: str, lexicon: Lexicon, machine: Transducer) -> tuple[list[float], list[tuple[int, float]]]:
    """Features of a text, and its matched clauses (clause number, score)."""
    tokens = TOKEN.findall(text.lower())
    symbols = list(map(lexicon.__getitem__, tokens))
    clauses: list[tuple[int, float]] = []
    hits, raw, best, words = 0, 0.0, 0.0, 0
    clause: list[tuple[int, float]] = []
    number = 0
    for s in [*symbols, (END, 0.0)]:
        if s[0] != END:
            clause.append(s)
            continue
        words += len(clause)
        if any(x[0] in (INSULT, THREAT) for x in clause):
            state, total = machine.start, 0.0
            for symbol, weight in clause:
                state, factor = machine.arcs[state, symbol]
                if symbol in (INSULT, THREAT):
                    total += factor * weight
                    if symbol == INSULT:
                        hits, raw = hits + 1, raw + weight
            clauses.append((number, total))
            best = max(best, total)
        number += bool(clause)
        clause = []
    score = sum(x for _, x in clauses)
    dense = math.sqrt(max(words, 1))
    return [math.log1p(score), math.log1p(hits), best, score / dense, raw / max(hits, 1), float(hits > 1), math.log1p(words)], clauses


def _grams(entries: dict[str, float]):
    """Labelled documents that hold each whole word ("word$") and beginning, and
    none of the entries; the empty gram counts all of them."""

    def run(batches):
        known = frozenset(entries)
        for batch in slices(batches, "text", 1 << 19):
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen = set(TOKEN.findall((text or "").lower()))
                own = {w[:n] for w in seen for n in PREFIXES if len(w) >= n}
                own.update(w + "$" for w in seen)
                if known.isdisjoint(own):
                    (toxic if label else clean).update(own | {""})
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_pydict({"gram": pa.array(keys, pa.string()), "toxic": pa.array([toxic[g] for g in keys], pa.int64()), "clean": pa.array([clean[g] for g in keys], pa.int64())})

    return run


def learn_lexicon(rows: DataFrame, most: int) -> dict[str, float]:
    """Insults from (text, toxic), in rounds: the strongest first, and then what
    tells the documents that hold none of them, so that words which merely go
    along with insults are none."""
    out: dict[str, float] = {}
    while len(out) < most:
        got = materialize(rows.mapInArrow(_grams(out), "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")))
        size = got.where("gram = ''").first()
        if size is None or not size["t"] or not size["c"]:
            break
        nt, nc = size["t"], size["c"]
        p1, p0, p = F.col("t") / nt, F.col("c") / nc, (F.col("t") + F.col("c")) / (nt + nc)
        z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / nt + 1 / nc) + 1e-9)
        weight = F.log((F.col("t") + 0.5) / (nt + 1.0)) - F.log((F.col("c") + 0.5) / (nc + 1.0))
        telling = got.where((F.col("t") >= 3) & (F.col("gram") != "")).select("gram", "t", "c", z.alias("z"), weight.alias("w")).where((F.col("z") > LEAST_Z) & (F.col("w") > 1.5))
        top = telling.orderBy(F.desc("z"), "gram").limit(10 * most).collect()
        new = choose_lexicon([(r["gram"], r["t"], r["c"], r["w"]) for r in top if r["z"] >= ROUND_SHARE * top[0]["z"]], nt, nc, most - len(out))
        if not new:
            break
        out.update(new)
    return out


#: How many deviations an insult lies off chance, and a word of a setting.
LEAST_Z, LEAST_CONTEXT_Z = 6.0, 4.0
#: Insults of one round lie at least this share of the strongest one's deviations off.
ROUND_SHARE = 0.7


def _off(t: float, c: float, nt: int, nc: int) -> float:
    p = (t + c) / (nt + nc)
    return (t / nt - c / nc) / math.sqrt(p * (1 - p) * (1 / nt + 1 / nc) + 1e-9)


def choose_lexicon(grams: list[tuple[str, int, int, float]], nt: int, nc: int, most: int) -> dict[str, float]:
    """Words ("word$") and beginnings from (gram, toxic documents, clean ones,
    weight), nt and nc documents in all: the strongest first, of equal ones whole
    words and then the longest beginnings. What a taken beginning covers adds
    nothing. A beginning that covers taken ones must tell by the documents that
    these do not account for, or it covers innocent words."""
    order = sorted(grams, key=lambda g: (-round(_off(g[1], g[2], nt, nc), 9), not g[0].endswith("$"), -len(g[0]), g[0]))
    taken: dict[str, tuple[int, int]] = {}
    out: dict[str, float] = {}
    for gram, t, c, weight in order:
        word = gram.rstrip("$")
        if len(out) >= most or any(word[:n] in out for n in PREFIXES if n <= len(word)):
            continue
        if gram == word:
            covered = [x for w, x in taken.items() if w.startswith(gram)]
            t, c = t - sum(x[0] for x in covered), c - sum(x[1] for x in covered)
            if t < 3 or _off(t, max(c, 0), nt, nc) <= LEAST_Z:
                continue
        out[gram] = weight
        taken[word] = (t, c)
    return out


def insult_settings(text: str, lexicon: Lexicon) -> tuple[int, dict[str, tuple[set[str], set[str]]], set[int]]:
    """(insults in a text; for each, the words up to SCOPE before it and those
    further ahead in its clause; settings that all of them are in). Insults are no
    words of a setting."""
    around: dict[str, tuple[set[str], set[str]]] = {}
    everywhere, n = None, 0
    clause: list[str] = []
    for token in [*TOKEN.findall(text.lower()), "."]:
        kind = lexicon[token][0]
        if kind == END:
            clause = []
            continue
        if kind == INSULT:
            n += 1
            near, far = around.setdefault(token, (set(), set()))
            near.update(w for w in clause[-SCOPE:] if lexicon[w][0] != INSULT)
            far.update(w for w in clause[:-SCOPE] if lexicon[w][0] != INSULT)
            kinds = {lexicon[w][0] for w in clause}
            here = {k for k in (REPORT, TARGET) if k in kinds} | ({NEGATION} if any(lexicon[w][0] == NEGATION for w in clause[-SCOPE:]) else set())
            everywhere = here if everywhere is None else everywhere & here
        clause.append(token)
    return n, {k: (near, far - near) for k, (near, far) in around.items()}, everywhere or set()


def _contexts(entries: dict[str, float]):
    """Labelled documents with insults by insult and the words before it: (insult,
    word, far or not, toxic, clean); the empty word counts all of an insult."""

    def run(batches):
        lexicon = Lexicon(entries)
        for batch in slices(batches, "text", 1 << 19):
            counts = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for insult, (near, far) in insult_settings(text or "", lexicon)[1].items():
                    counts[int(label)].update([(insult, "", 0), *((insult, w, 0) for w in near), *((insult, w, 1) for w in far)])
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({
                **{c: pa.array([k[i] for k in keys], t) for i, (c, t) in enumerate((("insult", pa.string()), ("word", pa.string()), ("far", pa.int32())))},
                "toxic": pa.array([counts[1][k] for k in keys], pa.int64()), "clean": pa.array([counts[0][k] for k in keys], pa.int64()),
            })

    return run


def _settings(entries: dict[str, float], context: dict[str, int]):
    """(setting, toxic, clean): labelled documents all of whose insults are in a
    setting, in none (-1), or that have none (-2)."""

    def run(batches):
        lexicon = Lexicon(entries, context)
        for batch in slices(batches, "text"):
            counts = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n, _, settings = insult_settings(text or "", lexicon)
                counts[int(label)].update(settings or {-1} if n else {-2})
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({"setting": pa.array(keys, pa.int32()), "toxic": pa.array([counts[1][k] for k in keys], pa.int64()), "clean": pa.array([counts[0][k] for k in keys], pa.int64())})

    return run


def learn_context(rows: DataFrame, entries: dict[str, float], max_context: int, least: int = 20) -> dict[str, int]:
    """Words of settings, from (text, toxic): those that at least `least` documents
    have before an insult, and whose toxic ones, among documents with the same insult,
    are LEAST_CONTEXT_Z deviations off."""
    if not entries:
        return {}
    got = rows.mapInArrow(_contexts(entries), "insult string, word string, far int, toxic long, clean long").groupBy("insult", "word", "far").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    got = materialize(got)
    share = got.where("word = ''").select("insult", (F.col("t") / (F.col("t") + F.col("c"))).alias("p")).where("p > 0 and p < 1")
    n = F.col("t") + F.col("c")
    met = got.where("word != ''").join(share, "insult").groupBy("word", "far").agg(F.sum(n).alias("n"), F.sum(F.col("t") - n * F.col("p")).alias("off"), F.sum(n * F.col("p") * (1 - F.col("p"))).alias("var"))
    z = F.col("off") / F.sqrt("var")
    off = met.where(F.col("n") >= least).withColumn("z", z).where(F.abs("z") > LEAST_CONTEXT_Z).orderBy(F.desc(F.abs("z")), "word", "far").limit(2 * max_context).collect()  # a bounded lexicon
    out: dict[str, int] = {}
    for r in off:
        if len(out) < max_context and r["word"] not in out:
            out[r["word"]] = TARGET if r["z"] > 0 else REPORT if r["far"] else NEGATION
    return out


def learn_factors(rows: DataFrame, entries: dict[str, float], context: dict[str, int], least: int = 20) -> dict[int, float]:
    """What is left, in each setting, of the effect that insults have in none on the
    log-odds of the label, from 0 to 3; settings of few documents keep their own."""
    got = rows.mapInArrow(_settings(entries, context), "setting int, toxic long, clean long").groupBy("setting").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()  # six rows at most
    n = {r["setting"]: (r["t"], r["c"]) for r in got}
    odds = lambda k: math.log((n[k][0] + 0.5) / (n[k][1] + 0.5))
    out = dict(FACTORS)
    if -1 in n and -2 in n and odds(-1) - odds(-2) > 0.5:
        for k in (NEGATION, REPORT, TARGET):
            if sum(n.get(k, (0, 0))) >= least:
                out[k] = min(3.0, max(0.0, (odds(k) - odds(-2)) / (odds(-1) - odds(-2))))
    return out


def _learn_features(model: Model):
    def run(batches):
        lexicon, machine = Lexicon(model.entries, model.context), grammar(factors=model.factors)
        for batch in slices(batches, "text"):
            x = [document_features(t or "", lexicon, machine)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    return run


def _features(model: Model, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.mapInArrow(_learn_features(model), "x array<double>, toxic int").toPandas()  # the bounded sample
    return np.array(got["x"].tolist()).reshape(len(got), -1), got["toxic"].to_numpy(dtype=float)


def lowers_loss(plain: Model, grammatical: Model, tried: DataFrame, others: DataFrame) -> bool:
    """True if the fit with settings has, on the other rows, a mean log loss that is
    lower by more than two standard errors."""
    losses = []
    for model in (plain, grammatical):
        x, y = _features(model, tried)
        if len(set(y.tolist())) < 2:
            return False
        w = logistic(x, y)
        x, y = _features(model, others)
        if not len(y):
            return False
        at = w[0] + x @ w[1:]
        losses.append(np.logaddexp(0, at) - y * at)
    gain = losses[0] - losses[1]
    return bool(gain.mean() > 2 * gain.std() / math.sqrt(len(gain))) and bool(gain.mean() > 0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_lexicon: int = 400, max_context: int = 100, settings: bool = True) -> Model:
    """A model from about max_labelled labelled rows; without settings, words count
    alone, whatever is around them."""
    own = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("id").isNotNull())
    own = own.where(F.coalesce(usable, F.lit(False))) if usable is not None else own
    total = own.count()
    share = min(1.0, max_labelled / max(total, 1))
    own = own.where(F.expr(f"pmod(xxhash64(id, 'sample'), 1048576) < {math.ceil(share * 1048576)}"))
    # the sample has about max_labelled rows of two numbers, whatever the corpus
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own), "id")
    rows = materialize(rows.select("text", "toxic", F.expr("pmod(xxhash64(id, 'gate'), 3) = 0").alias("gate")))
    lexicon = learn_lexicon(rows, max_lexicon)
    if not lexicon and rows.select("toxic").distinct().count() < 2:
        return Model()
    plain = Model(lexicon, (), {w: PLAIN for w in FIXED}, dict(NEUTRAL))
    if settings:
        tried, others = rows.where("not gate"), rows.where("gate")
        context = learn_context(tried, lexicon, max_context)
        grammatical = Model(lexicon, (), context, learn_factors(tried, lexicon, context))
        if lowers_loss(plain, grammatical, tried, others):
            plain = grammatical
    return replace(plain, weights=tuple(logistic(*_features(plain, rows)).tolist()))


class Scorer:
    """Scores and matched clauses of texts."""

    def __init__(self, model: Model):
        self.lexicon, self.machine, self.weights = Lexicon(model.entries, model.context), grammar(factors=model.factors), np.array(model.weights)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        x, matched = [], []
        for t in texts:
            f, clauses = document_features(t or "", self.lexicon, self.machine)
            x.append(f)
            matched.append(",".join(f"{n}:{s:.3f}" for n, s in clauses))
        if not len(self.weights):
            return np.zeros(len(x)), matched
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + np.array(x) @ self.weights[1:], -30, 30))), matched


def _score(model: Model, threshold: float):
    def run(batches):
        scorer = Scorer(model)
        for batch in slices(batches, "text"):
            score, matched = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(matched, pa.string())], ["id", "score", "predicted", "clauses"])

    return run


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score, predicted and clauses ("clause number:score", comma-joined)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model, threshold), f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int, clauses string")


def _predict(model: Model, threshold: float, text_col: str):
    def run(batches):
        scorer = Scorer(model)
        for whole in batches:
            texts = pa.compute.struct_field(whole.column("row"), text_col)
            for batch in slices(iter([pa.RecordBatch.from_arrays([whole.column("row"), texts], ["row", "text"])]), "text"):
                score, _ = scorer(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array((score >= threshold).astype(np.int32))], ["row", "predicted"])

    return run


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns kept, that are not predicted toxic."""
    rows = docs.select(F.struct("*").alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(model, threshold, text_col), f"row {kind}, predicted int").where("predicted = 0").select("row.*")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), train_row("id"))
    out = score_toxicity(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted", "clauses")
