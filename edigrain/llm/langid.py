"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word; the word's score
for each candidate is its mean character n-gram log-likelihood; a Viterbi pass
over the words, with a penalty for every switch, labels spans. The language of
a document is the one whose spans hold most letters, and the score is that
share.

The n-gram model is fitted on a bounded sample: about `docs_per_lang` whole
documents of each language, chosen by a hash of doc_id, and learned features
are hashed to FEATURES buckets, so its size does not grow with the corpus.

Null, empty and odd input: a null text or one without letters gives `und`,
score 0 and no spans. Rows without a language teach nothing. With no labelled
row at all every text is `und`. Repeated rows are labelled one by one; extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, mix64, slices, table, train_row

FEATURES = 1 << 16
ORDERS = (1, 2, 3, 4)
WORD = re.compile(r"[^\W\d_]+")
EDGE = 2  # a control character that stands for both ends of a word

#: First code points of script ranges and the script's number (0: Latin and the rest).
SCRIPTS = (
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0900, 6), (0x0980, 7),
    (0x0A00, 8), (0x0B80, 9), (0x0C00, 10), (0x0E00, 11), (0x0E80, 12), (0x10A0, 13), (0x1100, 14),
    (0x1200, 15), (0x1780, 16), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 17), (0x3100, 18),
    (0x3130, 14), (0x3190, 18), (0xAC00, 14), (0xD7B0, 18), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5),
    (0xFE00, 0), (0x20000, 18),
)
_STARTS = np.array([s for s, _ in SCRIPTS], dtype=np.int64)
_SCRIPT = np.array([n for _, n in SCRIPTS], dtype=np.int64)
N_SCRIPTS = int(_SCRIPT.max()) + 1


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    return _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, n-gram order, hashed n-gram) of every n-gram within a word,
    its edges included."""
    mark = chr(EDGE)
    codes = np.frombuffer((mark + mark.join(words) + mark).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    edge = codes == EDGE
    owner = np.cumsum(edge) - 1
    which, order, grams = [], [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, dtype=np.uint64)
        fine = np.ones(m, dtype=bool)
        for i in range(n):
            h = mix64(h * np.uint64(31) + codes[i : m + i] + np.uint64(n))
            if 0 < i < n - 1:
                fine &= ~edge[i : m + i]
        if n == 1:
            fine &= ~edge
        if n == 2:
            fine &= ~(edge[:m] & edge[1 : m + 1])
        at = np.flatnonzero(fine)
        which.append(owner[at])
        order.append(np.full(len(at), n))
        grams.append((h[at] % np.uint64(FEATURES)).astype(np.int64))
    return np.concatenate(which), np.concatenate(order), np.concatenate(grams)


def _count(batches):
    """Counts of (lang, kind, key): kind n is an n-gram of that order, 0 a script."""
    for batch in batches:
        for lang in pa.compute.unique(batch.column("lang")).to_pylist():
            rows = batch.filter(pa.compute.equal(batch.column("lang"), lang))
            words: list[str] = []
            for t in rows.column("text").to_pylist():
                words += WORD.findall(t.lower())
            if not words:
                continue
            _, order, grams = features_of(words)
            key, n = np.unique(np.concatenate([order * FEATURES + grams, scripts_of(words)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(key), "key": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())})


class Model:
    """Languages, weights[feature key, language] and allowed[script, language]."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        k = len(self.langs)
        raw = np.zeros(((max(ORDERS) + 1) * FEATURES, k))
        place = {x: i for i, x in enumerate(self.langs)}
        np.add.at(raw, (counts["key"].to_numpy(dtype=np.int64), counts["lang"].map(place).to_numpy(dtype=np.int64)), counts["n"].to_numpy(dtype=float))
        script = raw[:N_SCRIPTS]
        self.allowed = script > 0.005 * np.maximum(script.sum(axis=0), 1) if k else np.zeros((N_SCRIPTS, 0), dtype=bool)
        self.allowed[~self.allowed.any(axis=1)] = True
        self.weights = np.zeros_like(raw, dtype=np.float32)
        for n in ORDERS:
            part = raw[n * FEATURES : (n + 1) * FEATURES]
            used = max(1, int((part.sum(axis=1) > 0).sum()))
            self.weights[n * FEATURES : (n + 1) * FEATURES] = np.log((part + 0.5) / (part.sum(axis=0) + 0.5 * used))

    def score(self, words: list[str]) -> np.ndarray:
        """Mean n-gram log-likelihood of each word for each language, against
        the best; languages that don't use the word's script are far below."""
        which, order, grams = features_of(words)
        rows = order * FEATURES + grams
        size = np.maximum(np.bincount(which, minlength=len(words)), 1)
        out = np.stack([np.bincount(which, weights=self.weights[rows, j], minlength=len(words))[: len(words)] / size for j in range(len(self.langs))], axis=1)
        out = np.where(self.allowed[scripts_of(words)], out, -30.0)
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; documents are runs of `sizes` rows from `starts`.
    All documents advance together, one word a step."""
    n, k = scores.shape
    path = np.zeros(n, dtype=np.int8 if k < 128 else np.int32)
    if not n:
        return path
    by = np.argsort(-sizes, kind="stable")
    start, size = starts[by], sizes[by]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # documents longer than t
    switched = np.zeros((n, k), dtype=bool)
    top = np.zeros(n, dtype=path.dtype)
    v = np.zeros((len(by), k), dtype=np.float32)
    for t in range(steps):
        a = active[t]
        at = start[:a] + t
        w = v[:a]
        arg = w.argmax(axis=1)
        jump = w[np.arange(a), arg] - penalty
        top[at] = arg
        sw = w < jump[:, None]
        switched[at] = sw
        w = np.where(sw, jump[:, None], w) + scores[at]
        v[:a] = w - w.max(axis=1, keepdims=True)
    label = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        path[at] = label[:a]
        label[:a] = np.where(switched[at, label[:a]], top[at], label[:a])
    return path


def _label(model: Model, penalty: float, id_type: pa.DataType):
    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            texts = batch.column("text").to_pylist()
            words: list[str] = []
            sizes = np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                if t:
                    got = WORD.findall(t.lower())
                    sizes[i] = len(got)
                    words += got
            lang, score, spans = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
            if words and model.langs:
                code, distinct = pd.factorize(np.array(words, dtype=object))
                del words
                per_word = model.score(list(distinct))
                letters = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))[code]
                starts = np.cumsum(sizes) - sizes
                path = viterbi(per_word[code], starts, sizes, penalty).astype(np.int64)
                k = len(model.langs)
                doc = np.repeat(np.arange(len(texts)), sizes)
                held = np.bincount(doc * k + path, weights=letters, minlength=len(texts) * k).reshape(-1, k)
                cut = np.flatnonzero(np.diff(doc * k + path, prepend=-1))
                ends = np.append(cut[1:], len(path))
                parts: list[list[str]] = [[] for _ in texts]
                for a, b in zip(cut.tolist(), ends.tolist()):
                    d = doc[a]
                    parts[d].append(f"{a - starts[d]}:{b - starts[d]}:{model.langs[path[a]]}")
                for i in np.flatnonzero(sizes).tolist():
                    j = int(held[i].argmax())
                    lang[i], score[i], spans[i] = model.langs[j], float(held[i, j] / held[i].sum()), ",".join(parts[i])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], ["id", "lang_pred", "score", "spans"])

    return run


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 400) -> Model:
    """Fit on about docs_per_lang documents of each language of the usable rows."""
    rows = docs.where(F.coalesce(usable, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("total"))
    sample = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.expr(f"pmod(xxhash64(`{id_col}`, 'sample'), 1048576)").alias("place"))
    sample = sample.join(F.broadcast(totals), "lang").where(F.col("place") * F.col("total") < 1048576.0 * docs_per_lang).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return Model(counts.toPandas())


def label_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 4.0) -> DataFrame:
    """id, lang_pred, score and spans ("first word:end word:lang", comma-joined;
    words are runs of letters)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_label(model, penalty, None), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans string")


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, train_row())
    out = label_languages(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "spans")
