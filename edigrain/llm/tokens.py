"""Token counts under a unigram model, by dynamic programming over a trie.

Pre-tokens are runs of non-space characters with a leading word mark. The
distinct pre-tokens of a slice of documents form a trie, built level by level;
the best forward score of a prefix - over all ways to cut it into vocabulary
pieces - is computed once for each trie node, from the scores of its ancestors,
and the piece count of the best way is stored with it. A pre-token's count is
read at its terminal node, and a document's is the sum over its pre-tokens.

The vocabulary is read from a public tokenizer file. The file holds merge
ranks, which are no unigram scores: a piece's score is that of Zipf's law over
the ranks, log(1 / (rank + 10)) up to a constant. Characters without a piece
cost the lowest score less 10, and neighbours of them are one unknown token, as
in the usual unigram tokenizers.

Null, empty and odd input: null and empty texts have 0 tokens. Repeated rows are
counted one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, table

MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACES = {i: " " for i in range(9, 14)}


def load_pieces(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, control and byte pieces left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    weight = 1 / (np.arange(len(ids)) + 10.0)
    score = np.log(weight / weight.sum())
    return [(sp.id_to_piece(i), float(s)) for i, s in zip(ids, score)]


class Unigram:
    """Pieces by length, as sorted hashes with their scores."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(s for _, s in pieces) - 10.0
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths: dict[int, dict[int, float]] = {}
        for p, s in pieces:
            h = 0
            for c in p:
                h = (h * int(BASE) + symbol(ord(c))) & 0xFFFFFFFFFFFFFFFF
            lengths.setdefault(len(p), {})[h] = s
        for n, own in lengths.items():
            keys = np.array(sorted(own), dtype=np.uint64)
            self.by_length[n] = keys, np.array([own[int(k)] for k in keys])
        self.longest = max(lengths)

    def lookup(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Scores of pieces of n characters; -inf where there is none."""
        if n not in self.by_length:
            return np.full(len(hashes), -np.inf)
        keys, scores = self.by_length[n]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, scores[at], -np.inf)


def symbol(c: int) -> int:
    return int(mix64(np.array([c + 1], dtype=np.uint64))[0])


def trie_counts(words: list[str], model: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and unknown tokens of each distinct word, mark included."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    codes = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    node = np.zeros(len(words), dtype=np.int64)  # of each word, at the current depth
    parents, hashes = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.uint64)]
    best, count, unknown, ends_unknown = [np.zeros(1)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=bool)]
    out, out_unknown = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    alive, depth = order, 0
    power = [np.uint64(1)]
    for _ in range(model.longest):
        power.append(np.uint64(int(power[-1]) * int(BASE) & 0xFFFFFFFFFFFFFFFF))
    while len(alive):
        depth += 1
        char = codes[starts[alive] + depth - 1]
        key, own = np.unique(node[alive].astype(np.uint64) << np.uint64(21) | char, return_inverse=True)
        node[alive] = own
        parent = (key >> np.uint64(21)).astype(np.int64)
        here = hashes[depth - 1][parent] * BASE + mix64((key & np.uint64(0x1FFFFF)) + np.uint64(1))
        parents.append(parent)
        hashes.append(here)
        above = [np.arange(len(key)), parent]
        for n in range(2, min(depth, model.longest) + 1):
            above.append(parents[depth - n + 1][above[-1]])
        top = np.full(len(key), -np.inf)
        c, u, e = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
        for n in range(min(depth, model.longest), 0, -1):  # the longest piece wins ties
            a = above[n]
            piece = model.lookup(here - hashes[depth - n][a] * power[n], n)
            odd = np.isneginf(piece) if n == 1 else np.zeros(0, dtype=bool)
            if n == 1:
                piece = np.where(odd, model.unknown, piece)
            score = best[depth - n][a] + piece
            take = np.flatnonzero(score > top)
            top[take] = score[take]
            src = a[take]
            is_odd = odd[take] if n == 1 else np.zeros(len(take), dtype=bool)
            joined = is_odd & ends_unknown[depth - n][src]
            c[take] = count[depth - n][src] + ~joined
            u[take] = unknown[depth - n][src] + (is_odd & ~joined)
            e[take] = is_odd
        best.append(top)
        count.append(c)
        unknown.append(u)
        ends_unknown.append(e)
        done = depth - model.longest
        if done > 0:  # out of reach of any piece
            best[done - 1] = count[done - 1] = unknown[done - 1] = ends_unknown[done - 1] = hashes[done - 1] = parents[done - 1] = None
        closing = alive[lengths[alive] == depth]
        out[closing], out_unknown[closing] = c[node[closing]], u[node[closing]]
        alive = alive[lengths[alive] > depth]
    return out, out_unknown


def _count(model: Unigram):
    def run(batches):
        for batch in slices(batches, "text", 16 << 20):
            texts = batch.column("text").to_pylist()
            words: list[str] = []
            sizes = np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                if t:
                    got = [w for w in t.translate(SPACES).split(" ") if w]
                    sizes[i] = len(got)
                    words += got
            tokens = unknown = np.zeros(len(texts), dtype=np.int64)
            if words:
                code, distinct = pd.factorize(np.array(words, dtype=object))
                del words
                n, u = trie_counts(list(distinct), model)
                doc = np.repeat(np.arange(len(texts)), sizes)
                tokens = np.bincount(doc, weights=n[code], minlength=len(texts)).astype(np.int64)
                unknown = np.bincount(doc, weights=u[code], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(tokens), pa.array(unknown)], ["id", "n_words", "n_tokens", "n_unknown"])

    return run


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens and n_unknown of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(Unigram(pieces)), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


def op8_tokens(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), load_pieces()).withColumnRenamed("id", "doc_id")
