"""Secret scans: fixed patterns, and a randomness test battery with
false-discovery control.

Three base kinds come from patterns: assignments of passwords and keys, access
key ids, and long hex strings. Beyond them, every token of 20 characters or more
is tested: its encoding is inferred from its characters, and chi-squared
uniformity over that alphabet, runs tests over kinds of symbols (upper and lower case,
digits and signs; vowels and others) and lag-1 serial
correlation each give a p-value under "random"; Fisher's sum of their logarithms
is small for random tokens and large for words. How small it gets by chance for
ordinary tokens is measured on decoys: names made of a document's own short
words, as people make them (joined, capitalised, dashed, with numbers between),
in the encoding and length of each class. Tokens that are themselves under test,
and base spans, give no decoys, so secrets cannot hide in their own null. In every
(encoding, length) class the largest cut is taken whose estimated false discovery
rate stays below `fdr`. The cuts need only a histogram, which is summed over all
documents and whose size is fixed. A corpus whose documents make fewer decoys of
a class than about 1 / `fdr` finds none there beside the base kinds.

Null, empty and odd input: null is read as empty; an empty text has no span, and
an empty table gives an empty result. Texts are read whole, for decoys too, however
long they are. Of equal statistics all fall on one side of a cut. Repeated rows are scanned one by one. Extra columns are ignored,
or carried whole by `redact_secrets`. Offsets count code points, ends are
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
HINTS = ("passw", "secret", "token", "api")

LOWER, UPPER, DIGIT, VOWEL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "aeiouAEIOU"
ALPHABETS = {
    "lower26": LOWER,
    "upper26": UPPER,
    "alpha52": UPPER + LOWER,
    "HEX": DIGIT + "ABCDEF",
    "base32": UPPER + "234567",
    "lower36": LOWER + DIGIT,
    "upper36": UPPER + DIGIT,
    "alnum62": UPPER + LOWER + DIGIT,
    "base64": UPPER + LOWER + DIGIT + "+/",
    "base64url": UPPER + LOWER + DIGIT + "-_",
}
ENCODINGS = list(ALPHABETS)
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}


def _symbol_kinds(letters: str) -> list[np.ndarray]:
    """Kinds of symbols: letters of either case, figures and signs; vowels and others."""
    kinds = [next(i for i, x in enumerate((LOWER, UPPER, DIGIT, letters)) if c in x) for c in letters]
    vowels = [int(c in VOWEL) for c in letters]
    return [np.array(x) for x in (kinds, vowels) if len(set(x)) > 1]


def _folded(letters: str) -> tuple[np.ndarray, np.ndarray]:
    low = sorted(set(letters.lower()))
    symbols = np.array([low.index(c) for c in letters.lower()])
    return symbols, np.bincount(symbols) / len(letters)


_FOLDED = [_folded(x) for x in ALPHABETS.values()]
_KINDS = [_symbol_kinds(x) for x in ALPHABETS.values()]
_CODE = []
for _letters in ALPHABETS.values():
    _CODE.append(np.zeros(128, dtype=np.int64))
    _CODE[-1][[ord(c) for c in _letters]] = np.arange(len(_letters))
LENGTHS = (20, 24, 28, 32, 40, 56)  # least length of each class
BINS = 400
BIN_WIDTH = 0.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out


def infer_encoding(token: str) -> int | None:
    """The first alphabet that has all its characters; figures alone, and signs of
    two alphabets, are no encoding."""
    chars = set(token)
    if not any(c.isalpha() for c in chars):
        return None
    return next((i for i, k in enumerate(ENCODINGS) if chars <= _SETS[k]), None)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal law, by a rational approximation of erfc."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * np.exp(-x * x)
    return np.where(z >= 0, tail, 1 - tail)


def battery(codes: np.ndarray, encoding: int) -> np.ndarray:
    """-2 * sum of log p over the three tests, for rows of symbols of an encoding."""
    m, n = codes.shape
    size = len(ALPHABETS[ENCODINGS[encoding]])
    symbols, share = _FOLDED[encoding]  # letters of either case are one symbol
    counts = np.bincount((np.arange(m)[:, None] * len(share) + symbols[codes]).ravel(), minlength=m * len(share)).reshape(m, len(share))
    df = len(share) - 1
    chi = ((counts - n * share) ** 2 / (n * share)).sum(axis=1)
    uniform = _normal_tail((np.cbrt(chi / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    ps = [uniform]
    for kinds in _KINDS[encoding]:
        share = np.bincount(kinds) / size
        change = 1 - (share**2).sum()  # of kind, between two symbols
        var = (n - 1) * change * (1 - change) + 2 * (n - 2) * ((share * (1 - share) ** 2).sum() - change**2)
        own = kinds[codes]
        runs = (own[:, 1:] != own[:, :-1]).sum(axis=1)
        ps.append(2 * _normal_tail(np.abs(runs - (n - 1) * change) / math.sqrt(var)))
    x = codes - codes.mean(axis=1, keepdims=True)
    square = (x * x).sum(axis=1)
    serial = np.where(square > 0, (x[:, 1:] * x[:, :-1]).sum(axis=1) / np.maximum(square, 1e-9), 1.0)
    ps.append(2 * _normal_tail(np.abs(serial * n + 1) / math.sqrt(n)))
    p = np.clip(np.stack(ps), 1e-30, 1)
    return -2 * np.log(p).sum(axis=0)


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[list, list]:
    """Hex spans, and (start, end, encoding number, length class, statistic) of
    the tokens to be tested that meet no base span."""
    hexes, tests = [], []
    longs = list(LONG.finditer(text))
    for m in longs:
        hexes += [(m.start() + h.start(), 2, m.start() + h.end()) for h in HEX.finditer(m[0])]
    taken = base + hexes
    for m in longs:
        s, e = m.span()
        body = m[0].rstrip("=")
        if len(body) < LENGTHS[0] or any(a < e and s < b for a, _, b in taken):
            continue
        enc = infer_encoding(body)
        if enc is not None:
            raw = _CODE[enc][np.frombuffer(body.encode("ascii"), dtype=np.uint8)]
            tests.append((s, e, enc, length_class(len(body)), float(battery(raw[None, :], enc)[0])))
    return hexes, tests


#: A word that is no part of a longer token or of an assignment; names leave out
#: shorter ones, as articles.
WORD = re.compile(r"(?<![A-Za-z0-9+/_.=:-])[A-Za-z]{4,14}(?![A-Za-z0-9+/_=:-])")
#: Letters as the six that sixteen figures need.
SIXTEEN = str.maketrans({c: "ABCDEF"[i % 6] for i, c in enumerate(UPPER)})
DIGITS32 = str.maketrans("0189", "4625")


def name(words: list[str], seed: int, e: int) -> str:
    """A name that people make of words in an encoding, with a number or two between
    or without."""
    numbers, x = [""] * len(words), seed
    for _ in range(1 + seed % 2):  # one number or two, of eight digits at most
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        numbers[min(len(words) - 1, x % 4)] = str(x)[: 1 + x // 4 % 8]
    pairs = list(zip(words, numbers))
    kind = ENCODINGS[e]
    if kind == "base64":
        made = "/".join((w.lower(), w.capitalize())[seed & 1] + n for w, n in pairs)
    elif kind == "base64url":
        made = "-_"[seed & 1].join((w.lower(), w.capitalize())[seed & 2 > 0] + n * (seed & 4 > 0) for w, n in pairs)
    elif kind == "alnum62":
        made = "".join(w.capitalize() + n for w, n in pairs)
    elif kind == "alpha52":
        made = "".join(w.capitalize() for w in words)
    elif kind in ("lower26", "upper26"):
        made = "".join(words).lower() if kind == "lower26" else "".join(words).upper()
    else:
        made = "".join(w + n for w, n in pairs)
        made = made.lower() if kind == "lower36" else made.upper()
        made = made.translate(DIGITS32) if kind == "base32" else made.translate(SIXTEEN) if kind == "HEX" else made
    return made


def stretches(text: str, base: list[tuple[int, int, int]]) -> Iterator[list[str]]:
    """All words outside base spans, in order, some letters more than the longest
    class at a time; what is left at the end is a stretch too."""
    words = WORD.findall(text) if not base else [m[0] for m in WORD.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in base)]
    own, size = [], 0
    for w in words:
        own.append(w)
        size += len(w)
        if size >= LENGTHS[-1]:
            yield own
            own, size = [], 0
    if size >= LENGTHS[0]:
        yield own


def decoys(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> dict[int, int]:
    """Numbered histogram cells (encoding, length class, bin), and how many names
    made of words outside base spans fall there. Each word of a text is in one stretch
    of words, long enough for a name of every length. A text's first stretch makes a
    name of every encoding, so that short texts do, and each further one makes one, of
    an encoding dealt by its hash: no text and no word is left out of the null."""
    found: list[list[str]] = [[] for _ in ENCODINGS]
    for text, base in zip(texts, bases):
        for i, own in enumerate(stretches(text, base)):
            seed = zlib.crc32(" ".join(own).encode())
            for e in range(len(ENCODINGS)) if i == 0 else [(seed >> 8) % len(ENCODINGS)]:
                found[e].append(name(own, seed, e))
    out: dict[int, int] = {}
    for e, made in enumerate(found):
        for c, n in enumerate(LENGTHS):
            if made := [x for x in made if len(x) >= n]:
                own = np.frombuffer("".join(x[:n] for x in made).encode(), dtype=np.uint8).reshape(-1, n)
                bins = np.bincount(np.minimum(BINS - 1, (battery(_CODE[e][own], e) / BIN_WIDTH).astype(int)))
                out.update(((e * len(LENGTHS) + c) * BINS + x, int(bins[x])) for x in np.flatnonzero(bins).tolist())
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<array<int>>, tests array<struct<s:int,e:int,enc:int,len:int,stat:double>>, decoys array<struct<bin:int,n:long>>"


def _scan(batches):
    for batch in slices(batches, "text"):
        base_out, tests_out, sums, counts = [], [], [], []
        texts = [t or "" for t in batch.column("text").to_pylist()]
        bases = [base_spans(t) for t in texts]
        made = [{"bin": k, "n": n} for k, n in decoys(texts, bases).items()]  # with the first row of a slice
        for t, base in zip(texts, bases):
            hexes, tests = candidates(t, base)
            base = sorted(base + hexes)
            base_out.append([list(x) for x in base])
            tests_out.append([dict(zip(("s", "e", "enc", "len", "stat"), x)) for x in tests])
            sums.append(hashlib.sha256(digest(base).encode()).hexdigest())
            counts.append([sum(k == j for _, k, _ in base) for j in range(3)])
        n = list(zip(*counts))
        arrays = [batch.column("row"), *(pa.array(x, pa.int64()) for x in n), pa.array(sums, pa.string()), pa.array(base_out, pa.list_(pa.list_(pa.int32()))), pa.array(tests_out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("enc", pa.int32()), ("len", pa.int32()), ("stat", pa.float64())]))), pa.array([made, *[[]] * (len(texts) - 1)], pa.list_(pa.struct([("bin", pa.int32()), ("n", pa.int64())])))]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tests", "decoys"])


def cuts(scanned: DataFrame, fdr: float) -> dict[tuple[int, int], float]:
    """Largest statistic of each class whose estimated false discovery rate is
    at most fdr: share of decoys at or below it, times tests, over tests at or
    below it."""
    null = scanned.select(F.inline("decoys")).groupBy("bin").agg(F.sum("n").alias("n")).select("bin", F.lit(0).alias("kind"), "n")
    own = scanned.select(F.explode("tests").alias("t")).select((F.col("t.enc") * len(LENGTHS) + F.col("t.len")).alias("c"), F.least(F.lit(BINS - 1), F.floor(F.col("t.stat") / BIN_WIDTH)).alias("b"))
    own = own.groupBy((F.col("c") * BINS + F.col("b")).cast("int").alias("bin")).agg(F.count("*").alias("n")).select("bin", F.lit(1).alias("kind"), "n")
    hist = np.zeros((2, len(ENCODINGS) * len(LENGTHS) * BINS))
    for r in null.unionByName(own).collect():  # a fixed number of bins
        hist[r["kind"], r["bin"]] = r["n"]
    hist = hist.reshape(2, -1, BINS)
    out = {}
    for c in range(hist.shape[1]):
        d, t = np.cumsum(hist[0, c]), np.cumsum(hist[1, c])
        if not t[-1]:
            continue
        share = (d + 1) / (d[-1] + 1)  # with few decoys little is found
        fine = np.flatnonzero((t > 0) & (share * t[-1] <= fdr * t))
        if len(fine):
            out[divmod(c, len(LENGTHS))] = float((fine[-1] + 1) * BIN_WIDTH)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scanned = materialize(rows.mapInArrow(_scan, f"row {kind}, {_SCANNED}"))
    limits = cuts(scanned, fdr)
    flat = F.create_map(*(x for (e, c), cut in limits.items() for x in (F.lit(e * len(LENGTHS) + c), F.lit(cut)))) if limits else F.lit(None).cast("map<int,double>")
    found = F.filter("tests", lambda t: F.coalesce(t["stat"] < F.try_element_at(flat, t["enc"] * len(LENGTHS) + t["len"]), F.lit(False)))
    every = F.array_sort(F.concat(
        F.transform("base", lambda b: F.struct(F.get(b, 0).alias("s"), F.get(b, 1).alias("k"), F.get(b, 2).alias("e"))),
        F.transform(found, lambda t: F.struct(t["s"].alias("s"), F.lit(3).alias("k"), t["e"].alias("e"))),
    ))
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    return scanned.select(F.col("row").alias("id"), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(found).cast("long").alias("n_random"))


def op5_secrets(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _redact(mask: str):
    def run(batches):
        for batch in slices(batches, "text"):
            texts = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if t is not None and spans:
                    parts, last = [], 0
                    for x in spans.split(","):
                        a, b = map(int, x.split(":")[1:])
                        if b <= last:
                            continue
                        parts += [t[last : max(a, last)], mask if a >= last else ""]
                        last = b
                    t = "".join([*parts, t[last:]])
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return run


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", fdr: float = 0.01) -> DataFrame:
    """The rows of docs, all columns kept, with every found span masked."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.struct(F.col(id_col).alias("i"), key.alias("k")).alias("key"), F.col(text_col).alias("text"))
    spans = scan_secrets(keyed, "key", "text", fdr).where(F.col("spans") != "").select("id", "spans").dropDuplicates(["id"])
    row = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), key.alias("k"), F.col(id_col).alias("i"))
    met = row.join(spans.select(F.col("id.i").alias("i2"), F.col("id.k").alias("k2"), "spans"), (F.col("k") == F.col("k2")) & F.col("i").eqNullSafe(F.col("i2")), "left")
    clean = met.where(F.col("spans").isNull()).select("row", "text")
    masked = met.where(F.col("spans").isNotNull()).select("row", "text", "spans").mapInArrow(_redact(mask), f"row {row.schema['row'].dataType.simpleString()}, text string")
    return clean.unionByName(masked).select(*(F.col("text").alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
