"""Benchmark decontamination, on DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits. Windows of a
document have the size of a benchmark item and are looked at wherever the
document shares a word shingle with an item, laid so that the shared shingle
falls on its place in the item. A window similar enough to be reported shares
a run of consecutive shingles with the item whose least length follows from
the item's size, so of the document's shingles only every `stride`th is looked
up, with a stride below that length: no window is lost by it.

Every window gets a 64-bit SimHash of its shingles, weighted by their number.
Fingerprints are cut into radius + 1 blocks; two within the radius agree in at
least one block, so an equi-join on (window size, block number, block) finds all
items within the radius. The weighted shingle similarity - the sum of the lesser
counts over the sum of the greater - then decides exactly.

Null, empty and odd input: texts or items that are null or have no words match
nothing. Items of fewer than `k` words are one shingle, and so are their
windows. Windows of repeated rows, or of rows with one id, are reported once for
each (doc_id, item_id), with the greatest similarity, the first window on ties.
Rows without an id are reported with a null id. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table


def words_of(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(clean != "", F.split(clean, " ", -1)).otherwise(F.array().cast("array<string>"))


def shingle(words: Column, at: Column, k: Column | int) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, at + 1, k), " "))


def shingles(words: Column, k: Column) -> Column:
    """Hashes of all runs of k words, in order, repeats included."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: shingle(words, i, k))


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint as a long: each bit is the majority of the shingles'."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda a, x: a + F.getbit(x, b))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(bit(b)))


def blocks(fingerprint: Column, radius: int) -> Column:
    """(block number, value) of the radius + 1 blocks of a fingerprint."""
    n = radius + 1
    ends = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value")) for i, (a, b) in enumerate(zip(ends, ends[1:]))))


def weighted_similarity(a: Column, b: Column) -> Column:
    def count(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def least_run(n: int, similarity: float, k: int) -> int:
    """Least length of the longest run of shared shingles between an item of n
    shingles and a window of that size. At least 2 s n / (1 + s) are shared; a
    change within takes k - 1 of the item's shingles or more."""
    shared = -(-2 * similarity * n // (1 + similarity))
    breaks = int((n - shared) // max(1, k - 1))
    return max(1, int(shared // (breaks + 1)))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, similarity: float = 0.8, radius: int = 23, max_broadcast: int = 200_000) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each
    document for each item it holds."""
    own = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0)
    own = own.withColumn("n_words", F.size("item_words")).withColumn("k", F.least(F.lit(k), "n_words"))
    own = materialize(own.withColumn("item_shingles", shingles(F.col("item_words"), F.col("k"))).withColumn("item_fp", simhash(F.col("item_shingles"))))
    n_items = F.size("item_shingles")
    sizes = {r["k"]: range(r["low"], r["high"] + 1) for r in own.groupBy("k").agg(F.min(n_items).alias("low"), F.max(n_items).alias("high")).collect()}  # k rows at most
    n_shingles = own.agg(F.sum(F.size("item_shingles")).alias("n")).first()["n"] or 0
    small = n_shingles <= max_broadcast
    place = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, item_id {items.schema[item_id].dataType.simpleString()}, similarity double, first_word int, n_words int"
    if not sizes:
        return docs.sparkSession.createDataFrame([], out)
    stride = {kk: min(8, *(least_run(n, similarity, k) for n in ns), 8) for kk, ns in sizes.items()}
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    probes = None
    for kk, step in stride.items():
        w = keyed.select("doc_id", "text_key", words_of(F.col("text")).alias("words")).where(F.size("words") >= kk)
        found = F.transform(F.sequence(F.lit(0), F.size("words") - kk, F.lit(step)), lambda i: shingle(F.col("words"), i, kk))
        one = w.select("doc_id", "text_key", F.posexplode(found).alias("nth", "shingle")).select("doc_id", "text_key", (F.col("nth") * step).alias("at"), "shingle", F.lit(kk).alias("k"))
        probes = one if probes is None else probes.unionByName(one)
    index = own.select("k", "n_words", F.posexplode("item_shingles").alias("item_at", "shingle")).groupBy("k", "shingle").agg(F.collect_set(F.struct("n_words", "item_at")).alias("places"))
    met = probes.join(place(index), ["k", "shingle"]).select("doc_id", "text_key", "at", "k", F.explode("places").alias("p"))
    starts = materialize(met.select("doc_id", "text_key", "k", F.col("p.n_words").alias("n_words"), (F.col("at") - F.col("p.item_at")).alias("start")).distinct())
    spots = starts.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("k", "n_words", "start")).alias("spots"))
    texts = keyed.join(spots.withColumnRenamed("doc_id", "spot_doc").withColumnRenamed("text_key", "spot_key"), F.col("doc_id").eqNullSafe(F.col("spot_doc")) & (F.col("text_key") == F.col("spot_key")))
    texts = texts.select("doc_id", words_of(F.col("text")).alias("words"), "spots")
    wide = texts.select("doc_id", F.transform("spots", lambda s: F.struct(s["k"].alias("k"), s["n_words"].alias("n_words"), F.greatest(F.lit(0), F.least(s["start"], F.size("words") - s["n_words"])).alias("start"))).alias("spots"), "words")
    cut = F.transform(F.array_distinct("spots"), lambda s: F.struct(s["k"].alias("k"), s["n_words"].alias("n_words"), s["start"].alias("start"), F.slice("words", s["start"] + 1, s["n_words"]).alias("window")))
    windows = wide.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*").where(F.size("window") >= F.col("k"))
    # the same window text, as in copies, is worked on once
    windows = windows.withColumn("window_key", F.sha2(F.array_join("window", " ").cast("binary"), 256))
    windows = materialize(windows)
    unique = windows.groupBy("window_key", "k", "n_words").agg(F.first("window").alias("window"))
    prints = materialize(unique.withColumn("shingles", shingles(F.col("window"), F.col("k"))).withColumn("fp", simhash(F.col("shingles"))).drop("window"))
    left = prints.select("window_key", "k", "n_words", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
    right = own.select("item_id", "k", "n_words", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("b"))
    near = left.join(place(right), ["k", "n_words", "b"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select("window_key", "k", "n_words", "item_id").distinct()
    same = near.join(prints.select("window_key", "k", "n_words", "shingles"), ["window_key", "k", "n_words"]).join(place(own.select("item_id", "k", "n_words", "item_shingles")), ["item_id", "k", "n_words"])
    good = same.withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles"))).where(F.col("similarity") >= similarity).select("window_key", "k", "n_words", "item_id", "similarity")
    hits = windows.select("doc_id", "window_key", "k", "n_words", "start").join(good, ["window_key", "k", "n_words"])
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.s")).alias("first_word"), F.col("b.n_words").alias("n_words"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, that hold no benchmark item."""
    key = F.xxhash64(F.col(text_col))
    hit = contaminated(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, id_col="key").select(F.col("doc_id").alias("hit")).distinct()
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(hit, F.col("key") == F.col("hit"), "left_anti").select("row.*")


def op10_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
