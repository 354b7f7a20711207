"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names. Only a session without other
    machines may do with a folder of its own, where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="edigrain-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends
    there, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/edigrain-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote for df, which nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Generations:
    """A table that is written anew in each round of an algorithm. The round
    before is deleted once its successor is whole, so two are on disk at most."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/edigrain-{uuid.uuid4().hex}"
        self.number = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.number += 1
        df.write.parquet(f"{self.path}/{self.number}")
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.number - 1}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.number}")


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files that only dropped DataFrames refer to. Spark deletes
    them when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train_row(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves a remainder other than 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about max_bytes of column
    (a longer single value stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """64-bit hashes of every window of a long sequence of 64-bit symbols, from
    prefix sums: sum(a[i] * B**i) over a window, divided by B**start (B is odd,
    so it has an inverse modulo 2**64)."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * _powers(base, n + 1)[:n], out=self.prefix[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix64((self.prefix[start + length] - self.prefix[start]) * self.inverse[start])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.prefix) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix64((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        one = np.full(size, base & ((1 << 64) - 1), dtype=np.uint64)
        one[0] = 1
        have = np.cumprod(one)
        if size <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of every window of `width` values, by their upper 32
    bits, the leftmost on ties."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64(0xFFFFFFFF)
    cur = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:  # minima of windows of 2, 4, 8, ...
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    if size < width:
        cur = np.minimum(cur[:n], cur[width - size : width - size + n])
    return (cur[:n] & low).astype(np.int64)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def word_hashes(texts: list[bytes | None], chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, 64-bit hashes of all words in order); words are what
    lies between ASCII spaces."""
    sizes, hashes = [], []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < chunk):
            size += len(texts[end] or b"")
            end += 1
        own = [t or b"" for t in texts[at:end]]
        at = end
        data = np.frombuffer(b" ".join([b"", *own, b""]), dtype=np.uint8)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, stop = edge[0::2], edge[1::2]
        first = np.cumsum([1, *(len(t) + 1 for t in own)])[:-1]
        sizes.append(np.bincount(np.searchsorted(first, start, side="right") - 1, minlength=len(own)))
        hashes.append(mix64(RollingHash(_BYTES[data], 0xA0761D6478BD642F).at(start, stop - start) + (stop - start).astype(np.uint64)))
    if not sizes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(sizes).astype(np.int64), np.concatenate(hashes)
