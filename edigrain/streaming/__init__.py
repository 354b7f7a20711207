"""Validation of interchanges as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import History
from ..operators.store import share
from ..sources import x12


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, text) of whole files that appear below path."""
    lines = spark.readStream.format("text").option("wholetext", "true").load(path)
    return lines.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))


def write_control_issues(files: DataFrame, out: str, checkpoint: str):
    """Append the control issues of every new file to a Parquet folder. A file is
    whole when it is seen, so each batch is checked by itself."""

    def batch(df: DataFrame, _: int) -> None:
        x12.control_issues(x12.number_envelopes(x12.tokenize(df))).write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def pair_streams(transactions: DataFrame, outputs: DataFrame, lateness: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """Pairs of two streams of (key, doc, at): key, source_doc, target_doc, at and
    issue. A transaction and an output of one key pair if `within` lies between them
    at most; one that finds no partner by then is emitted alone, as missing_output or
    unexpected_output, once the watermark (the latest time seen, less `lateness`) has
    passed it. State is kept for as long as a partner may come, and no longer. Rows
    without a key find none; rows later than the watermark are dropped, as streams
    do. Each of several holders of a key pairs with each partner in time: keys that
    repeat are what `pair_runs` reports over whole runs."""
    side = lambda df, p: df.select(F.col("key").alias(f"{p}_key"), F.col("doc").alias(f"{p}_doc"), F.col("at").alias(f"{p}_at")).withWatermark(f"{p}_at", lateness)
    near = F.expr(f"source_key = target_key AND target_at BETWEEN source_at - INTERVAL {within} AND source_at + INTERVAL {within}")
    met = side(transactions, "source").join(side(outputs, "target"), near, "full_outer")
    issue = F.when(F.col("target_at").isNull(), "missing_output").when(F.col("source_at").isNull(), "unexpected_output")
    return met.select(F.coalesce("source_key", "target_key").alias("key"), "source_doc", "target_doc", F.coalesce("source_at", "target_at").alias("at"), issue.alias("issue"))


def write_gate(findings: DataFrame, history: History, baseline_key: str, spec_file: str, out: str, checkpoint: str, first_run: int = 1):
    """Record each batch of a stream of findings as a run and hold it against the
    baseline of a key: out has batch, run_id, changes, regressions and passed. The
    first batch is blessed if the key has no baseline. A batch that is run again, as
    after a failure, replaces its run and its row."""

    def batch(df: DataFrame, n: int) -> None:
        run_id, at = first_run + n, f"{n:012d}"
        rows = share(df)
        history.record(run_id, rows, spec_file, at)
        if not _has_baseline(history, baseline_key):
            history.bless(baseline_key, run_id, "first batch", at)
        changes = history.regress_from_baseline(baseline_key, run_id)
        told = changes.agg(F.count("*").alias("changes"), F.count_if("regression").alias("regressions"))
        row = told.select(F.lit(run_id).cast("long").alias("run_id"), "changes", "regressions", (F.col("regressions") == 0).alias("passed"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return findings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _has_baseline(history: History, key: str) -> bool:
    fs_path = history.spark._jvm.org.apache.hadoop.fs.Path(f"{history.path}/baselines")
    there = fs_path.getFileSystem(history.spark._jsc.hadoopConfiguration()).exists(fs_path)
    return there and history.baseline(key) is not None
