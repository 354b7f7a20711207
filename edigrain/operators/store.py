"""Results that several checks read: written once, with their distribution."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Use the checkpoint folder the session names. Only a session without other
    machines may do with a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="edigrain-")
    sc.setCheckpointDir(named)


def shared_path(spark: SparkSession) -> str:
    """The checkpoint folder that all executors see."""
    shared_folder(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def share(df: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder. Lineage ends
    there. Rows dealt by `by` are written to buckets, so that windows and joins on it
    need no shuffle: as many as the session has partitions, or `parts`, which large
    tables need, since one task reads a bucket whole."""
    spark = df.sparkSession
    name = f"edigrain_{uuid.uuid4().hex}"
    path = f"{shared_path(spark)}/{name}"
    if not by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.format("parquet").option("path", path).bucketBy(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).saveAsTable(name)
    return spark.table(name)
