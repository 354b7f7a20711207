"""Run history in Parquet tables: record, bless, diff against a baseline, trends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import share
from .validate import rank, root_causes, rollup

#: Order in which changes are shown.
DELTA_ORDER = ("DOC REMOVED", "NEW", "CHANGED", "DOC ADDED", "RESOLVED")
BAD = ("FAIL", "WARNING")


TABLES = ("findings", "documents", "runs")


class History:
    """Tables findings, documents, runs and baselines below one folder. A run is
    written by write, audit and publish: each attempt writes folders of its own,
    what was written is counted again, and only then a row of the manifest names the
    attempt. Readers see what the manifest names, the latest attempt of a run, so an
    attempt that failed is never read, and a run may be recorded again. Columns may
    be added over time: older rows have nulls there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")

    def manifest(self) -> DataFrame:
        """run_id, attempt, parent, published_at and numbers of rows: the latest
        attempt of each run."""
        w = Window.partitionBy("run_id").orderBy(F.desc("published_at"), F.desc("attempt"))
        return self._read("manifest").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

    def _published(self, name: str, run_id: int | None = None) -> DataFrame:
        named = self.manifest() if run_id is None else self.manifest().where(F.col("run_id") == run_id)
        # attempts are folders, and those of one run are few
        return self._read(name).join(F.broadcast(named.select("attempt")) if run_id is not None else named.select("attempt"), "attempt", "left_semi").drop("attempt")

    def write_attempt(self, run_id: int, findings: DataFrame, spec_file: str, run_at: str, parent: int | None = None, partner_file: str | None = None) -> str:
        """Write a run's rows under a new attempt, which is its result; nobody reads
        them before it is published."""
        attempt, findings = uuid.uuid4().hex, share(findings.withColumn("run_id", F.lit(run_id).cast("long")))  # three tables are written from it
        w = Window.partitionBy("doc").orderBy(rank(), F.coalesce("row_id", F.lit("~")), "line_ix", "target", "source_ref", "actual")
        docs = rollup(findings.where("doc is not null"), "run_id", "doc").withColumn("interchange_id", F.lit(run_id).cast("long"))
        files = findings.agg(F.count_if(F.col("doc").isNull()).alias("file_findings"), F.count_distinct("doc").alias("n_documents"))
        one = self.spark.createDataFrame([(run_id,)], "run_id long").join(rollup(findings, "run_id"), "run_id", "left").crossJoin(F.broadcast(files))  # a row each
        own = one.fillna(0, ["pass", "fail", "warning", "not_tested"]).fillna("PASS", ["result"])
        whole = own.select("run_id", F.lit(run_at).alias("run_at"), F.lit(spec_file).alias("spec_file"), F.lit(partner_file).cast("string").alias("partner_file"), F.lit(parent).cast("long").alias("interchange_id"), "result", "pass", "fail", "warning", "not_tested", "file_findings", "n_documents")
        for name, df in (("findings", findings.withColumn("emit_ord", F.row_number().over(w))), ("documents", docs), ("runs", whole)):
            df.write.parquet(f"{self.path}/{name}/attempt={attempt}")
        return attempt

    def publish(self, run_id: int, attempt: str, at: str, parent: int | None = None) -> None:
        """Count what an attempt has written, and name it in the manifest. Rows that
        are missing are an error: the run's counts have to be those of its findings."""
        of = lambda name: self.spark.read.parquet(f"{self.path}/{name}/attempt={attempt}")
        n_findings, n_documents, run = of("findings").count(), of("documents").count(), of("runs").first()
        counted = sum(run[c] for c in ("pass", "fail", "warning", "not_tested")) if run else 0
        if counted != n_findings or (run["n_documents"] if run else 0) != n_documents:
            raise RuntimeError(f"run {run_id}: {n_findings} findings of {counted}, {n_documents} documents are there")
        row = [(run_id, attempt, parent, at, n_findings, n_documents)]
        self.spark.createDataFrame(row, "run_id long, attempt string, parent long, published_at string, n_findings long, n_documents long").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def record(self, run_id: int, findings: DataFrame, spec_file: str, run_at: str, parent: int | None = None, partner_file: str | None = None) -> None:
        """One row in runs, with counts and the verdict of all its findings; one for
        each document in documents; and the findings in the order they are shown.
        Recording a run again replaces it."""
        self.publish(run_id, self.write_attempt(run_id, findings, spec_file, run_at, parent, partner_file), run_at, parent)

    def sweep(self) -> int:
        """Delete the folders of attempts that no manifest row names any more, and tell
        how many: failed ones, and those of runs recorded again. Nothing may be
        writing meanwhile."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        gone = 0
        keep = {r["attempt"] for r in self.manifest().select("attempt").collect()}  # a row for each run
        for name in TABLES:
            folder = fs_path(f"{self.path}/{name}")
            fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if status.getPath().getName().removeprefix("attempt=") not in keep:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone

    def bless(self, key: str, run_id: int, label: str, at: str) -> None:
        self.spark.createDataFrame([(key, run_id, label, at)], "baseline_key string, run_id long, label string, blessed_at string").coalesce(1).write.mode("append").parquet(f"{self.path}/baselines")

    def baselines(self) -> DataFrame:
        """The latest baseline of each key, newest first."""
        w = Window.partitionBy("baseline_key").orderBy(F.desc("blessed_at"), F.desc("run_id"))
        return self._read("baselines").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").orderBy(F.desc("blessed_at"))

    def baseline(self, key: str) -> int | None:
        """The run that a key was blessed with last."""
        row = self.baselines().where(F.col("baseline_key") == key).first()
        return row["run_id"] if row else None

    def runs(self) -> DataFrame:
        return self._published("runs")

    def recent(self, limit: int = 20) -> DataFrame:
        return self.runs().orderBy(F.desc("run_id")).limit(limit)

    def documents(self, run_id: int) -> DataFrame:
        """Documents of a run with their counts and verdicts."""
        return self._published("documents", run_id)

    def children(self) -> DataFrame:
        """Documents of all runs beside their run's own counts and verdict."""
        runs = self.runs().select(F.col("run_id").alias("interchange_id"), F.col("result").alias("run_result"), F.col("fail").alias("run_fail"), "file_findings", "n_documents")
        return self._published("documents").join(runs, "interchange_id")

    def findings(self, run_id: int) -> DataFrame:
        return self._published("findings", run_id)

    def regress(self, old: int, new: int) -> DataFrame:
        """`diff` of two runs by their ids."""
        return diff(self.findings(old), self.findings(new))

    def regress_from_baseline(self, key: str, new: int) -> DataFrame:
        old = self.baseline(key)
        if old is None:
            raise KeyError(f"no baseline {key!r}")
        return self.regress(old, new)


def baseline_key(*parts):
    """Parts joined by '|', with '%' and '|' escaped."""
    escaped = [F.replace(F.replace(p, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")) for p in parts]
    return F.concat_ws("|", *escaped)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two runs' findings (doc, status, category, row_id,
    source_ref, target, expected, actual, and emit_ord if stored): doc, kind,
    row_id, place, nth, old_status, new_status, regression. Findings of one
    identity are told apart by their number in stored order, passes included. A
    new location counts if it is bad, and is a regression if it fails; a changed
    one is a regression if it fails now and did not. Findings without a document
    are compared like those of a document that both runs have."""
    # findings of groups and files have no doc: their key is empty, which both runs
    # always share
    keyed = lambda df: df.withColumn("dk", F.coalesce(F.col("doc").cast("string"), F.lit("")))

    def own(df: DataFrame, p: str) -> DataFrame:
        place = F.coalesce("target", "source_ref", F.lit(""))
        order = ["emit_ord"] if "emit_ord" in df.columns else [rank(), "category", "expected", "actual"]
        x = df.withColumn("row_id", F.coalesce("row_id", F.lit(""))).withColumn("place", place)
        x = x.withColumn("nth", F.row_number().over(Window.partitionBy("dk", "row_id", "place").orderBy(*order)))
        return x.select("dk", F.col("doc").alias(p + "doc"), "row_id", "place", "nth", F.col("status").alias(p + "status"), F.struct("status", "category", "expected", "actual").alias(p + "row"))

    old, new = keyed(old), keyed(new)
    docs_old, docs_new = (df.where("doc is not null").select("dk", "doc").distinct() for df in (old, new))
    gone = docs_old.join(docs_new, "dk", "left_anti").select("doc", F.lit("DOC REMOVED").alias("kind"))
    came = docs_new.join(docs_old, "dk", "left_anti").select("doc", F.lit("DOC ADDED").alias("kind"))
    shared = docs_old.join(docs_new.select("dk"), "dk", "left_semi").select("dk")
    both = lambda df: df.where("doc is null").unionByName(df.where("doc is not null").join(shared, "dk", "left_semi"))
    met = own(both(old), "old_").join(own(both(new), "new_"), ["dk", "row_id", "place", "nth"], "full_outer").withColumn("doc", F.coalesce("old_doc", "new_doc"))
    was, now = F.coalesce(F.col("old_status").isin(*BAD), F.lit(False)), F.coalesce(F.col("new_status").isin(*BAD), F.lit(False))
    kind = (
        F.when(F.col("old_row").isNull(), F.when(now, "NEW")).when(F.col("new_row").isNull(), F.when(was, "RESOLVED")).when(F.col("old_row") == F.col("new_row"), None)
        .when(was & (F.col("new_status") == "PASS"), "RESOLVED").otherwise("CHANGED")
    )
    changes = met.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("doc", "kind", "row_id", "place", "nth", "old_status", "new_status")
    none = F.lit(None).cast("string")
    whole = gone.unionByName(came).select("doc", "kind", none.alias("row_id"), none.alias("place"), F.lit(None).cast("int").alias("nth"), none.alias("old_status"), none.alias("new_status"))
    fails = (F.col("new_status") == "FAIL") & ~F.col("old_status").eqNullSafe("FAIL")
    worse = (F.col("kind") == "DOC REMOVED") | (F.col("kind").isin("NEW", "CHANGED") & fails)
    return changes.unionByName(whole).withColumn("regression", F.coalesce(worse, F.lit(False)))


def sorted_changes(changes: DataFrame) -> DataFrame:
    """Changes in the order they are shown."""
    place = F.array_position(F.array(*(F.lit(k) for k in DELTA_ORDER)), F.col("kind"))
    return changes.orderBy(place, "doc", "row_id", "place", "nth")


def spec_label(runs: DataFrame) -> DataFrame:
    """Adds label: the spec, and the partner if there is one; one spec under two
    partners is two checks."""
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    label = name("spec_file")
    return runs.withColumn("label", F.when(F.col("partner_file").isNotNull(), F.concat_ws(" + ", label, name("partner_file"))).otherwise(label) if "partner_file" in runs.columns else label)


def trends(runs: DataFrame, window: int = 200) -> DataFrame:
    """label, total, passed, pass_rate, latest and the series of results from old
    to new, of those of the `window` latest runs that belong to no interchange;
    the worst first, then those with most runs."""
    top = spec_label(runs.orderBy(F.desc("run_id")).limit(window)).where(F.col("interchange_id").isNull())
    out = top.groupBy("label").agg(
        F.count("*").alias("total"), F.count_if(F.col("result") == "PASS").alias("passed"), F.round(F.avg((F.col("result") == "PASS").cast("double")), 6).alias("pass_rate"),
        F.max_by("result", "run_id").alias("latest"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_id", "result"))), lambda x: F.substring(x["result"], 1, 1)), "").alias("series"),
    )
    return out.orderBy(F.when(F.col("latest") == "FAIL", 0).when(F.col("latest") == "WARNING", 1).when(F.col("latest") == "PASS", 2).otherwise(3), F.desc("total"), "label")


def top_causes(runs: DataFrame, findings: DataFrame, window: int = 200) -> DataFrame:
    """Categories of the bad findings of the `window` latest runs, counted."""
    latest = runs.orderBy(F.desc("run_id")).limit(window).select("run_id")
    return root_causes(findings.join(F.broadcast(latest), "run_id", "left_semi"))  # a window of runs
