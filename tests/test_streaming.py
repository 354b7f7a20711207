"""Streams: pairs with late orphans, and a gate that is run again."""

import datetime as dt

from edigrain.operators.history import History
from edigrain.streaming import pair_streams, write_gate

KIND = "key string, doc long, at timestamp"
FINDING = "doc long, status string, category string, row_id string, source_ref string, target string, line_ix int, expected string, actual string"


def _at(minutes):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minutes)


def test_pairs_of_streams(spark, tmp_path):
    sides = {n: str(tmp_path / n) for n in ("sources", "targets")}
    put = lambda side, *rows: spark.createDataFrame([(k, d, _at(m)) for k, d, m in rows], KIND).coalesce(1).write.mode("append").parquet(sides[side])

    def run():
        s, t = (spark.readStream.schema(KIND).parquet(p) for p in sides.values())
        out = pair_streams(s, t, "10 minutes", "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        out.trigger(availableNow=True).start().awaitTermination()
        return {(r.key, r.source_doc, r.target_doc, r.issue) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put("sources", ("a", 1, 0), ("b", 2, 1), ("c", 3, 2), (None, 4, 3))
    put("targets", ("a", 10, 5), ("d", 11, 6))
    assert run() == {("a", 1, 10, None)}
    put("targets", ("b", 12, 20))  # a partner in time, in a later batch
    put("sources", ("x", 5, 21))
    assert run() == {("a", 1, 10, None), ("b", 2, 12, None)}
    put("sources", ("y", 6, 300))
    put("targets", ("y", 16, 301), ("x", 13, 302))  # x too late for its partner
    seen = run()
    assert {("y", 6, 16, None), ("c", 3, None, "missing_output"), (None, 4, None, "missing_output"), ("d", None, 11, "unexpected_output"), ("x", 5, None, "missing_output")} <= seen
    assert ("x", 5, 13, None) not in seen


def test_gate(spark, tmp_path):
    path, h = str(tmp_path / "in"), History(spark, str(tmp_path / "history"))

    def run(*rows):
        spark.createDataFrame([(d, s, None, "R-1", "BEG01", "a", None, "x", "y") for d, s in rows], FINDING).coalesce(1).write.mode("append").parquet(path)
        stream = write_gate(spark.readStream.schema(FINDING).parquet(path), h, "po", "po.csv", str(tmp_path / "gate"), str(tmp_path / "check"))
        stream.trigger(availableNow=True).start().awaitTermination()
        return {(r.batch, r.run_id, r.changes, r.regressions, r.passed) for r in spark.read.parquet(str(tmp_path / "gate")).collect()}

    assert run((1, "PASS"), (2, "FAIL")) == {(0, 1, 0, 0, True)}
    assert run((1, "FAIL"), (2, "FAIL")) == {(0, 1, 0, 0, True), (1, 2, 1, 1, False)}
    assert run((1, "PASS"), (2, "PASS")) == {(0, 1, 0, 0, True), (1, 2, 1, 1, False), (2, 3, 1, 0, True)}
    assert [(r.run_id, r.result) for r in h.runs().orderBy("run_id").collect()] == [(1, "FAIL"), (2, "FAIL"), (3, "PASS")]
    h.record(2, h.findings(1).drop("run_id", "emit_ord"), "po.csv", "000000000009")  # a batch that is run again
    assert h.regress_from_baseline("po", 2).count() == 0
