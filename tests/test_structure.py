import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from edigrain.operators import history, scrub, structure
from edigrain.plans.transactions import DEFINITIONS
from edigrain.sources import x12

ISA = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *260101*1200*U*00401*000000001*0*P*>~"


def _segments(spark, rows):
    return spark.createDataFrame([(1, i, s, list(e)) for i, (s, *e) in enumerate(rows)], "doc long, seq long, seg_id string, elements array<string>")


def test_placement_pops_and_clears(spark):
    rows = [("BEG", "00"), ("N1", "ST"), ("N4", "x"), ("REF", "a"), ("DTM", "002"), ("REF", "b"), ("PO1", "1"), ("REF", "c"), ("ZZZ",), ("CTT", "1"), ("AMT", "TT")]
    out = structure.place(_segments(spark, rows), DEFINITIONS["850"]).orderBy("seq").collect()
    assert [(r.area_ix, r.loop_id) for r in out] == [(0, None), (0, "N1"), (0, "N1"), (0, "N1"), (0, None), (0, None), (1, "PO1"), (1, "PO1"), (1, "PO1"), (2, None), (2, None)]
    assert [r.seg_id for r in out if not r.known] == ["ZZZ"]


def test_hierarchy_errors(spark):
    rows = [("HL", "1", "", "S"), ("HL", "2", "1", "O"), ("HL", "2", "1", "O"), ("HL", "", "2", "I"), ("HL", "5", "9", "I"), ("HL", "6", "1", "I"), ("HL", "7", "2", "Q"), ("HL", "8", "2", "")]
    placed = structure.place(_segments(spark, rows), DEFINITIONS["856"])
    errors = structure.hierarchy_errors(structure.hierarchy(placed), DEFINITIONS["856"])
    assert [r.error for r in errors.orderBy("seq").collect()] == ["duplicate_id", "missing_id", "orphan", "nesting", "unknown_level", "missing_level"]


def test_tokenizer_and_envelope(spark):
    text = ISA + "GS*PO*A*B*20260101*1200*7*X*004010~\nST*850*0001~BEG*00*SA~SE*3*1~GE*2*7~IEA*1*1~tail"
    files = spark.createDataFrame([("f", "﻿" + text), ("bad", "no interchange"), ("none", None)], "file_id string, text string")
    segs = x12.tokenize(files)
    assert [r.seg_id for r in segs.orderBy("seq").collect()] == ["ISA", "GS", "ST", "BEG", "SE", "GE", "IEA", "tail"]
    issues = {(r.issue, r.expected, r.actual) for r in x12.control_issues(x12.number_envelopes(segs)).collect()}
    assert issues == {("ge_count", "1", "2")}  # 0001 and 1, 000000001 and 1 are one number
    assert [tuple(r) for r in x12.raw_tail(files).collect()] == [("f", "tail")]


def _pseudonym(value, salt):
    out, block, at = [], hashlib.sha256(f"{salt}\0{value}".encode()).digest(), 0
    for ch in value:
        if not ch.isalnum():
            out.append(ch)
            continue
        if at == 32:
            block, at = hashlib.sha256(block).digest(), 0
        out.append(str(block[at] % 10) if ch.isdigit() else chr(65 + block[at] % 26))
        at += 1
    return "".join(out)


def test_pseudonym_keeps_shape_and_repeats(spark):
    values = ["Ab-12", "", "--", "x" * 100, "é9 " * 40, "a" * 32, "b" * 33]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    got = {r.v: r.p for r in df.select("v", scrub.pseudonymize(F.col("v"), "s").alias("p")).collect()}
    assert got == {v: _pseudonym(v, "s") for v in values} | {None: None}


def test_history(spark, tmp_path):
    h = history.History(spark, str(tmp_path))
    cols = "doc long, status string, category string, row_id string, source_ref string, target string, line_ix int, expected string, actual string"
    run = lambda s: spark.createDataFrame([(1, s, None, "R-1", "BEG01", "a", None, "x", "y"), (2, "PASS", None, "R-1", "BEG01", "a", None, "x", "x")], cols)
    h.record(1, run("PASS"), "s", "2026-01-01")
    h.record(2, run("FAIL"), "s", "2026-01-02")
    h.bless("k", 1, "first", "2026-01-01")
    h.bless("k", 2, "second", "2026-01-02")
    assert [(r.run_id, r.result) for r in h.recent().collect()] == [(2, "FAIL"), (1, "PASS")]
    assert [r.label for r in h.baselines().collect()] == ["second"]
    delta = history.diff(h.findings(1), h.findings(2)).collect()
    assert [(r.doc, r.kind, r.regression) for r in delta] == [(1, "CHANGED", True)]


def test_history_publishes_whole_runs_only(spark, tmp_path):
    h = history.History(spark, str(tmp_path))
    cols = "doc long, status string, category string, row_id string, source_ref string, target string, line_ix int, expected string, actual string"
    run = lambda s: spark.createDataFrame([(1, s, None, "R-1", "BEG01", "a", None, "x", "y"), (None, "FAIL", "control", None, "(envelope)", None, None, "x", "y")], cols)
    h.record(1, run("PASS"), "s", "2026-01-01")
    lost = h.write_attempt(2, run("WARNING"), "s", "2026-01-02")  # fails before it is published
    assert [r.run_id for r in h.runs().collect()] == [1] and h.findings(2).count() == 0
    h.record(2, run("FAIL"), "s", "2026-01-03", partner_file="p.csv")
    h.record(2, run("WARNING"), "s", "2026-01-04", partner_file="p.csv")  # again: the later one counts
    assert [r.status for r in h.findings(2).where("doc = 1").collect()] == ["WARNING"]
    row = {r.run_id: r for r in h.runs().collect()}[2]
    assert (row.result, row.fail, row.warning, row.file_findings, row.n_documents, row.partner_file) == ("FAIL", 1, 1, 1, 1, "p.csv")
    assert [(r.doc, r.kind, r.regression) for r in h.regress(1, 2).collect()] == [(1, "CHANGED", False)]
    h.bless("k", 1, "x", "2026")
    assert h.regress(1, 1).count() == 0 and h.baseline("none") is None
    assert h.regress_from_baseline("k", 2).count() == 1
    with pytest.raises(KeyError):
        h.regress_from_baseline("none", 2)
    torn = h.write_attempt(3, run("PASS"), "s", "2026-01-05")
    shutil.rmtree(tmp_path / "findings" / f"attempt={torn}")
    run("PASS").where("doc = 1").withColumn("run_id", F.lit(3)).write.parquet(str(tmp_path / "findings" / f"attempt={torn}"))
    with pytest.raises(RuntimeError, match="1 findings of 2"):
        h.publish(3, torn, "2026-01-05")
    assert [r.run_id for r in h.runs().orderBy("run_id").collect()] == [1, 2]
    assert h.sweep() == 9 and lost not in {p.name for p in (tmp_path / "runs").iterdir()}  # three attempts of three tables
    assert h.findings(2).count() == 2 and {(r.doc, r.result, r.run_result) for r in h.children().where("interchange_id = 2").collect()} == {(1, "WARNING", "FAIL")}
    h.record(4, run("PASS").limit(0), "s", "2026-01-06")
    assert [(r.result, r.n_documents) for r in h.runs().where("run_id = 4").collect()] == [("PASS", 0)] and h.findings(4).count() == 0
