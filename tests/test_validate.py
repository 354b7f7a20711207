"""Runs hold the checks of envelopes, structure and pairing too."""

from dataclasses import replace

from pyspark.sql import functions as F

from edigrain import queries as engine
from edigrain.operators import structure, validate
from edigrain.plans.transactions import DEFINITIONS
from tests.test_rollup import SF, _sql


def test_envelopes_and_pairing_are_findings(spark):
    rows = engine._findings(spark, SF).where("category in ('control', 'unexpected_output') or source_ref = '(pairing)'")
    got = rows.select(F.coalesce(F.col("doc").cast("string"), F.lit("-")), F.split_part("source_ref", F.lit(" "), F.lit(-1)), "status", "category").collect()
    want = _sql("""SELECT o_orderkey::VARCHAR, 'se_count', 'FAIL', 'control' FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT o_orderkey::VARCHAR, '(pairing)', 'FAIL', 'missing_output' FROM orders WHERE o_orderkey % 23 = 0
UNION ALL SELECT DISTINCT '-', 'F' || (o_orderkey // 20), 'FAIL', 'control' FROM orders WHERE (o_orderkey // 20) % 7 = 0 AND (o_orderkey // 20) % 5 <> 0
UNION ALL SELECT DISTINCT '-', 'F' || (o_orderkey // 20), 'FAIL', 'control' FROM orders WHERE (o_orderkey // 20) % 5 = 0 AND (o_orderkey // 20) % 7 <> 0
UNION ALL SELECT '-', f, 'FAIL', 'control' FROM (SELECT DISTINCT 'F' || (o_orderkey // 20) AS f FROM orders WHERE (o_orderkey // 20) % 35 = 0), range(2)""")
    assert sorted(tuple(r) for r in got) == sorted(want)


def _structure(spark, definition, rows):
    segs = spark.createDataFrame([(1, i, s, list(e)) for i, (s, *e) in enumerate(rows)], "doc long, seq long, seg_id string, elements array<string>")
    found = validate.structure_findings(structure.place(segs, definition), definition).select("status", "category", "source_ref", "actual").collect()
    return sorted((r.status, r.category, r.source_ref, r.actual or "") for r in found)


def test_structure_is_a_finding(spark):
    asn = [("BSN", "00", "1"), ("HL", "1", "", "S"), ("HL", "2", "9", "O"), ("ZZZ", "1")]
    got = _structure(spark, DEFINITIONS["856"], asn)
    assert ("FAIL", "source_data", "(hierarchy)", "2") in got and ("WARNING", "source_data", "(structure)", "ZZZ") in got
    strict = replace(DEFINITIONS["850"], extra={"required_segments": [("DTM", "002"), ("BEG", None)], "required_pairs": [("PO1", 6, 10, 2, "UP")]})
    order = [("BEG", "00", "SA", "P"), *[("N1", "ST")] * 201, ("PO1", "1", "1", "EA", "1", "", "VP", "7")]
    assert _structure(spark, strict, order) == [("FAIL", "source_data", "DTM*002", ""), ("FAIL", "source_data", "PO1", ""), ("WARNING", "source_data", "(structure)", "N1")]


def test_documents_without_a_key_are_reported(spark):
    got = {r.issue: r.n for r in engine.pairing_orphans(spark, SF).collect()}
    assert got["no_key_source"] == _sql("SELECT count(*) FROM orders WHERE o_orderkey % 19 = 0")[0][0]
    assert got["no_key_target"] == _sql("SELECT count(*) FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey % 23 <> 0")[0][0]
