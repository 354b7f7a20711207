"""Cases beyond former limits, and verdicts of odd input."""

import json

import pytest
from pyspark.sql import functions as F

from edigrain.functions import values
from edigrain.operators import checks, history, judge, outbound, scopes, structure
from edigrain.plans import spec as specs
from edigrain.plans import tables
from edigrain.plans.transactions import DEFINITIONS
from edigrain.sources import documents, x12

FINDING = "doc string, status string, category string, row_id string, source_ref string, target string, line_ix int, expected string, actual string"


def _placed(spark, code, rows):
    segs = spark.createDataFrame([(1, i, s, list(e)) for i, (s, *e) in enumerate(rows)], "doc long, seq long, seg_id string, elements array<string>")
    return structure.place(segs, DEFINITIONS[code])


def test_ancestors_at_every_depth(spark):
    rows = [("BSN", "00")] + [("HL", str(i), str(i - 1) if i > 1 else "", "I") for i in range(1, 9)]
    tree = structure.hierarchy(_placed(spark, "856", rows))
    assert sorted(r.distance for r in structure.ancestors(tree).where("seq = 8").collect()) == list(range(1, 8))
    assert structure.ancestors(tree.where("1 = 0")).count() == 0


ASN = [
    ("BSN", "00"), ("HL", "1", "", "S"), ("TD1", "CTN25", "9"), ("HL", "2", "1", "O"), ("PRF", "PO-A"), ("N1", "ST", "x"), ("REF", "IN", "party"), ("HL", "3", "2", "I"), ("SN1", "", "4"),
    ("HL", "4", "1", "O"), ("PRF", "PO-B"), ("HL", "5", "4", "I"), ("SN1", "", "6"), ("REF", "LT", "own"), ("CTT", "5", "10"),
]


def test_a_line_reads_its_ancestors(spark):
    placed = _placed(spark, "856", ASN)
    got = judge.line_cells(placed, DEFINITIONS["856"], ["SN102", "PRF01", "TD102", "REF02"]).orderBy("line_ix").collect()
    assert [tuple(r)[2:] for r in got] == [("4", "PO-A", "9", None), ("6", "PO-B", "9", "own")]  # a party's segments are its own
    found = checks.reconcile(placed, DEFINITIONS["856"]).collect()  # HL of all levels, parties apart; sums take items alone
    assert [r.rule for r in found] == ["td1-carton-count"]  # nine cartons and no level of packs


def test_loop_count_keeps_its_qualifier(spark):
    spec = specs.Spec("856", (specs.Rule("C", None, "HL[I]", "n", "LOOP_COUNT", data_type="integer"), specs.Rule("D", None, "HL", "all", "LOOP_COUNT", data_type="integer"), specs.Rule("E", "PRF01", "HL[I]", "po", "DIRECT")))
    docs = spark.createDataFrame([(1, '{"n": 2, "all": 5, "po": "PO-A"}')], "doc long, json string").select("doc", F.parse_json("json").alias("v"))
    assert {r.row_id: r.status for r in judge.header_findings(_placed(spark, "856", ASN), docs, spec, DEFINITIONS["856"]).collect()} == {"C": "PASS", "D": "PASS", "E": "PASS"}


@pytest.mark.parametrize("quantity", ["2000000000000", "9" * 60, "x"])
def test_large_quantities_end_no_run(spark, quantity):
    rows = [("BIG", "20260101"), ("IT1", "1", quantity, "EA", "2.50"), ("TDS", "100"), ("CTT", "1")]
    found = checks.reconcile(_placed(spark, "810", rows), DEFINITIONS["810"]).collect()
    assert [r.rule for r in found] in ([], ["tds-invoice-total"]) and (quantity != "2000000000000" or found)


def test_numbers_of_any_length(spark):
    big = "1" + "0" * 60
    cases = [("integer", "", big, f'"{big}"', "PASS"), ("integer", "", "0" * 30 + "7", "7", "PASS"), ("decimal", "", f"{big}.10", f'"{big}.1"', "PASS"), ("decimal", "", f"{big}.1", f'"{big}.2"', "FAIL"), ("decimal", "implied:2", "9" * 40, f'"{"9" * 38}.99"', "PASS"), ("decimal", "tol:0.01", "1.00", '"1.009"', "PASS"), ("decimal", "", "+5.", '"05.00"', "PASS")]
    for kind, fmt, source, target, want in cases:
        spec = specs.Spec("850", (specs.Rule("N", "BEG03", "", "n", "DIRECT", data_type=kind, fmt=fmt),))
        docs = spark.createDataFrame([(1, f'{{"n": {target}}}')], "doc long, json string").select("doc", F.parse_json("json").alias("v"))
        got = judge.header_findings(_placed(spark, "850", [("BEG", "00", "SA", source)]), docs, spec, DEFINITIONS["850"]).collect()
        assert [r.status for r in got] == [want], (kind, fmt, source)


def test_records_and_values_of_any_length(spark):
    wide = "H|" + "|".join(f"f{i}={i}" for i in range(1001)) + "|long=" + "y" * 100_001
    got = {r.norm_path: r.leaf_text for r in documents.flat_leaves(spark.createDataFrame([("f", 1, wide)], "file_id string, line_no int, value string")).collect()}
    assert len(got) == 1002 and got["header.f1000"] == "1000" and len(got["header.long"]) == 100_001


def test_leaves_at_seven_levels(spark):
    doc = json.dumps({"a": [{"b": {"c": [{"d": {"e": 1}}]}}], "z": []})
    got = scopes.leaves(spark.createDataFrame([(1, doc)], "doc long, json string").select("doc", F.parse_json("json").alias("v"))).collect()
    assert [(r.norm_path, r.concrete_path, r.leaf_text) for r in got] == [("a[].b.c[].d.e", "a[0].b.c[0].d.e", "1")]


def _run(spark, *rows):
    return spark.createDataFrame([(d, s, None, r, "BEG01", t, None, e, a) for d, s, r, t, e, a in rows], FINDING)


def test_regressions(spark):
    old = _run(spark, ("d", "PASS", "1", "a", "x", "x"), ("d", "FAIL", "2", "b", "x", "y"), ("d", "FAIL", "3", "c", "x", "y"), ("d", "PASS", "4", "d", "x", "x"), ("d", "WARNING", "5", "e", "x", "y"), ("gone", "PASS", "1", "a", "x", "x"))
    new = _run(spark, ("d", "FAIL", "1", "a", "x", "z"), ("d", "PASS", "2", "b", "x", "x"), ("d", "FAIL", "3", "c", "x", "w"), ("d", "WARNING", "6", "f", "x", "y"), ("d", "FAIL", "7", "g", "x", "y"), ("d", "PASS", "8", "h", "x", "x"), ("new", "PASS", "1", "a", "x", "x"))
    got = [(r.kind, r.doc, r.row_id, r.regression) for r in history.sorted_changes(history.diff(old, new)).collect()]
    assert got == [
        ("DOC REMOVED", "gone", None, True), ("NEW", "d", "6", False), ("NEW", "d", "7", True), ("CHANGED", "d", "1", True), ("CHANGED", "d", "3", False), ("DOC ADDED", "new", None, False), ("RESOLVED", "d", "2", False), ("RESOLVED", "d", "5", False),
    ]


def test_trends_take_a_window_and_part_partners(spark):
    runs = spark.createDataFrame([(i, f"/x/s{i % 2}", "/p/a.csv" if i % 4 == 0 else None, None, "FAIL" if i == 7 else "PASS") for i in range(10)], "run_id long, spec_file string, partner_file string, interchange_id long, result string")
    got = [(r.label, r.total, r.latest, r.series) for r in history.trends(runs, 6).collect()]
    assert got == [("s1", 3, "PASS", "PFP"), ("s0 + a.csv", 2, "PASS", "PP"), ("s0", 1, "PASS", "P")]


def test_conditions_in_any_case_over_fields():
    assert specs.parse_condition("exists(PID05) and PID01 in ('F', 'X')")[1].values == ("F", "X")
    with pytest.raises(specs.SpecError):
        specs.Rule("R", "BEG03", "", "a", "CONDITIONAL", "FOO = 'x'", "SOURCE", "SKIP")
    with pytest.raises(specs.SpecError):
        specs.parse_format("tol:nan")


def test_outbound_verdicts(spark):
    spec = specs.Spec("850", (
        specs.Rule("D", "po", "", "BEG03", "DIRECT"), specs.Rule("B", "po", "", "BEG04", "CONDITIONAL", "EXISTS(po)", "BLANK", "SKIP"), specs.Rule("I", "amount", "", "BEG06", "DIRECT", data_type="decimal", fmt="implied:2"),
        specs.Rule("X", "day", "", "BEG05", "DIRECT", data_type="date"), specs.Rule("F", None, "", "BEG02", "CONSTANT", default="NE"), specs.Rule("N", "none", "", "BEG07", "DIRECT"), specs.Rule("E", "none", "", "BEG01", "DIRECT"), specs.Rule("T", None, "", "BEG08", "TODO"),
    ))
    docs = spark.createDataFrame([(1, '{"po": "A", "amount": 12.5, "day": "2026-01-02", "none": ""}')], "doc long, json string").select("doc", F.parse_json("json").alias("v"))
    got = {r.row_id: (r.status, r.category) for r in outbound.header_findings(_placed(spark, "850", [("BEG", "00", "SA", "A", "", "20260102", "12.50")]), docs, spec, DEFINITIONS["850"]).collect()}
    assert got == {"D": ("PASS", None), "B": ("NOT TESTED", None), "I": ("FAIL", "format"), "X": ("PASS", None), "F": ("FAIL", "constant_default"), "N": ("NOT TESTED", None), "E": ("FAIL", "unexpected_output"), "T": ("NOT TESTED", None)}


def test_spec_rows_with_all_their_errors(spark, tmp_path):
    (tmp_path / "units.csv").write_text("code,name\nEA,EACH\nEA,PIECE\n,x\n")
    codes = tables.code_rows(spark, str(tmp_path / "units.csv"))
    rows = spark.createDataFrame([(None, "BEG03", "", "a", "DIRECT") + (None,) * 7, ("R", None, "", "a", "CONDITIONAL") + (None,) * 7, ("C", None, "", "a", "CONSTANT") + (None,) * 7], ", ".join(f"`{c}` string" for c in tables.COLUMNS))
    got = sorted((r.row_id or "", r.error) for r in tables.rule_errors(rows, codes).collect())
    assert got == sorted([("", "no_row_id"), ("R", "no_condition"), ("C", "no_default"), ("units:EA", "duplicate_code"), ("units", "empty_code")])
    assert [r.row_id for r in tables.delta_errors(rows, rows.limit(0).union(spark.createDataFrame([("Z", None, "", "", "REMOVE") + (None,) * 7], rows.schema))).collect()] == ["Z"]
    with pytest.raises(specs.SpecError):
        tables.compile_spec("850", rows, codes, most=2)


def test_first_transaction_and_split(spark):
    isa = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *260101*1200*U*00401*000000001*0*P*>~"
    text = isa + "GS*PO*A*B*20260101*1200*7*X*004010~ST*850*0001~BEG*00~SE*3*0001~SE*1*1~ST*999*0002~SE*2*0002~GE*2*7~IEA*1*1~"
    numbered = x12.number_envelopes(x12.tokenize(spark.createDataFrame([("f", text)], "file_id string, text string")))
    assert [tuple(r) for r in x12.first_transaction(numbered).collect()] == [("f", "850", 1, 3)]
    assert sorted((r.issue, r.control) for r in x12.split_issues(numbered, ["850"]).collect()) == [("orphan_se", "1"), ("unknown_set", "0002")]
    assert values.MOST_DIGITS == 4000


def test_xml_records(spark):
    text = "<?xml version='1.0'?><A><!-- <X> --><B SEGMENT='1'><C>1 &lt; 2</C><D/><E><F>x</F></E><C>later</C></B><B><C/></B></A>"
    got = documents.xml_records(spark.createDataFrame([("f", text), ("g", "<!DOCTYPE a>" + text), ("n", None)], "file_id string, text string")).orderBy("line_no").collect()
    assert [(r.record, r.fields) for r in got] == [("A", None), ("B", {"C": "1 < 2", "D": ""}), ("E", {"F": "x"}), ("B", {"C": ""})]
