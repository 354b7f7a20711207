"""Rules and definitions as rows against the compiled ones."""

from pyspark.sql import functions as F

from edigrain.operators import judge, ruletable, structure
from edigrain.plans.spec import PURCHASE_ORDER
from edigrain.plans.transactions import DEFINITIONS
from edigrain.queries import _mixed, _rule_rows, rules_as_rows

SF = "/root/testdata/sf0.001"
TEXT = [
    "BEG*00*DS*PO1**20260105~REF*IA*77~DTM*002*20260105~SAC*A*C310***2500~N1*ST*Ann*92*7~N4*Oslo~N1*BT*Bo~PO1*1*5*EA*2.5**VP*77~PID*F****x~PO1*2*1*??*3**UP*1~CTT*2~AMT*TT*15.5",
    "BEG*09*SA***2026~PO1*1*x*CA*1**VP*8~CTT*1", "BEG*00*NE*PO3*R1*20260105~ZZZ*1",
]
DOCS = [
    '{"order": {"purpose": "ORIGINAL", "type": "DROP_SHIP", "drop_ship": "Y", "po_number": "PO1", "po_date": "2026-01-05", "record_type": "PO_INBOUND", "vendor": "77", "due_date": "2026-01-12", "release": "NONE", "allowance": "25.00"},'
    ' "ship_to": {"name": "Ann", "id": "7", "city": "Oslo"}, "lines": [{"line_no": 1, "qty": 5, "uom": "EACH", "price": 2.50, "part": "77", "text": "x"}, {"line_no": "2", "qty": 1.0, "uom": "?"}, {"qty": 9}], "summary": {"line_count": 2, "total": 15.5}}',
    '{"order": {"purpose": "x", "drop_ship": "NO", "po_number": "odd", "po_date": "x", "allowance": 5, "later": 1}, "lines": [{"qty": 2, "price": true}]}', '{"order": {"type": 5, "release": "R1"}}',
]


def _frames(spark):
    segs = [(i, k, s.split("*")[0], s.split("*")[1:]) for i, t in enumerate(TEXT) for k, s in enumerate(t.split("~"))]
    segments = spark.createDataFrame(segs, "doc long, seq long, seg_id string, elements array<string>")
    return segments, spark.createDataFrame(list(enumerate(DOCS)), "doc long, text string").select("doc", F.try_parse_json("text").alias("v"))


def test_findings_equal_the_compiled(spark):
    segments, docs = _frames(spark)
    placed, d = structure.place(segments, DEFINITIONS["850"]), DEFINITIONS["850"]
    shown = ["doc", "status", "category", "row_id", "source_ref", "target", "line_ix", "expected", "actual"]
    want = judge.header_findings(placed, docs, PURCHASE_ORDER, d).select(*shown).unionByName(judge.line_findings(placed, docs, PURCHASE_ORDER, d).select(*shown))
    definitions = structure.definition_rows(spark, DEFINITIONS)
    rules = _rule_rows(spark, PURCHASE_ORDER).withColumn("spec_id", F.lit("s")).withColumn("origin", F.lit("partner"))
    bad = rules.where("row_id = 'R-04'").select(*(F.lit({"row_id": "X-1", "source": "BEG3", "spec_id": "s"}.get(c)).cast("string").alias(c) if c in ("row_id", "source") else F.col(c) for c in rules.columns))
    codes = spark.createDataFrame([("s", k, a, b) for k, xs in PURCHASE_ORDER.code_lists.items() for a, b in xs.items()] + [("other", "UOM", "??", "?")], "spec_id string, list string, source string, target string")
    by_rows = structure.place_by(segments.withColumn("set_code", F.lit("850")), definitions)
    got = ruletable.rule_findings(by_rows, docs.withColumn("spec_id", F.lit("s")), rules.unionByName(bad), codes, definitions).collect()
    lost = [r for r in got if r.category == "spec"]
    assert [(r.doc, r.row_id, r.status) for r in lost] == [(None, "X-1", "FAIL")] and {r.origin for r in got} == {"partner"}
    key = lambda r: tuple(map(str, (r[c] for c in shown)))
    assert sorted(key(r) for r in got if r.category != "spec") == sorted(key(r) for r in want.collect())


def test_sets_are_placed_by_their_own_rows(spark):
    segments = _mixed(spark, SF)
    definitions = structure.definition_rows(spark, DEFINITIONS)
    got = structure.place_by(segments, definitions)
    one = {s: structure.place(segments.where(F.col("set_code") == s).drop("set_code"), DEFINITIONS[s]).withColumn("set_code", F.lit(s)) for s in ("850", "855", "856")}
    want = one["850"].unionByName(one["855"]).unionByName(one["856"])
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0
    assert structure.place_by(segments.withColumn("set_code", F.lit("000")), definitions).count() == 0


def test_definition_errors(spark):
    definitions = structure.definition_rows(spark, DEFINITIONS)
    assert structure.definition_errors(definitions).count() == 0
    odd = [("900", "opener", 1, None, None, None, None, None, None), ("900", "heading", 0, None, None, "A", None, None, None), ("900", "member", 0, "L", None, "B", None, None, None), ("900", "area", None, None, None, "C", None, None, None), ("850", "line", 0, "PO1", None, "PO1", None, None, None)]
    got = {(r.set_code, r.error, r.seg_id) for r in structure.definition_errors(definitions.unionByName(spark.createDataFrame(odd, structure.DEFINITION_ROW))).collect()}
    assert got == {("900", "no_segment", None), ("900", "unknown_role", "A"), ("900", "loop_never_opens", "B"), ("900", "no_area", "C"), ("900", "no_line_loop", None), ("850", "two_line_loops", None)}


def test_verdicts_are_worked_out_once(spark):
    plan = rules_as_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "count_mismatch" in x]
