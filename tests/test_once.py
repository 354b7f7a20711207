"""What a row holds is worked out once."""

import re

from pyspark.sql import functions as F

from edigrain import queries as engine
from edigrain.functions import values
from edigrain.operators import judge, outbound, structure
from edigrain.plans.spec import PURCHASE_ORDER_OUT, Format
from edigrain.plans.transactions import DEFINITIONS
from edigrain.sources import derived, x12

SF = "/root/testdata/sf0.001"
D850 = DEFINITIONS["850"]


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_segments_are_made_once(spark):
    """Spark filters what it explodes by its size, and would make it once for that."""
    for rows in (derived.transaction_segments(spark, SF), engine._shipment(spark, SF), engine._mixed(spark, SF), x12.tokenize(derived.interchange_text(spark, SF))):
        assert not [x for x in _plan(rows) if "Filter" in x and "size(" in x]


def test_each_path_is_read_once(spark):
    docs = engine._docs(spark, SF)
    placed = structure.place(derived.transaction_segments(spark, SF), D850)
    for make, paths in ((outbound.line_findings, ("qty", "uom", "price")), (outbound.header_findings, ("order.type", "order.po_number"))):
        plan = "\n".join(_plan(make(placed, docs, PURCHASE_ORDER_OUT, D850)))
        for path in paths:
            assert len(re.findall(re.escape(f"$.{path},"), plan)) == 1, path


def test_elements_of_the_line_segment_need_no_grouping(spark):
    placed = structure.place(derived.transaction_segments(spark, SF), D850)
    rows = judge.line_reads(placed, D850, ["PO102", "PO104"])
    plan = _plan(rows)
    assert not [x for x in plan[: next(i for i, x in enumerate(plan) if "Window" in x)] if "Aggregate" in x]
    assert rows.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_line_reads_equal_grouped_reads(spark):
    """Lines with a segment of their own id in a child, before a line, and without elements."""
    rows = [(1, 0, "BEG", ["00"]), (1, 1, "PO1", ["1", "5"]), (1, 2, "PID", ["F"]), (1, 3, "PO1", []), (1, 4, "PO1", ["3", ""]), (1, 5, "CTT", ["3"]), (2, 0, "BEG", ["00"]), (2, 1, "CTT", ["0"])]
    placed = structure.place(spark.createDataFrame(rows, "doc long, seq long, seg_id string, elements array<string>"), D850)
    assert sorted(map(tuple, judge.line_cells(placed, D850, ["PO101", "PO102"]).collect())) == [(1, 0, "1", "5"), (1, 1, None, None), (1, 2, "3", None)]
    assert sorted(map(tuple, judge.line_cells(placed, D850, ["PO101", "PID01"]).collect()))[0] == (1, 0, "1", "F")


def test_plain_numbers_read_as_before(spark):
    odd = {"0": "0", "-0": "-0", "007": "7", "+5": "5", "-01": "-1", "10": "10", "1.": None, "": None, "a": None, "1a": None}
    exact = {"0.50": "0.50", "-0.5": "-0.5", ".5": "0.5", "-.5": "-0.5", "+01.50": "1.50", "5.": "5", "00": "0", "1.2.3": None, "1e2": "100", "12": "12", "-0": "-0"}
    got = spark.createDataFrame([(k,) for k in odd], "c string").select("c", values.integer(F.col("c"))).collect()
    assert dict(map(tuple, got)) == odd
    got = spark.createDataFrame([(k,) for k in exact], "c string").select("c", values.decimal(F.col("c"))).collect()
    assert dict(map(tuple, got)) == exact
    pairs = [("1.50", "1.5", True), ("1", "1", True), ("-0", "0", True), ("1", "2", False), (None, "1", None), ("1", None, None)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", values.same(F.col("a"), F.col("b"), "decimal", Format()).alias("got"))
    assert all(r.want == r.got for r in rows.collect())


def test_orders_meet_many_customers_in_as_many_parts_as_lines(spark, monkeypatch):
    want = {tuple(r) for r in derived.orders(spark, SF).select("o_orderkey", "c_name", F.size("lines")).collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for name, value in (("LARGE", 1), ("LINES_A_PART", lines // 22), ("MANY_CUSTOMERS", 1)):
        monkeypatch.setattr(derived, name, value)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = derived.orders(spark, SF).select("o_orderkey", "c_name", F.size("lines"))
        moved = [x for x in _plan(own) if "hashpartitioning(o_custkey" in x or "hashpartitioning(c_custkey" in x]
        assert len(moved) == 2 and all(", 24)" in x for x in moved)
        assert {tuple(r) for r in own.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
