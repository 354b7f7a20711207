"""What no query's tables reach: nothing of a document is left out."""

import json

from pyspark.sql import functions as F

from edigrain.operators import checks, scopes
from edigrain.plans.spec import PURCHASE_ORDER
from edigrain.sources import documents


def _variants(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "doc long, json string").select("doc", F.try_parse_json("json").alias("v"))


def test_leaves_of_every_depth(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 7}}}}}}, "order": {"x": 1}, "none": {}, "lines": [{"p": [{"q": {"r": "{[\"[{"}}]}, {"p": []}]}
    got = {(r.doc, r.norm_path, r.concrete_path, r.line_ix, r.leaf_text) for r in scopes.leaves(_variants(spark, deep, {"s": None}, "no json", "[]", "3")).collect()}
    assert got == {(0, "a.b.c.d.e.f.g", "a.b.c.d.e.f.g", None, "7"), (0, "order.x", "order.x", None, "1"), (0, "lines[].p[].q.r", "lines[0].p[0].q.r", 0, '{["[{'), (1, "s", "s", None, None)}
    assert {r.norm_path for r in checks.unmapped_target(_variants(spark, deep), PURCHASE_ORDER).collect()} >= {"a.b.c.d.e.f.g", "lines[].p[].q.r"}
    assert scopes.leaves(_variants(spark, "3")).collect() == []


def test_leaves_of_forty_levels(spark):
    doc = 1
    for _ in range(40):
        doc = {"k": doc}
    assert [r.norm_path for r in scopes.leaves(_variants(spark, doc)).collect()] == [".".join(["k"] * 40)]


def test_flat_keeps_wide_records_and_long_values(spark):
    wide = "H" + "".join(f"|f{i}={i}" for i in range(1, 1002))
    long = "S|t=" + "x" * 100_001
    rows = spark.createDataFrame([("f", i, r) for i, r in enumerate([wide, long, "H"])], "file_id string, line_no int, value string")
    got = {r.norm_path: r.leaf_text for r in documents.flat_leaves(rows).collect()}
    assert len(got) == 1002 and got["header.f1001"] == "1001" and len(got["summary.t"]) == 100_001
