"""Segments, lines and what is shared are not shuffled again."""

from edigrain import queries as engine
from edigrain.operators import judge, pairing, scopes, structure
from edigrain.operators.store import share
from edigrain.plans.transactions import DEFINITIONS
from edigrain.sources import derived, x12

SF = "/root/testdata/sf0.001"


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _above(df, node: str) -> list[str]:
    """Lines of the physical plan before the first such node: what comes after it."""
    lines = _plan(df)
    return lines[: next(i for i, x in enumerate(lines) if node in x)]


def _large(spark, df):
    """df as planned for tables that no executor could be sent whole."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _plan(df)
        return df
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segments_are_placed_where_they_arise(spark):
    placed = _large(spark, structure.place(derived.transaction_segments(spark, SF), DEFINITIONS["850"]))
    above = _above(placed, "Generate")
    assert not [x for x in above if "Exchange" in x]
    assert len([x for x in above if "Sort " in x]) == 1
    scoped = _large(spark, scopes.scope_rows(placed, "PO1>PID[F]", DEFINITIONS["850"]))
    assert not [x for x in _above(scoped, "Generate") if "Exchange" in x]
    tree = _large(spark, structure.hierarchy(engine._shipment(spark, SF)))
    assert not [x for x in _above(tree, "Generate") if "Exchange" in x]


def test_files_are_numbered_where_they_arise(spark):
    numbered = _large(spark, x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, SF))))
    assert not [x for x in _above(numbered, "Generate") if "Exchange" in x]


def test_xml_of_dealt_files_is_not_shuffled(spark):
    leaves = _large(spark, engine.xml_fold(spark, SF))
    assert not [x for x in _above(leaves, "Generate posexplode") if "Exchange" in x or "Join" in x]


def test_lines_of_both_sides_meet_by_document(spark):
    own = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "doc long, line_ix int, x string")
    docs = spark.createDataFrame([(1, '{"lines": [{"q": 1}]}'), (2, '{"lines": [{"q": 2}, {"q": 3}]}'), (4, '{"lines": {"k": {"q": 4}}}'), (5, "{}")], "doc long, j string").selectExpr("doc", "parse_json(j) v")
    got = judge.paired_lines(own, docs, "lines").selectExpr("doc", "line_ix", "x", "try_variant_get(item, '$.q', 'int') q", "has_source").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "a", 1, True), (1, 1, "b", None, True), (2, 0, "c", 2, True), (2, 1, None, 3, None), (4, 0, None, 4, None)]


def test_shared_rows_stay_dealt_and_are_written_small(spark):
    rows = spark.range(2000).selectExpr("id % 100 doc", "id seq", "array('a', 'b') elements", "parse_json('{}') v")
    shared = share(rows.repartition(4, "doc"), "doc")
    assert not [x for x in _plan(shared.groupBy("doc").count()) if "Exchange" in x]
    assert shared.inputFiles() and all(x.endswith(".parquet") for x in shared.inputFiles())
    assert shared.count() == 2000 and shared.columns == rows.columns


def test_shared_rows_are_dealt_over_as_many_buckets_as_asked(spark):
    rows = spark.range(2000).selectExpr("id % 100 doc", "id seq")
    shared = share(rows.repartition(12, "doc"), "doc", parts=12)
    assert shared.groupBy("doc").count().rdd.getNumPartitions() == 12 and shared.count() == 2000


def test_large_tables_are_dealt_in_proportion(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(derived, "LARGE", 1)
    monkeypatch.setattr(derived, "LINES_A_PART", lines // 22)
    assert derived.parts(spark, SF) == 24  # of a session's four, for 22 and some
    monkeypatch.setattr(derived, "LARGE", lines + 1)
    assert derived.parts(spark, SF) is None


def test_keys_are_read_where_segments_are(spark):
    definitions = structure.definition_rows(spark, DEFINITIONS)
    segments = spark.createDataFrame([(1, "850", 0, "BEG", ["00", "SA", "P1"]), (2, "850", 0, "BEG", ["00", "SA", "P2"])], "doc long, set_code string, seq long, seg_id string, elements array<string>")
    placed = structure.place_by(share(segments.repartition(4, "doc"), "doc"), definitions)
    docs = spark.createDataFrame([(1, "850", "BEG03"), (2, "850", "BEG03")], "doc long, set_code string, ref string")
    keys = _large(spark, pairing.x12_keys(placed, docs, definitions))
    plan = _plan(keys)
    walk = next(i for i, x in enumerate(plan) if "Window" in x)
    own = plan[walk].index("Window")
    # nothing above the placement moves its rows: exchanges above it would be its ancestors
    assert not [x for x in plan[:walk] if "Exchange" in x and len(x) - len(x.lstrip(" :+-")) < own]
    assert sorted(map(tuple, keys.collect())) == [(1, "P1"), (2, "P2")]


def test_packed_transactions_keep_every_segment(spark):
    odd = "ISA*00*" + " " * 10 + "*00*" + " " * 10 + "*ZZ*S" + " " * 14 + "*ZZ*R" + " " * 14 + "*260101*1200*U*00401*000000001*0*P*>~GS*PO~ST*850*1~BEG*00**a\x01b~~REF*\x02**~DTM~SE*5*1~ST*850*2~BEG*01~SE*3*2~GE*2~IEA*1~"
    numbered = x12.number_envelopes(x12.tokenize(spark.createDataFrame([("f", odd)], "file_id string, text string")))
    want = x12.transactions(numbered).select("file_id", "st_ix", "set_code", "control", "seq", "seg_id", "elements").collect()
    got = x12.unpacked(x12.packed(numbered), "file_id", "st_ix", "set_code", "control").collect()
    key = lambda r: (r.st_ix, r.seq)
    assert len(want) == 8 and sorted(want, key=key) == sorted(got, key=key)


def test_large_tables_are_read_in_as_many_tasks_as_lines_need(spark, monkeypatch):
    """What a task reads it deals out from memory: files of any size are split by lines."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(derived, "LARGE", 1)
    monkeypatch.setattr(derived, "LINES_A_READ", lines // 22)
    key = "spark.sql.files.minPartitionNum"
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        derived.lines(spark, SF)
        assert int(spark.conf.get(key)) in (22, 23)
        assert spark.read.parquet(f"{SF}/lineitem.parquet").rdd.getNumPartitions() >= 22
        spark.conf.set(key, "99")
        derived.lines(spark, SF)
        assert spark.conf.get(key) == "99"  # a session may ask for more
        spark.conf.unset(key)
        monkeypatch.setattr(derived, "LARGE", lines + 1)
        derived.lines(spark, SF)
        assert spark.conf.get(key, None) is None
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_shipments_and_mixed_sets_move_no_customers(spark):
    for rows in (engine._shipment(spark, SF), engine._mixed(spark, SF)):
        assert not [x for x in _plan(rows) if "custkey" in x]


def test_segments_and_documents_share_their_shuffles(spark, monkeypatch):
    monkeypatch.setattr(derived, "LARGE", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(_large(spark, engine.queries()["rule_default"](spark, SF)))
        assert len([x for x in plan if "- Exchange hashpartitioning(doc" in x]) == 1
        assert len([x for x in plan if "ReusedExchange" in x]) == 2  # of lines, and of orders
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    kept = derived.output_documents(spark, SF).select("doc").collect()
    want = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 23 <> 0").select("o_orderkey").collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, want))


def test_envelopes_are_checked_where_files_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(derived, "LARGE", 1)
    try:
        numbered = x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, SF)))
        assert not [x for x in _above(_large(spark, x12.control_issues(numbered)), "Generate posexplode") if "Exchange" in x]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_large_tables_are_not_read_in_fewer_tasks(spark, monkeypatch):
    key = "spark.sql.files.minPartitionNum"
    had = spark.conf.get(key, None)
    monkeypatch.setattr(derived, "LARGE", 1)
    spark.conf.unset(key)
    try:
        derived.read_apart(spark, SF)
        assert int(spark.conf.get(key)) >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)


def test_segments_are_split_alike_by_any_separator(spark):
    isa = "ISA*00*" + " " * 10 + "*00*" + " " * 10 + "*ZZ*A" + " " * 14 + "*ZZ*B" + " " * 14 + "*260101*1200*U*00401*000000001*0*P*>"
    text = isa + "~\r\n \tBEG*00**x~\x0b REF*\f~~ST"
    files = spark.createDataFrame([("a", text), ("b", text.replace("*", "|")), ("c", text.replace("*", "^"))], "file_id string, text string")
    got = {}
    for r in x12.tokenize(files).where("seq > 0").orderBy("seq").collect():
        got.setdefault(r["file_id"], []).append((r["seq"], r["seg_id"], *r["elements"]))
    want = [(1, "BEG", "00", "", "x"), (2, "REF", ""), (4, "ST")]
    assert got == {"a": want, "b": want, "c": want}
