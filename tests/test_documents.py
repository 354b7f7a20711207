from edigrain.sources import documents, x12
from edigrain.streaming import stream_files, write_control_issues
from tests.test_structure import ISA


def _lines(spark, rows):
    return spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file_id string, line_no int, value string")


def test_flat_merges_and_keeps_roles(spark):
    rows = ["# note", "", "H|a=1|b=2", "H|a=3", "A|role=ship|city=x", "D|q=1", "D|q=2", "S|n=2"]
    got = {(r.norm_path, r.line_ix): r.leaf_text for r in documents.flat_leaves(_lines(spark, rows)).collect()}
    assert got == {("header.a", None): "3", ("header.b", None): "2", ("ship.city", None): "x", ("lines[].q", 0): "1", ("lines[].q", 1): "2", ("summary.n", None): "2"}


def test_layout_routes(spark):
    layout = [
        documents.Record("P", "partner", "partners", (("role", 1), ("name", 2)), "role"),
        documents.Record("D", "line", "lines", (("q", 1),)),
        documents.Record("X", "line_child", "lines", (("kind", 1), ("v", 2)), "kind"),
    ]
    got = {(r.norm_path, r.line_ix): r.leaf_text for r in documents.layout_leaves(_lines(spark, ["X|a|0", "P|WE|me", "P|WE|you", "D|1", "X|a|7", "D|2", "short"]), layout, "|").collect()}
    assert got == {("lines[].a.v", -1): "0", ("partners.we.name", None): "me", ("lines[].q", 0): "1", ("lines[].a.v", 0): "7", ("lines[].q", 1): "2"}


def test_json_and_xml_guard(spark):
    files = spark.createDataFrame([("a", '{"x": 1}'), ("b", '[{"x": 1}, {"x": 2}]'), ("c", "no json"), ("d", "[]")], "file_id string, text string")
    got = documents.json_documents(files)
    assert sorted((r.file_id, r.doc_ix) for r in got.collect()) == [("a", 0), ("b", 0), ("b", 1), ("c", 0)]
    assert got.where("v is null").count() == 1
    xml = spark.createDataFrame([("<?xml?><!doctype a><a/>",), ("<a/>",)], "t string")
    assert [r[0] for r in xml.select(documents.guard_xml(xml.t)).collect()] == [True, False]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.edi").write_text(ISA + "GS*PO*A*B*20260101*1200*7*X*004010~ST*850*0001~BEG*00~SE*9*0001~GE*1*7~IEA*1*000000001~")
    query = write_control_issues(stream_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert [(r.issue, r.expected, r.actual) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("se_count", "3", "9")]
    assert x12.read_files(spark, str(tmp_path / "in")).count() == 1
