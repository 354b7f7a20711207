"""Queries of the engine's operators over derived interchanges, with the SQL
that recomputes each answer from the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import partner_queries
from .functions import values
from .operators import checks, history, outbound, pairing, partners, ruletable, scopes, scrub, structure, validate
from .operators.judge import header_findings, line_cells, line_findings
from .operators.store import share, shared_path
from .plans import tables
from .plans.spec import PURCHASE_ORDER, PURCHASE_ORDER_OUT, Format
from .plans.transactions import DEFINITIONS, Presence
from .sources import derived, documents, x12

D850 = DEFINITIONS["850"]


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.place(derived.transaction_segments(spark, sf_dir), D850)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.output_documents(spark, sf_dir).select("doc", F.try_parse_json("json").alias("v"))


def _segments(rows: list[tuple[Column, list]]) -> Column:
    return F.array(*(F.struct(F.lit(s).alias("seg_id"), F.array(*(F.coalesce((e if isinstance(e, Column) else F.lit(e)).cast("string"), F.lit("")) for e in es)).alias("elements")) for s, es in rows))


def _explode(df: DataFrame, body: Column) -> DataFrame:
    # bodies have a head: as outer rows they aren't made once more to be counted
    return df.select(F.col("o_orderkey").alias("doc"), F.posexplode_outer(body).alias("seq", "s")).select("doc", F.col("seq").cast("long").alias("seq"), "s.seg_id", "s.elements")


# --- sources and envelope


def tokenize_segment_counts(spark, sf_dir):
    segs = x12.tokenize(derived.interchange_text(spark, sf_dir))
    return segs.groupBy("seg_id").agg(F.count("*").alias("n"), F.sum(F.size("elements")).alias("n_elements"))


def envelope_se_count(spark, sf_dir):
    rows = x12.control_issues(x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir))))
    return rows.where("issue = 'se_count'").select("file_id", "expected", "actual")


def envelope_se_control(spark, sf_dir):
    rows = x12.control_issues(x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir))))
    return rows.groupBy("issue").agg(F.count("*").alias("n"))


def envelope_ge_count(spark, sf_dir):
    rows = x12.control_issues(x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir))))
    return rows.where("issue = 'ge_count'").select("file_id", "expected", "actual")


def truncated_interchange(spark, sf_dir):
    rows = x12.control_issues(x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir))))
    return rows.where("issue = 'iea_missing'").select("file_id")


def raw_tail(spark, sf_dir):
    """Text after the last terminator, planted in every third file."""
    n = F.substring("file_id", 2, 20).cast("long")
    files = derived.interchange_text(spark, sf_dir).withColumn("text", F.when(n % 3 == 0, F.concat("text", F.lit("\nLEFT OVER "), "file_id")).otherwise(F.col("text")))
    return x12.raw_tail(files).select("file_id", "tail")


def transaction_split(spark, sf_dir):
    """Documents of each file, by ST ... SE."""
    rows = x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir)))
    return rows.where("in_st").groupBy("file_id").agg(F.countDistinct("st_ix").alias("n_docs"), F.count("*").alias("n_segments"))


_TEXT = """
WITH n AS (SELECT o_orderkey AS k, o_orderkey // 20 AS f, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
body AS (SELECT k, f, lines, 8 + 2 * lines + CASE WHEN k % 43 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS size FROM n)
"""


# --- scopes


def flat_scope_read(spark, sf_dir):
    first, found = scopes.first_read("BEG03", "", D850)
    return _placed(spark, sf_dir).groupBy("doc").agg(first.alias("a"), found.alias("b")).select("doc", scopes.finish_read("a", "b", "BEG03").alias("value"))


def qualified_loop_read(spark, sf_dir):
    first, found = scopes.first_read("N102", "N1[BT]", D850)
    return _placed(spark, sf_dir).groupBy("doc").agg(first.alias("a"), found.alias("b")).select("doc", scopes.finish_read("a", "b", "N102").alias("value"))


def line_scope_read(spark, sf_dir):
    rows = scopes.scope_rows(_placed(spark, sf_dir), "PO1", D850)
    return rows.where("seg_id = 'PO1'").select("doc", "scope_ix", F.get("elements", 1).alias("qty"), F.get("elements", 6).alias("part"))


def path_scope_read(spark, sf_dir):
    rows = scopes.scope_rows(_placed(spark, sf_dir), "PO1>PID[F]", D850)
    return rows.select("doc", "scope_ix", F.get("elements", 4).alias("text"))


def segment_scope_read(spark, sf_dir):
    rows = scopes.scope_rows(_placed(spark, sf_dir), "DTM[002]", D850)
    return rows.select("doc", F.get("elements", 1).alias("value"))


def cell_counts(spark, sf_dir):
    return scopes.cells(_placed(spark, sf_dir)).groupBy("seg_id", "elem_ix").agg(F.count("*").alias("n"))


def leaf_walk(spark, sf_dir):
    return scopes.leaves(_docs(spark, sf_dir)).groupBy("norm_path").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


def path_get(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("doc", F.try_variant_get("v", "$.order.po_number", "string").alias("po"), F.try_variant_get("v", "$.lines[1].qty", "int").alias("qty"), F.try_variant_get("v", "$.order.nothing", "string").alias("nothing"))


def loop_placement(spark, sf_dir):
    """Segments by area and innermost loop."""
    rows = _placed(spark, sf_dir)
    return rows.groupBy("area_ix", F.coalesce("inner_id", F.lit("-")).alias("loop_id"), "seg_id").agg(F.count("*").alias("n"))


def unknown_segments(spark, sf_dir):
    segs = derived.transaction_segments(spark, sf_dir)
    odd = segs.where("seg_id = 'CTT' and doc % 47 = 0").select("doc", F.col("seq") + 100000, F.lit("ZZZ"), F.array(F.lit("1")))
    return structure.unknown_segments(structure.place(segs.union(odd), D850)).select("doc", "seg_id")


# --- checks


def recon_line_count(spark, sf_dir):
    rows = checks.reconcile(_placed(spark, sf_dir), D850)
    return rows.where("rule = 'ctt-line-count'").select("doc", F.col("left_value").cast("long").alias("claimed"), F.col("right_value").cast("long").alias("actual"))


def line_count_mismatch(spark, sf_dir):
    return checks.line_counts(_placed(spark, sf_dir), _docs(spark, sf_dir), D850)


def required_element(spark, sf_dir):
    return checks.required_elements(_placed(spark, sf_dir), D850).select("doc", "segment", "elem_ix")


def required_segment(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    return checks.required_segments(rows, rows.select("doc").distinct(), [("SAC", "A"), ("BEG", None), ("PO1", None)]).select("doc", "segment")


def presence_rules(spark, sf_dir):
    """Rules of a loop, of one of several codes, and of elements by another's value."""
    rules = [
        Presence("N1", 4, loop="N1[BT]"), Presence("N1", 4, ("ST", "BT"), loop="N1", when=2), Presence("N1", 4, ("ST",)), Presence("PO1", 5, loop="PO1", when=6, values=("UP",)), Presence("BEG", 3, origin="partner"),
        Presence("SAC", codes=("A", "C")), Presence("N4", loop="N1[BT]"), Presence("N4", loop="N1"), Presence("PID", codes=("F",), loop="PO1"), Presence("ITD", origin="partner"),
    ]
    return checks.presence(_placed(spark, sf_dir), rules).select("doc", "label", "loop", "origin", F.col("seq").isNull().alias("absent"))


def document_notes(spark, sf_dir):
    """Group code and release, changed in every fourth and sixth file."""
    n = F.substring("file_id", 2, 20).cast("long")
    text = F.when(n % 4 == 0, F.replace("text", F.lit("GS*PO*"), F.lit("GS*IN*"))).otherwise(F.col("text"))
    text = F.when(n % 6 == 0, F.replace(text, F.lit("*X*004010"), F.lit("*X*005010"))).otherwise(text)
    rows = x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir).withColumn("text", text)))
    return x12.document_notes(rows, DEFINITIONS)


def required_pair(spark, sf_dir):
    return checks.required_pairs(_placed(spark, sf_dir), "PO1", 6, 10, 2, "UP").groupBy("doc").agg(F.count("*").alias("n"))


def unmapped_source(spark, sf_dir):
    return checks.unmapped_source(_placed(spark, sf_dir), PURCHASE_ORDER, D850).groupBy("seg_id").agg(F.count("*").alias("n"))


def unmapped_target(spark, sf_dir):
    return checks.unmapped_target(_docs(spark, sf_dir), PURCHASE_ORDER).select("doc", "norm_path", "leaf_text")


def pairing_orphans(spark, sf_dir):
    src = derived.transaction_segments(spark, sf_dir).where("seg_id = 'BEG'").select("doc", F.nullif(F.get("elements", 2), F.lit("")).alias("key"))
    tgt = _docs(spark, sf_dir).select("doc", F.try_variant_get("v", "$.order.po_number", "string").alias("key"))
    return checks.pair(src, tgt)[1].groupBy("issue").agg(F.count("*").alias("n"))


def pairing_duplicates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc"))
    src = o.select("doc", (F.col("doc") - F.when(F.col("doc") % 29 == 1, 1).otherwise(0)).cast("string").alias("key"))
    return checks.pair(src, o.select("doc", F.col("doc").cast("string").alias("key")))[1].select("key", "issue")


# --- rules


def _rule(row_id: str, kind: str = "header"):
    def query(spark, sf_dir):
        make = header_findings if kind == "header" else line_findings
        spec = type(PURCHASE_ORDER)(PURCHASE_ORDER.set_code, tuple(r for r in PURCHASE_ORDER.rules if r.row_id == row_id), PURCHASE_ORDER.code_lists)
        docs = _docs(spark, sf_dir)
        rows = make(_placed(spark, sf_dir), docs, spec, D850)
        return rows.select("doc", "status", F.coalesce("category", F.lit("-")).alias("category"), F.coalesce("line_ix", F.lit(-1)).alias("line_ix"), "expected", "actual")

    return query


_BASE = """
WITH l AS (SELECT l_orderkey AS k, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::INTEGER AS ix,
  l_quantity::INTEGER AS qty, CASE l_returnflag WHEN 'A' THEN 'EA' WHEN 'N' THEN 'CA' ELSE 'DZ' END AS unit, l_extendedprice::DECIMAL(18,2) AS price, l_partkey AS part FROM lineitem),
n AS (SELECT k, count(*) AS lines, sum(price) AS total FROM l GROUP BY k),
o AS (SELECT o_orderkey AS k, o_custkey AS cust, o_orderdate::DATE AS day, CASE o_orderpriority WHEN '1-URGENT' THEN 'DS' WHEN '2-HIGH' THEN 'NE' ELSE 'SA' END AS type,
  coalesce(lines, 0) AS lines, coalesce(total, 0)::DECIMAL(18,2) AS total FROM orders LEFT JOIN n ON k = o_orderkey WHERE o_orderkey % 23 <> 0)
"""


def _header(status: str, category: str, expected: str, actual: str) -> str:
    return f"{_BASE} SELECT k AS doc, {status} AS status, {category} AS category, -1 AS line_ix, {expected} AS expected, {actual} AS actual FROM o"


_LINE = """SELECT k AS doc, status, CASE WHEN status = 'FAIL' THEN category ELSE '-' END AS category, ix AS line_ix, expected, actual
FROM (SELECT l.k, ix, CASE WHEN dropped AND expected IS NOT NULL THEN 'FAIL' WHEN dropped THEN 'PASS' WHEN wrong THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN dropped THEN 'missing_output' ELSE wrong_category END AS category, expected, CASE WHEN NOT dropped THEN actual END AS actual
  FROM (SELECT l.*, l.k % 7 = 0 AND ix = lines - 1 AS dropped, {expected} AS expected, {actual} AS actual, {wrong} AS wrong, '{category}' AS wrong_category FROM l JOIN o USING (k)) l)"""

RULES = {
    "rule_code_list": ("R-02", "header", _header("'PASS'", "'-'", "CASE type WHEN 'DS' THEN 'DROP_SHIP' WHEN 'NE' THEN 'NEW_ORDER' ELSE 'STANDALONE' END", "CASE type WHEN 'DS' THEN 'DROP_SHIP' WHEN 'NE' THEN 'NEW_ORDER' ELSE 'STANDALONE' END")),
    "rule_conditional": ("R-03", "header", _header("'PASS'", "'-'", "CASE WHEN type = 'DS' THEN 'Y' ELSE 'N' END", "CASE WHEN type = 'DS' THEN 'Y' ELSE 'N' END")),
    "rule_direct": ("R-04", "header", _header("CASE WHEN k % 19 = 0 THEN 'NOT TESTED' WHEN k % 11 = 0 THEN 'FAIL' ELSE 'PASS' END", "CASE WHEN k % 19 <> 0 AND k % 11 = 0 THEN 'value_mismatch' ELSE '-' END", "CASE WHEN k % 19 <> 0 THEN 'PO' || k END", "CASE WHEN k % 19 <> 0 THEN CASE WHEN k % 11 = 0 THEN 'XX' ELSE 'PO' END || k END")),
    "fmt_date_parse": ("R-05", "header", _header("CASE WHEN k % 37 = 0 THEN 'FAIL' ELSE 'PASS' END", "CASE WHEN k % 37 = 0 THEN 'format' ELSE '-' END", "day::VARCHAR", "CASE WHEN k % 37 = 0 THEN strftime(day, '%m/%d/%Y') ELSE day::VARCHAR END")),
    "rule_constant": ("R-06", "header", _header("'PASS'", "'-'", "'PO_INBOUND'", "'PO_INBOUND'")),
    "fmt_date_shift": ("R-08", "header", _header("'PASS'", "'-'", "(day + 7)::VARCHAR", "(day + 7)::VARCHAR")),
    "rule_default": ("R-09", "header", _header("'PASS'", "'-'", "'NONE'", "'NONE'")),
    "rule_skip": ("R-11", "header", _header("'PASS'", "'-'", "CASE WHEN k % 5 <> 0 THEN cust::VARCHAR END", "CASE WHEN k % 5 <> 0 THEN cust::VARCHAR END")),
    "fmt_implied_decimal": ("R-13", "header", _header("CASE WHEN k % 3 = 0 THEN 'PASS' ELSE 'NOT TESTED' END", "'-'", "CASE WHEN k % 3 = 0 THEN '25.00' END", "CASE WHEN k % 3 = 0 THEN '25' END")),
    "rule_loop_count": ("R-31", "header", _header("'PASS'", "'-'", "lines::VARCHAR", "lines::VARCHAR")),
    "rule_count_claimed": ("R-30", "header", _header("CASE WHEN k % 31 = 0 THEN 'FAIL' ELSE 'PASS' END", "CASE WHEN k % 31 = 0 THEN 'value_mismatch' ELSE '-' END", "(lines + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END)::VARCHAR", "lines::VARCHAR")),
    "rule_todo": ("R-40", "header", _header("'NOT TESTED'", "'-'", "NULL::VARCHAR", "NULL::VARCHAR")),
    "line_code_list": ("R-22", "line", _BASE + _LINE.format(expected="CASE unit WHEN 'EA' THEN 'EACH' WHEN 'CA' THEN 'CASE' ELSE 'DOZEN' END", actual="CASE WHEN l.k % 17 = 0 THEN unit WHEN unit = 'EA' THEN 'EACH' WHEN unit = 'CA' THEN 'CASE' ELSE 'DOZEN' END", wrong="l.k % 17 = 0", category="code_translation")),
    "line_integer": ("R-21", "line", _BASE + _LINE.format(expected="qty::VARCHAR", actual="qty::VARCHAR", wrong="false", category="value_mismatch")),
    "line_conditional": ("R-24", "line", _BASE + _LINE.format(expected="CASE WHEN part % 5 <> 0 THEN part::VARCHAR END", actual="CASE WHEN part % 5 <> 0 THEN part::VARCHAR END", wrong="false", category="condition_logic")),
}


def _rule_rows(spark, spec, row_ids=None) -> DataFrame:
    """A spec's rules as rows, without spec_id."""
    rows = [(spec.set_code, r.row_id, r.source, r.context, r.target, r.kind, r.condition, r.then, r.otherwise, r.default, r.code_list, r.data_type, r.fmt) for r in spec.rules if row_ids is None or r.row_id in row_ids]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ruletable.COLUMNS[1:]))


def rules_as_rows(spark, sf_dir):
    """A spec for each nation, all in one plan: each second one leaves out R-08, and
    each third one asks for another constant. Orders take their customer's."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_nationkey").cast("string").alias("spec_id"))
    rules = _rule_rows(spark, PURCHASE_ORDER, {r for r, *_ in RULES.values()}).crossJoin(n)  # a few rules for each nation
    rules = rules.where(~((F.col("row_id") == "R-08") & (F.col("n_nationkey") % 2 == 0))).withColumn("default", F.when((F.col("row_id") == "R-06") & (F.col("n_nationkey") % 3 == 0), "PO_OTHER").otherwise(F.col("default")))
    codes = spark.createDataFrame([(k, a, b) for k, xs in PURCHASE_ORDER.code_lists.items() for a, b in xs.items()], "list string, source string, target string").crossJoin(n.select("spec_id"))
    definitions = structure.definition_rows(spark, DEFINITIONS)
    parts = derived.parts(spark, sf_dir)
    placed = share(structure.place_by(derived.transaction_segments(spark, sf_dir).withColumn("set_code", F.lit("850")), definitions), "doc", parts=parts)
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc"), F.col("c_nationkey").cast("string").alias("spec_id"))
    found = ruletable.rule_findings(placed, share(_docs(spark, sf_dir).join(own, "doc"), "doc", parts=parts), rules, codes, definitions)
    return found.groupBy("spec_id", "row_id", "status", F.coalesce("category", F.lit("-")).alias("category")).agg(F.count("*").alias("n"))


_NATIONS = "(SELECT o_orderkey AS doc, c_nationkey AS nation FROM orders JOIN customer ON c_custkey = o_custkey)"


def _rules_as_rows_sql() -> str:
    one = "SELECT nation, '{row}' AS row_id, status, category, count(*) AS n FROM ({sql}) r JOIN " + _NATIONS + " USING (doc) GROUP BY ALL"
    every = " UNION ALL ".join(one.format(row=row, sql=sql) for row, _, sql in RULES.values())
    return f"""SELECT nation::VARCHAR AS spec_id, row_id, CASE WHEN row_id = 'R-06' AND nation % 3 = 0 THEN 'FAIL' ELSE status END AS status,
  CASE WHEN row_id = 'R-06' AND nation % 3 = 0 THEN 'constant_default' ELSE category END AS category, n FROM ({every}) WHERE row_id <> 'R-08' OR nation % 2 <> 0"""


# --- mixed sets


def _mixed(spark, sf_dir) -> DataFrame:
    """Orders as 850, 855 or 856 by their key, with segments that no set knows, in
    one table of segments."""
    k = F.col("o_orderkey") % 3
    shipped = _body([("BSN", ["00", "1"]), ("HL", ["1", "", "S"]), ("TD1", ["CTN25", "1"]), ("N1", ["SF", "x"]), ("N4", ["y"])], lambda x: [("HL", [x["line_ix"] + 1, "1", "I"]), ("SN1", ["", x["qty"], "EA"])], [("CTT", [F.size("lines") + 1])])
    acked = _body([("BAK", ["00"]), ("ZZZ", ["?"])], lambda x: [("PO1", [x["line_ix"], x["qty"], "EA"]), ("ACK", ["IA", x["qty"] - F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)])], [("CTT", [F.size("lines")])])
    ordered = _body([("BEG", ["00"]), ("N1", ["ST", "x"]), ("N4", ["y"])], lambda x: [("PO1", [x["line_ix"], x["qty"], "EA"]), ("PID", ["F"])], [("CTT", [F.size("lines") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)])])
    o = derived.ordered(spark, sf_dir).withColumn("set_code", F.when(k == 0, "850").when(k == 1, "855").otherwise("856"))
    body = F.when(k == 0, ordered).when(k == 1, acked).otherwise(shipped)
    return o.select(F.col("o_orderkey").alias("doc"), "set_code", F.posexplode_outer(body).alias("seq", "s")).select("doc", "set_code", F.col("seq").cast("long").alias("seq"), "s.seg_id", "s.elements")


def mixed_placement(spark, sf_dir):
    """Three sets placed in one pass by definitions that are rows."""
    placed = structure.place_by(_mixed(spark, sf_dir), structure.definition_rows(spark, DEFINITIONS))
    return placed.groupBy("set_code", "seg_id", F.coalesce("loop_id", F.lit("-")).alias("loop_id"), F.coalesce("child_id", F.lit("-")).alias("child_id"), "known").agg(F.count("*").alias("n"), F.sum("occ_ix").alias("occurrences"))


def mixed_recon(spark, sf_dir):
    """Each document against the totals of its own set, as its rows placed it."""
    placed = share(structure.place_by(_mixed(spark, sf_dir), structure.definition_rows(spark, DEFINITIONS)), "doc", parts=derived.parts(spark, sf_dir))
    return checks.reconcile_sets(placed, DEFINITIONS).select("doc", "set_code", "rule", F.col("left_value").cast("long").alias("left_value"), F.col("right_value").cast("long").alias("right_value"))


# --- pairing by declared keys


def _keyed_run(spark, sf_dir):
    """(placed, transactions, outputs, runs, meta, definitions): files of orders and
    their outputs; specs of four sorts, by file: order numbers, customers of the
    party ST, the same outbound, and none."""
    definitions = structure.definition_rows(spark, DEFINITIONS)
    parts = derived.parts(spark, sf_dir)
    whole = x12.packed(x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir))))
    whole = whole.select(F.substring("file_id", 2, 20).cast("long").alias("run"), "set_code", (F.col("st_ix") - 1).alias("pos"), F.col("control").try_cast("long").alias("doc"), "opened", "text", "rows")
    whole = share(derived.dealt(whole, spark, sf_dir, "doc"), "doc", parts=parts)
    placed = structure.place_by(x12.unpacked(whole, "doc", "set_code"), definitions)
    transactions = whole.where("opened").select("run", "doc", "pos", "set_code")
    outputs = share(_docs(spark, sf_dir).select(F.expr("doc div 20").alias("run"), "doc", F.col("doc").cast("int").alias("pos"), "v"), "doc", parts=parts)
    runs = transactions.select("run").distinct().select("run", F.concat(F.lit("s"), F.col("run") % 4).alias("spec_id"))
    meta = [("s0", "BEG03", "order.po_number", None), ("s1", "N1[ST] N104", "ship_to.id", "Inbound"), ("s2", "ship_to.id", "N1[ST] N104", "Outbound"), ("s3", None, None, None)]
    rows = [(s, k, v) for s, a, b, d in meta for k, v in (("Pairing Key (source)", a), ("Pairing Key (target)", b), ("Direction", d), ("Transaction Set", "850"))]
    return placed, transactions, outputs, runs, spark.createDataFrame(rows, "spec_id string, key string, value string"), definitions


def pairing_by_key(spark, sf_dir):
    """Pairs and findings of each file, keys read as its spec says."""
    pairs, findings = pairing.pair_by_meta(*_keyed_run(spark, sf_dir))
    shown = pairs.select("run", F.lit("-").alias("category"), F.concat(F.lit("pair "), "key", F.lit(" "), "x12_doc", F.lit(" "), "output_doc").alias("what"))
    return shown.unionByName(findings.select("run", "category", F.concat_ws(": ", "source_ref", "actual").alias("what")))


def keyed_findings(spark, sf_dir):
    """Rules over the pairs that keys made: quantities and order numbers."""
    placed, transactions, outputs, runs, meta, definitions = _keyed_run(spark, sf_dir)
    placed = share(placed, "doc", parts=derived.parts(spark, sf_dir))
    inbound = runs.where("spec_id in ('s0', 's1')")
    pairs, _ = pairing.pair_by_meta(placed, transactions, outputs, inbound, meta, definitions)
    rows, docs = pairing.paired(placed, outputs, share(pairs), inbound)
    rules = _rule_rows(spark, PURCHASE_ORDER, {"R-04", "R-21"}).withColumn("spec_id", F.explode(F.array(F.lit("s0"), F.lit("s1"))))
    found = ruletable.rule_findings(rows, docs, rules, spark.createDataFrame([], "spec_id string, list string, source string, target string"), definitions)
    return found.groupBy("spec_id", "row_id", "status", F.coalesce("category", F.lit("-")).alias("category")).agg(F.count("*").alias("n"))


_KEYED = """
WITH k AS (SELECT o_orderkey AS k, o_orderkey // 20 AS run, o_custkey AS cust, (o_orderkey // 20) % 4 AS sort FROM orders),
s AS (SELECT k, run, sort, CASE sort WHEN 0 THEN CASE WHEN k % 19 <> 0 THEN 'PO' || k END ELSE cust::VARCHAR END AS key, row_number() OVER (PARTITION BY run ORDER BY k) AS nth FROM k),
t AS (SELECT k, run, sort, CASE sort WHEN 0 THEN CASE WHEN k % 19 = 0 THEN NULL WHEN k % 11 = 0 THEN 'XX' || k ELSE 'PO' || k END ELSE CASE WHEN k % 5 <> 0 THEN cust::VARCHAR END END AS key, k + 1 AS nth FROM k WHERE k % 23 <> 0),
sk AS (SELECT run, sort, key, min(k) AS k, count(*) AS n FROM s WHERE sort < 3 AND key IS NOT NULL GROUP BY ALL),
tk AS (SELECT run, sort, key, min(k) AS k, count(*) AS n FROM t WHERE sort < 3 AND key IS NOT NULL GROUP BY ALL),
pairs AS (SELECT run, sort, key, sk.k AS x, tk.k AS y FROM sk JOIN tk USING (run, sort, key))
"""


# --- runs


def _findings(spark, sf_dir):
    """Of documents; of groups and interchanges too, with a null doc. From the text
    of interchanges, as a run over files would be."""
    parts = derived.parts(spark, sf_dir)
    o = share(derived.orders(spark, sf_dir), "o_orderkey", parts=parts)
    numbered = share(x12.number_envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir, o=o))), "file_id", parts=parts)
    whole = x12.packed(numbered).select(F.col("control").try_cast("long").alias("doc"), "text", "rows")
    segments = x12.unpacked(derived.dealt(whole, spark, sf_dir, "doc"), "doc")
    docs = derived.output_documents(spark, sf_dir, o).select("doc", F.try_parse_json("json").alias("v"))
    rows = validate.validate(structure.place(segments, D850), docs, PURCHASE_ORDER, D850, parts)
    envelope = validate.envelope_findings(x12.control_issues(numbered)).unionByName(validate.note_findings(x12.document_notes(numbered, DEFINITIONS)))
    return rows.unionByName(envelope).unionByName(validate.split_findings(x12.split_issues(numbered, list(DEFINITIONS))))


def validate_interchange(spark, sf_dir):
    """Findings of all documents, counted by rule, status and category."""
    rows = _findings(spark, sf_dir)
    return rows.groupBy(F.coalesce("row_id", F.lit("-")).alias("row_id"), "status", F.coalesce("category", F.lit("-")).alias("category")).agg(F.count("*").alias("n"))


def status_rollup(spark, sf_dir):
    return validate.rollup(_findings(spark, sf_dir), "doc")


def category_rollup(spark, sf_dir):
    return validate.root_causes(_findings(spark, sf_dir))


_HEADER_FAIL = "(CASE WHEN k % 19 <> 0 AND k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END)"
_ALL = """, x AS (SELECT l.k, l.k % 7 = 0 AND ix = lines - 1 AS dropped, CASE WHEN l.k % 7 = 0 AND ix = lines - 1 THEN 5 + (part % 5 <> 0)::INT ELSE 0 END AS lost, (l.k % 17 = 0 AND NOT (l.k % 7 = 0 AND ix = lines - 1))::INT AS untranslated FROM l JOIN o USING (k)),
files AS (SELECT (count(DISTINCT o_orderkey // 20) FILTER ((o_orderkey // 20) % 7 = 0) + count(DISTINCT o_orderkey // 20) FILTER ((o_orderkey // 20) % 5 = 0))::BIGINT AS n FROM orders),
y AS (SELECT k, sum(lost + untranslated) AS bad, sum(6 - lost - untranslated) AS good FROM x GROUP BY k),
h AS (SELECT *, {fail} AS hf, {no} AS hn FROM o),
v AS (SELECT h.k, (hf + coalesce(bad, 0) + (h.k % 19 = 0)::INT + (h.k % 7 = 0 AND lines > 0)::INT + (h.k % 13 = 0)::INT)::BIGINT AS fail, (1 + (h.k % 31 = 0)::INT + (h.k % 41 = 0)::INT + (h.k % 43 = 0)::INT + (h.k % 3 = 0)::INT)::BIGINT AS warning,
  hn::BIGINT AS not_tested, (17 - hf - hn + coalesce(good, 0))::BIGINT AS pass FROM h LEFT JOIN y USING (k))
"""
_HEADER_NOT = "(1 + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END)"

_ALL = _ALL.format(fail=_HEADER_FAIL, no=_HEADER_NOT)


def _two_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Findings shaped from orders: the second run fails other documents."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc"))

    def run(n: int, without: int) -> DataFrame:
        bad = F.col("doc") % n == 0
        return o.where(F.col("doc") % without != 0).select("doc", F.when(bad, "FAIL").otherwise("PASS").alias("status"), F.when(bad, "value_mismatch").alias("category"), F.lit("R-04").alias("row_id"), F.lit("BEG03").alias("source_ref"), F.lit("order.po_number").alias("target"), F.lit(None).cast("int").alias("line_ix"), F.lit("a").alias("expected"), F.when(bad, F.concat(F.lit("b"), F.lit(n))).otherwise("a").alias("actual"))

    files = lambda n, step: o.where((F.col("doc") % 50 == 0) & (F.col("doc") % step != 0)).select(  # noqa: E731  findings of files have no doc
        F.lit(None).cast("long").alias("doc"), F.lit("FAIL").alias("status"), F.lit("control").alias("category"), F.lit(None).cast("string").alias("row_id"), F.concat(F.lit("(envelope) iea_missing F"), "doc").alias("source_ref"),
        F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("line_ix"), F.lit("IEA").alias("expected"), F.when(F.col("doc") % n == 0, "x").alias("actual"),
    )
    return run(10, 97).unionByName(files(250, 100)), run(15, 89).unionByName(files(350, 10**9 + 7))


def regression_diff(spark, sf_dir):
    old, new = _two_runs(spark, sf_dir)
    return history.diff(old, new).select("doc", F.coalesce("place", F.lit("-")).alias("place"), "kind", "old_status", "new_status", "regression")


def same_run(spark, sf_dir):
    """A run against itself has no change, whatever its findings."""
    old, new = _two_runs(spark, sf_dir)
    return history.diff(old, old).unionByName(history.diff(new, new)).agg(F.count("*").alias("n"))


def docs_added_removed(spark, sf_dir):
    old, new = _two_runs(spark, sf_dir)
    return history.diff(old, new).where("kind like 'DOC%'").groupBy("kind").agg(F.count("*").alias("n"))


_DIFF = """WITH k AS (SELECT o_orderkey AS doc FROM orders), s AS (SELECT doc, CASE WHEN doc % 10 = 0 THEN 'FAIL' ELSE 'PASS' END AS a, CASE WHEN doc % 15 = 0 THEN 'FAIL' ELSE 'PASS' END AS b FROM k WHERE doc % 97 <> 0 AND doc % 89 <> 0)
SELECT doc, 'order.po_number' AS place, CASE WHEN a = 'FAIL' AND b = 'PASS' THEN 'RESOLVED' ELSE 'CHANGED' END AS kind, a AS old_status, b AS new_status, a <> 'FAIL' AND b = 'FAIL' AS regression FROM s WHERE a = 'FAIL' OR b = 'FAIL'
UNION ALL SELECT doc, '-', 'DOC REMOVED', NULL, NULL, true FROM k WHERE doc % 97 <> 0 AND doc % 89 = 0 UNION ALL SELECT doc, '-', 'DOC ADDED', NULL, NULL, false FROM k WHERE doc % 97 = 0 AND doc % 89 <> 0
UNION ALL SELECT NULL, '(envelope) iea_missing F' || doc, 'NEW', NULL, 'FAIL', true FROM k WHERE doc % 100 = 0 AND doc <> 0
UNION ALL SELECT NULL, '(envelope) iea_missing F' || doc, 'CHANGED', 'FAIL', 'FAIL', false FROM k WHERE doc % 50 = 0 AND doc % 100 <> 0 AND (doc % 250 = 0) <> (doc % 350 = 0)"""


def _recorded(spark, sf_dir) -> history.History:
    """Two runs on record: the second was first tried with wrong findings, which were
    never published, and recorded with others before."""
    h = history.History(spark, f"{shared_path(spark)}/history-{uuid.uuid4().hex}")
    old, new = _two_runs(spark, sf_dir)
    h.record(1, old, "po.csv", "2026-01-01T00:00:00")
    h.write_attempt(2, old.where("status = 'PASS'"), "po.csv", "2026-01-02T00:00:00")
    h.record(2, old, "po.csv", "2026-01-02T00:00:00")
    h.record(2, new, "po.csv", "2026-01-03T00:00:00")
    h.bless("po.csv|", 1, "first", "2026-01-01T00:00:00")
    return h


def regress_by_id(spark, sf_dir):
    """A recorded run against its baseline, by key and id."""
    changes = _recorded(spark, sf_dir).regress_from_baseline("po.csv|", 2)
    return changes.select("doc", F.coalesce("place", F.lit("-")).alias("place"), "kind", "old_status", "new_status", "regression")


def run_children(spark, sf_dir):
    """Documents on record beside their run's counts."""
    return _recorded(spark, sf_dir).children().select("interchange_id", "doc", "result", "run_result", "run_fail", "file_findings", "n_documents")


def _runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    result = F.when(F.col("o_orderkey") % 7 == 0, "FAIL").when(F.col("o_orderkey") % 5 == 0, "WARNING").otherwise("PASS")
    return o.select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("spec"), F.col("o_custkey") % 9).alias("spec_file"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 1).alias("interchange_id"), result.alias("result"))


def trend_pass_rate(spark, sf_dir):
    return history.trends(_runs(spark, sf_dir)).select(F.col("label").alias("spec_file"), "total", "passed", "pass_rate", "latest", F.length("series").cast("long").alias("series_length"))


def recent_runs(spark, sf_dir):
    return _runs(spark, sf_dir).orderBy(F.desc("run_id")).limit(20).select("run_id", "spec_file", "result")


def baseline_keys(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", history.baseline_key(F.concat("c_name", F.lit("|%")), F.col("c_mktsegment")).alias("baseline_key"))


def top_root_causes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.lit("FAIL").alias("status"), F.col("event_type").alias("category"))
    return validate.root_causes(rows).limit(8)


# --- reconciliation algebra and hierarchies on other sets


def _lines_of(spark, sf_dir) -> DataFrame:
    return derived.ordered(spark, sf_dir)


def _body(head: list, line, tail: list) -> Column:
    return F.flatten(F.array(_segments(head), F.flatten(F.transform("lines", lambda x: _segments(line(x)))), _segments(tail)))


def recon_sum(spark, sf_dir):
    """855: acknowledged against ordered quantities; every 6th document is short."""
    short = F.when(F.col("o_orderkey") % 6 == 0, 1).otherwise(0)
    body = _body([("BAK", ["00"])], lambda x: [("PO1", [x["line_ix"], x["qty"], "EA"]), ("ACK", ["IA", x["qty"] - short])], [("CTT", [F.size("lines")])])
    rows = checks.reconcile(structure.place(_explode(_lines_of(spark, sf_dir), body), DEFINITIONS["855"]), DEFINITIONS["855"])
    return rows.select("doc", "rule", F.col("left_value").cast("long").alias("acknowledged"), F.col("right_value").cast("long").alias("ordered"))


def recon_combine(spark, sf_dir):
    """810: invoice total against lines, charges and allowances, in cents."""
    off = F.when(F.col("o_orderkey") % 9 == 0, 100).otherwise(0)
    cents = F.aggregate("lines", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["qty"] * x["price"]).cast("decimal(28,2)"))
    total = (cents * 100).cast("long") + 500 - 200 + off
    body = _body([("BIG", ["20260101"])], lambda x: [("IT1", [x["line_ix"], x["qty"], "EA", x["price"]])], [("TDS", [total]), ("SAC", ["C", "D240", "", "", "500"]), ("SAC", ["A", "C310", "", "", "200"])])
    rows = checks.reconcile(structure.place(_explode(_lines_of(spark, sf_dir), body), DEFINITIONS["810"]), DEFINITIONS["810"])
    return rows.where("rule = 'tds-invoice-total'").select("doc", (F.col("left_value") - F.col("right_value")).cast("decimal(18,2)").alias("difference"))


def recon_ordering(spark, sf_dir):
    """997: accepted must not exceed received, nor received the included."""
    body = _segments([("AK1", ["PO", "1"]), ("AK9", ["P", F.size("lines"), F.size("lines") + F.when(F.col("o_orderkey") % 8 == 0, 1).otherwise(0), F.size("lines") + F.when(F.col("o_orderkey") % 12 == 0, 2).otherwise(0)])])
    rows = checks.reconcile(structure.place(_explode(_lines_of(spark, sf_dir), body), DEFINITIONS["997"]), DEFINITIONS["997"])
    return rows.select("doc", "rule")


def _shipment(spark, sf_dir) -> DataFrame:
    """856: shipment > order > item; each 10th document's last item names a
    parent that isn't there."""
    item = lambda x: [
        ("HL", [x["line_ix"] + 2, F.when((F.col("o_orderkey") % 10 == 0) & (x["line_ix"] == F.size("lines")), "999").otherwise("2"), "I"]),
        ("SN1", ["", x["qty"], "EA"]),
    ]
    units = F.aggregate("lines", F.lit(0), lambda a, x: a + x["qty"]) + F.when(F.col("o_orderkey") % 14 == 0, 5).otherwise(0)
    body = _body([("BSN", ["00", "1"]), ("HL", ["1", "", "S"]), ("TD1", ["CTN25", "0"]), ("N1", ["SF", "x"]), ("N4", ["y"]), ("HL", ["2", "1", "O"]), ("PRF", [F.concat(F.lit("PO"), "o_orderkey")])], item, [("CTT", [F.size("lines") + 2, units])])
    return structure.place(_explode(_lines_of(spark, sf_dir), body), DEFINITIONS["856"])


def hl_orphans(spark, sf_dir):
    return structure.hierarchy_errors(structure.hierarchy(_shipment(spark, sf_dir)), DEFINITIONS["856"]).select("doc", "hl_id", "error")


def hl_ancestors(spark, sf_dir):
    tree = structure.hierarchy(_shipment(spark, sf_dir))
    return structure.ancestors(tree).groupBy("doc").agg(F.count("*").alias("n"), F.max("distance").alias("depth"))


def segment_labels(spark, sf_dir):
    """Segments of shipments depth first: parties inside a level follow all levels."""
    return structure.business_segments(_shipment(spark, sf_dir), DEFINITIONS["856"]).select("doc", "place", "label", "seg_id")


def hl_unit_sum(spark, sf_dir):
    rows = checks.reconcile(_shipment(spark, sf_dir), DEFINITIONS["856"])
    return rows.where("rule = 'ctt02-unit-sum'").select("doc", F.col("left_value").cast("long").alias("claimed"), F.col("right_value").cast("long").alias("units"))


def hl_nested_party(spark, sf_dir):
    """Parties nest inside hierarchical loops."""
    return _shipment(spark, sf_dir).where("child_id = 'N1'").groupBy("seg_id", "loop_id", "child_id").agg(F.count("*").alias("n"))


# --- scrubbing and scalar functions


def scrub_redact(spark, sf_dir):
    segs = derived.transaction_segments(spark, sf_dir)
    out = scrub.scrub(segs, [scrub.Mask("N1", 2, when=(1, ("ST",)))])
    return out.where("seg_id = 'N1'").select("doc", F.get("elements", 0).alias("code"), F.get("elements", 1).alias("name"))


def scrub_pseudonymize(spark, sf_dir):
    segs = derived.transaction_segments(spark, sf_dir)
    out = scrub.scrub(segs, [scrub.Mask("N1", 2, "pseudonymize")], "salt")
    return out.where("seg_id = 'N1'").select("doc", F.get("elements", 0).alias("code"), F.get("elements", 1).alias("name"))


def mask_counts(spark, sf_dir):
    return scrub.mask_report(derived.transaction_segments(spark, sf_dir), [scrub.Mask("N1", 2), scrub.Mask("N1", 4), scrub.Mask("REF", 2, when=(1, ("IA",)))])


def x12_dates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyMMdd")).when(F.col("o_orderkey") % 4 == 1, "20261345").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select(F.col("o_orderkey").alias("doc"), values.x12_date(text).alias("day"))


def x12_decimals(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size"), F.lit("x"))).otherwise(F.col("p_size").cast("string"))
    return part.select("p_partkey", values.decimal(text, 2).cast("decimal(18,2)").alias("amount"), F.coalesce(values.wrong_length(text, Format(length=(2, 2))), F.lit(False)).alias("wrong_length"))


def recon_warehouse(spark, sf_dir):
    """943: shipped units against the lines; every 9th document is one short."""
    units = F.aggregate("lines", F.lit(0), lambda a, x: a + x["qty"]) - F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)
    body = _body([("W06", ["J"]), ("N1", ["WH", "x"])], lambda x: [("W04", [x["qty"], "CA"]), ("N9", ["LT", x["part"]])], [("W03", [units])])
    rows = checks.reconcile(structure.place(_explode(_lines_of(spark, sf_dir), body), DEFINITIONS["943"]), DEFINITIONS["943"])
    return rows.where("right_value is not null").select("doc", "rule", (F.col("right_value") - F.col("left_value")).cast("long").alias("missing"))


def recon_scoped_total(spark, sf_dir):
    """844: the header's AMT[TT] against the amounts of the lines."""
    total = F.aggregate("lines", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["price"]).cast("decimal(28,2)")) + F.when(F.col("o_orderkey") % 25 == 0, 3).otherwise(0)
    body = _body([("BGN", ["00"]), ("AMT", ["TT", total])], lambda x: [("LIN", [x["line_ix"]]), ("AMT", ["LI", x["price"]])], [])
    rows = checks.reconcile(structure.place(_explode(_lines_of(spark, sf_dir), body), DEFINITIONS["844"]), DEFINITIONS["844"])
    return rows.where("right_value is not null").select("doc", (F.col("left_value") - F.col("right_value")).cast("long").alias("difference"))


# --- partner material


def import_classify(spark, sf_dir):
    """Mapping rows shaped from parts, classified by their evidence."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("row_id"), F.when(k % 11 == 0, "Code List").when(k % 13 == 0, "MOVE").alias("rule_type"), F.when(k % 3 != 0, F.concat(F.lit("PO1"), F.lpad((k % 90 + 10).cast("string"), 2, "0"))).alias("source"),
        F.when(k % 17 != 0, F.concat(F.lit("lines[].f"), k)).alias("target"), F.when(k % 5 == 0, "If PO106 is UP").when(k % 7 == 0, "ask the buyer").alias("condition"), F.when(k % 6 == 0, "X").alias("default"), F.when(k % 19 == 0, "UOM").alias("code_list"),
    )
    return partners.classify(rows).groupBy("kind", F.coalesce("review", F.lit("-")).alias("review")).agg(F.count("*").alias("n"))


def delta_merge(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_name")
    base = part.where("k % 3 != 0").select(F.col("k").alias("row_id"), F.col("k").alias("place"), F.col("p_name").alias("body"))
    delta = part.where("k % 5 = 0").select(F.col("k").alias("row_id"), F.col("k").alias("place"), F.lit("partner rule").alias("body"), (F.col("k") % 10 == 0).alias("removed"))
    return partners.merge_rules(base, delta).select("row_id", "part", "body", "origin")


def overlay_apply(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    name = F.concat(F.lit("S"), F.expr("k div 2"))
    base = part.where("k % 2 = 0").select(name.alias("segment"), F.array(F.lit("A"), F.lit("B")).alias("codes"), F.when(F.col("k") % 4 == 0, "N1").alias("loop"))
    over = part.select(name.alias("segment"), F.when(F.col("k") % 5 == 0, F.array(F.lit("C"))).otherwise(F.array(F.lit("B"), F.lit("A"))).alias("codes"), F.when(F.col("k") % 3 == 0, "N1").otherwise("PO1").alias("loop"))
    return partners.apply_overlay(base, over).groupBy("origin", "segment").agg(F.count("*").alias("n"))


def draft_prefill(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    targets = part.select(F.concat(F.lit("t."), "k").alias("path"), (F.col("k") % 4 != 0).alias("required"))
    cross = part.where("k % 5 != 0").select(F.concat(F.lit("t."), "k").alias("path"), F.lit(0).alias("file_ix"), F.lit("BEG01").alias("source"), F.lit("DIRECT").alias("kind"))
    return partners.prefill(partners.assemble_draft(targets, cross.unionByName(cross.withColumn("file_ix", F.lit(1)))))


def batch_totals(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    return partners.batch_totals(part.select(F.col("k").alias("name"), F.when(F.col("k") % 7 == 0, "FAIL").when(F.col("k") % 5 == 0, "WARNING").otherwise("PASS").alias("result")))


# --- output layouts


def _document_lines(spark, sf_dir, header: Column, line, tail: Column) -> DataFrame:
    o = derived.orders(spark, sf_dir)
    body = F.concat(F.array(header), F.transform("lines", line), F.array(tail))
    return o.select(F.col("o_orderkey").cast("string").alias("file_id"), F.posexplode(body).alias("line_no", "value"))


def flat_fold(spark, sf_dir):
    """Keyed flat files to leaves."""
    head = F.concat(F.lit("H|po_number=PO"), "o_orderkey", F.lit("|cust="), "o_custkey")
    rows = _document_lines(spark, sf_dir, head, lambda x: F.concat(F.lit("D|qty="), x["qty"], F.lit("|part="), x["part"]), F.concat(F.lit("S|count="), F.size("lines")))
    return documents.flat_leaves(rows).select("file_id", "norm_path", F.coalesce("line_ix", F.lit(-1)).alias("line_ix"), "leaf_text")


def fixed_width_fold(spark, sf_dir):
    """Fixed-width records to leaves, by routing."""
    pad = lambda c, n: F.rpad(c.cast("string"), n, " ")
    head = F.concat(pad(F.lit("HEAD"), 30), F.lit("PO"), pad(F.col("o_orderkey"), 18), pad(F.col("o_custkey"), 10))
    rows = _document_lines(spark, sf_dir, head, lambda x: F.concat(pad(F.lit("ITEM"), 30), pad(x["qty"], 10), pad(x["part"], 10)), F.concat(pad(F.lit("SUMS"), 30), pad(F.lit("001"), 5), pad(F.size("lines"), 10)))
    layout = [documents.Record("HEAD", "object", "header", (("po", 30, 20), ("cust", 50, 10))), documents.Record("ITEM", "line", "lines", (("qty", 30, 10), ("part", 40, 10))), documents.Record("SUMS", "keyed", "summary", (("kind", 30, 5), ("n", 35, 10)), "kind", "n")]
    return documents.layout_leaves(rows, layout).select("file_id", "norm_path", F.coalesce("line_ix", F.lit(-1)).alias("line_ix"), "leaf_text")


def delimited_fold(spark, sf_dir):
    """Delimited records to leaves."""
    head = F.concat_ws("|", F.lit("H"), F.concat(F.lit("PO"), "o_orderkey"), F.col("o_custkey"))
    rows = _document_lines(spark, sf_dir, head, lambda x: F.concat_ws("|", F.lit("D"), x["qty"].cast("string"), x["part"].cast("string")), F.concat_ws("|", F.lit("T"), F.lit("001"), F.size("lines").cast("string")))
    layout = [documents.Record("H", "object", "header", (("po", 1), ("cust", 2))), documents.Record("D", "line", "lines", (("qty", 1), ("part", 2))), documents.Record("T", "keyed", "summary", (("kind", 1), ("n", 2)), "kind", "n")]
    return documents.layout_leaves(rows, layout, "|").select("file_id", "norm_path", F.coalesce("line_ix", F.lit(-1)).alias("line_ix"), "leaf_text")


def json_array_documents(spark, sf_dir):
    """Documents of JSON files, arrays and single objects."""
    docs = derived.output_documents(spark, sf_dir).select(F.expr("doc div 10").alias("f"), "doc", "json")
    files = docs.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("doc", "json"))).alias("d"))
    text = F.when(F.size("d") == 1, F.get("d", 0)["json"]).otherwise(F.concat(F.lit("["), F.array_join(F.transform("d", lambda x: x["json"]), ","), F.lit("]")))
    out = documents.json_documents(files.select(F.col("f").alias("file_id"), text.alias("text")))
    return out.select("file_id", "doc_ix", F.try_variant_get("v", "$.order.vendor", "string").alias("vendor"))


def json_file_errors(spark, sf_dir):
    """JSON files that are one object, two, none, no JSON, or hold other values."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey") % 6
    one = F.to_json(F.struct("c_custkey", "c_name"))
    text = F.when(k == 0, one).when(k == 1, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))).when(k == 2, "[]").when(k == 3, F.concat(F.lit("{"), "c_name")).when(k == 4, F.concat(F.lit("["), one, F.lit(", 5]"))).otherwise("null")
    files = c.select(F.col("c_custkey").cast("string").alias("file_id"), text.alias("text"))
    both = documents.json_errors(files).withColumn("mode", F.lit("many")).unionByName(documents.json_errors(files, single=True).withColumn("mode", F.lit("one")))
    return both.select("file_id", "mode", F.coalesce("doc_ix", F.lit(-1)).alias("doc_ix"), "error")


def record_errors(spark, sf_dir):
    """Keyed flat and fixed-width files with records that nobody knows, roles and
    lines that are missing, and control records of another type or none."""
    flat = _document_lines(spark, sf_dir, F.concat(F.lit("H|po="), "o_orderkey"), lambda x: F.when((F.col("o_orderkey") % 7 == 0) & (x["line_ix"] == 1), "Q|x=1").otherwise(F.concat(F.lit("D|qty="), x["qty"])), F.when(F.col("o_orderkey") % 5 == 0, "A|city=x|torn").otherwise("A|role=ship|city=x"))
    pad = lambda c, n: F.rpad(c if isinstance(c, Column) else F.lit(c), n, " ")
    head = F.when(F.col("o_orderkey") % 11 == 0, pad("HEAD", 30)).otherwise(F.concat(pad("EDI_DC40", 30), F.when(F.col("o_orderkey") % 3 == 0, "ORDERS04").otherwise("ORDERS05")))
    fixed = _document_lines(spark, sf_dir, head, lambda x: F.when((F.col("o_orderkey") % 2 == 0) & (x["line_ix"] == 1), pad("NOTE", 30)).otherwise(pad("ITEM", 30)), pad("HUH", 30))
    layout = [documents.Record("HEAD", "object", "h", ()), documents.Record("ITEM", "line", "lines", (("q", 30, 2),)), documents.Record("NOTE", "line_child", "lines", (("n", 30, 2),))]
    return documents.flat_errors(flat).withColumn("layout", F.lit("flat")).unionByName(documents.layout_errors(fixed, layout, control=("EDI_DC40", 30, 8, "ORDERS05")).withColumn("layout", F.lit("fixed")))


# --- files


def _files(spark, sf_dir, change=None) -> DataFrame:
    """Numbered segments of interchanges, their text changed by change(text, file number)."""
    files = derived.interchange_text(spark, sf_dir)
    if change is not None:
        files = files.withColumn("text", change(F.col("text"), F.substring("file_id", 2, 20).cast("long")))
    return x12.number_envelopes(x12.tokenize(files))


def envelope_capture(spark, sf_dir):
    return x12.envelopes(x12.tokenize(derived.interchange_text(spark, sf_dir)))


def first_transaction(spark, sf_dir):
    return x12.first_transaction(_files(spark, sf_dir))


def split_issues(spark, sf_dir):
    """Each 11th file has a trailer too many, each 13th a transaction inside each,
    each 17th a set without a definition."""
    def change(text: Column, n: Column) -> Column:
        text = F.when(n % 11 == 0, F.replace(text, F.lit("~\nGE*"), F.lit("~\nSE*9*9~\nGE*"))).otherwise(text)
        text = F.when(n % 13 == 0, F.replace(text, F.lit("~\nBEG*"), F.lit("~\nST*850*X~\nBEG*"))).otherwise(text)
        return F.when((n % 17 == 0) & (n % 13 != 0), F.replace(text, F.lit("~\nST*850*"), F.lit("~\nST*000*"))).otherwise(text)

    return x12.split_issues(_files(spark, sf_dir, change), list(DEFINITIONS)).groupBy("file_id", "issue").agg(F.count("*").alias("n"))


def mixed_sets(spark, sf_dir):
    """Orders whose key ends in 0 are sent as another set."""
    return x12.mixed_sets(_files(spark, sf_dir, lambda text, n: F.regexp_replace(text, r"ST\*850\*(\d*0)~", "ST*855*$1~")), "850")


def _delimited_files(spark, sf_dir) -> DataFrame:
    """Interchanges with other delimiters and line breaks, by file number; n."""
    n = F.substring("file_id", 2, 20).cast("long")
    text = F.when(n % 4 == 1, F.translate("text", "*~", "|'")).when(n % 4 == 2, F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))).when(n % 4 == 3, F.translate("text", "*~\n", "^!")).otherwise(F.col("text"))
    return derived.interchange_text(spark, sf_dir).select("file_id", n.alias("n"), text.alias("text"))


def scrub_round_trip(spark, sf_dir):
    """Masked text against the text, byte for byte: lengths, a digest of what no mask
    may touch, and how many elements changed."""
    files = _delimited_files(spark, sf_dir)
    done = scrub.scrub_text(files.select("file_id", "text"), [scrub.Mask("N1", 2), scrub.Mask("REF", 2, "pseudonymize", when=(1, ("IA",)))], "salt")
    met = files.join(done.withColumnRenamed("text", "new"), "file_id")
    rest = lambda c: F.sha2(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(^ISA(?:.[^|*^]*){5}.)[^|*^]{15}(.ZZ.)[^|*^]{15}", "$1#$2#"), r"(GS.PO.)[^|*^]*(.)[^|*^]*", "$1#$2#"), r"(N1.(?:ST|BT).)[^|*^~'!]*", "$1#"), r"(REF.IA.)[^|*^~'!]*", "$1#").cast("binary"), 256)
    return met.select("file_id", (F.octet_length("text") == F.octet_length("new")).alias("same_length"), (rest("text") == rest("new")).alias("same_rest"), (F.col("text") == F.col("new")).alias("unmasked"), F.coalesce(F.col("new").contains("SENDER"), F.lit(True)).alias("names_sender"))


def line_surplus(spark, sf_dir):
    """Outputs with one line more than their transaction (each 29th, unless it lost
    one): what the line holds is a wrong count, what it lacks is nothing."""
    o = derived.orders(spark, sf_dir)
    short = o.withColumn("lines", F.when(F.col("o_orderkey") % 29 == 0, F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")))
    placed = structure.place(derived.transaction_segments(spark, sf_dir, short), D850)
    docs = derived.output_documents(spark, sf_dir, o).select("doc", F.try_parse_json("json").alias("v"))
    rows = line_findings(placed, docs, PURCHASE_ORDER, D850).where("source_ref like '%(absent)'")
    return rows.select("doc", "row_id", "line_ix", "status", "category", "target")


def xml_fold(spark, sf_dir):
    """XML documents to leaves; each 9th declares a document type and is left out.
    Files bear their order's key as a number until the end, by which they are dealt."""
    o = derived.ordered(spark, sf_dir)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    items = F.array_join(F.transform("lines", lambda x: F.concat(F.lit('<ITEM SEGMENT="1">'), tag("QTY", x["qty"]), tag("PART", x["part"]), F.lit("</ITEM>"))), "\n")
    text = F.concat(F.when(F.col("o_orderkey") % 9 == 0, "<!doctype x>").otherwise("<?xml version='1.0'?>"), F.lit("<ORDERS><IDOC><HEAD>"), tag("PO", F.concat(F.lit("PO"), "o_orderkey")), tag("CUST", F.col("o_custkey")), F.lit("<NIL/></HEAD>"), items, F.lit("<SUMS><KIND>001</KIND>"), tag("N", F.size("lines")), F.lit("</SUMS></IDOC></ORDERS>"))
    rows = documents.xml_records(o.select(F.col("o_orderkey").alias("file_id"), text.alias("text")))
    layout = [documents.Record("HEAD", "object", "header", (("po", "PO"), ("cust", "CUST"))), documents.Record("ITEM", "line", "lines", (("qty", "QTY"), ("part", "PART"))), documents.Record("SUMS", "keyed", "summary", (("kind", "KIND"), ("n", "N")), "kind", "n")]
    return documents.layout_leaves(rows, layout).select(F.col("file_id").cast("string").alias("file_id"), "norm_path", F.coalesce("line_ix", F.lit(-1)).alias("line_ix"), "leaf_text")


def xml_guard(spark, sf_dir):
    """Document types in UTF-8, UTF-16 and none."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("<?xml version='1.0'?><!DocType x>"), "c_name")
    k = F.col("c_custkey") % 4
    content = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, F.encode(text, "UTF-16LE")).when(k == 2, F.encode(text, "UTF-16BE")).otherwise(F.encode("c_name", "UTF-8"))
    return c.select("c_custkey", documents.guard_xml(content).alias("refused"))


def format_detection(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(k == 0, ".JSON").when(k == 1, ".xml").otherwise(".txt"))
    text = F.when(k == 2, F.concat(F.lit("EDI_DC40  4"), "c_name", F.lit("\nrest"))).otherwise(F.concat(F.lit("H|a="), "c_name"))
    return c.select("c_custkey", documents.detect_format(name, text).alias("format"))


# --- outbound


def _out(make: str, *shown: str):
    def query(spark, sf_dir):
        rows = getattr(outbound, make)(_placed(spark, sf_dir), _docs(spark, sf_dir), PURCHASE_ORDER_OUT, D850)
        return rows.groupBy("row_id", "status", F.coalesce("category", F.lit("-")).alias("category")).agg(F.count("*").alias("n"))

    return query


def outbound_header(spark, sf_dir):
    return _out("header_findings")(spark, sf_dir)


def outbound_lines(spark, sf_dir):
    return _out("line_findings")(spark, sf_dir)


def outbound_unmapped_source(spark, sf_dir):
    return outbound.unmapped_source(_docs(spark, sf_dir), PURCHASE_ORDER_OUT).groupBy("norm_path").agg(F.count("*").alias("n"))


def outbound_unmapped_target(spark, sf_dir):
    return outbound.unmapped_target(_placed(spark, sf_dir), PURCHASE_ORDER_OUT, D850).groupBy("seg_id", "elem_ix").agg(F.count("*").alias("n"))


def hl_line_scope(spark, sf_dir):
    """Items of an 856 read their order's and their shipment's segments too."""
    return line_cells(_shipment(spark, sf_dir), DEFINITIONS["856"], ["SN102", "PRF01", "TD101"])


# --- specs as tables


def _spec_rows(spark, sf_dir) -> DataFrame:
    """Rule rows shaped from parts, with planted defects."""
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.when(k % 29 == 1, F.concat(F.lit("P"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("P"), k.cast("string"))).alias("row_id"), F.when(k % 7 == 0, "BEG").when(k % 5 != 0, "BEG03").alias("source"),
        F.when(k % 11 == 0, "N1[").otherwise("N1[ST]").alias("context"), F.when(k % 13 != 0, F.concat(F.lit("a.f"), k)).alias("target"), F.when(k % 17 == 0, "GUESS").when(k % 3 == 0, "code_list").otherwise("DIRECT").alias("kind"),
        F.lit("").alias("condition"), F.lit("").alias("then"), F.lit(None).cast("string").alias("otherwise"), F.lit(None).cast("string").alias("default"), F.when((k % 3 == 0) & (k % 2 == 0), "UOM").when(k % 3 == 0, "NONE").alias("code_list"),
        F.when(k % 19 == 0, "float").alias("data_type"), F.when(k % 23 == 0, "len:x").otherwise("len:1..9;places:2").alias("fmt"),
    )


def _codes(spark, sf_dir) -> DataFrame:
    """A list of nations; every region's first letter is translated twice or more."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.lit("UOM").alias("list"), F.concat(F.lit("N"), (F.col("n_nationkey") % 20).cast("string")).alias("source"), F.col("n_name").alias("target"))


def spec_errors(spark, sf_dir):
    return tables.rule_errors(_spec_rows(spark, sf_dir), _codes(spark, sf_dir))


def spec_delta(spark, sf_dir):
    """A partner's delta: each 5th row is replaced, each 10th removed."""
    rows = _spec_rows(spark, sf_dir).withColumn("row_id", F.coalesce("target", F.lit("none"))).where("target is not null")
    k = F.substring("target", 4, 20).cast("long")
    delta = rows.where(k % 5 == 0).withColumn("kind", F.when(k % 10 == 0, "REMOVE").otherwise("TODO"))
    return tables.merge_delta(rows, delta).select("row_id", F.upper("kind").alias("kind"), "origin")


def spec_from_rows(spark, sf_dir):
    """Verdicts by a spec that was read from rows."""
    rules = spark.createDataFrame([("T-1", "BEG03", "", "order.po_number", "direct", "", "", "", None, "", "", ""), ("T-2", "BEG02", "", "order.type", "CODE_LIST", "", "", "", None, "TYPES", "string", "")], ", ".join(f"`{c}` string" for c in tables.COLUMNS))
    codes = spark.createDataFrame([("TYPES", "SA", "STANDALONE"), ("TYPES", "DS", "DROP_SHIP")], "list string, source string, target string")
    spec = tables.compile_spec("850", rules, codes)
    found = header_findings(_placed(spark, sf_dir), _docs(spark, sf_dir), spec, D850)
    return found.groupBy("row_id", "status", F.coalesce("category", F.lit("-")).alias("category")).agg(F.count("*").alias("n"))


_LAYOUT = """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ix, l_quantity::INTEGER AS qty, l_partkey AS part FROM lineitem),
n AS (SELECT o_orderkey AS k, o_custkey AS cust, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT k::VARCHAR AS file_id, 'header.{po}' AS norm_path, -1 AS line_ix, 'PO' || k AS leaf_text FROM n UNION ALL SELECT k::VARCHAR, 'header.cust', -1, cust::VARCHAR FROM n UNION ALL SELECT k::VARCHAR, 'summary.{count}', -1, lines::VARCHAR FROM n
UNION ALL SELECT k::VARCHAR, 'lines[].qty', ix::INTEGER, qty::VARCHAR FROM l UNION ALL SELECT k::VARCHAR, 'lines[].part', ix::INTEGER, part::VARCHAR FROM l"""

_ROW = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"

QUERIES = {
    tokenize_segment_counts: _TEXT + """SELECT 'ISA' AS seg_id, count(DISTINCT f) AS n, 16 * count(DISTINCT f) AS n_elements FROM n UNION ALL SELECT 'GS', count(DISTINCT f), 8 * count(DISTINCT f) FROM n
UNION ALL SELECT 'GE', count(DISTINCT f), 2 * count(DISTINCT f) FROM n UNION ALL SELECT 'IEA', count(DISTINCT f) FILTER (f % 5 <> 0), 2 * count(DISTINCT f) FILTER (f % 5 <> 0) FROM n
UNION ALL SELECT 'ST', count(*), 2 * count(*) FROM n UNION ALL SELECT 'SE', count(*), 2 * count(*) FROM n UNION ALL SELECT 'BEG', count(*), 5 * count(*) FROM n UNION ALL SELECT 'REF', count(*), 2 * count(*) FROM n
UNION ALL SELECT 'DTM', count(*), 2 * count(*) FROM n UNION ALL SELECT 'N1', 2 * count(*), 6 * count(*) FROM n UNION ALL SELECT 'N4', count(*), count(*) FROM n UNION ALL SELECT 'CTT', count(*), count(*) FROM n
UNION ALL SELECT 'AMT', count(*), 2 * count(*) FROM n UNION ALL SELECT 'ITD', count(*), 2 * count(*) FROM n WHERE k % 43 = 0 UNION ALL SELECT 'SAC', count(*), 5 * count(*) FROM n WHERE k % 3 = 0
UNION ALL SELECT 'PO1', sum(lines)::BIGINT, 7 * sum(lines)::BIGINT FROM n UNION ALL SELECT 'PID', sum(lines)::BIGINT, 5 * sum(lines)::BIGINT FROM n""",
    envelope_se_count: _TEXT + "SELECT 'F' || f AS file_id, (size + 2)::VARCHAR AS expected, (size + 4)::VARCHAR AS actual FROM body WHERE k % 13 = 0",
    envelope_se_control: _TEXT + "SELECT 'se_count' AS issue, count(*) AS n FROM n WHERE k % 13 = 0 UNION ALL SELECT 'ge_count', count(DISTINCT f) FROM n WHERE f % 7 = 0 UNION ALL SELECT 'iea_missing', count(DISTINCT f) FROM n WHERE f % 5 = 0",
    envelope_ge_count: _TEXT + "SELECT 'F' || f AS file_id, count(*)::VARCHAR AS expected, (count(*) + 1)::VARCHAR AS actual FROM n WHERE f % 7 = 0 GROUP BY f",
    truncated_interchange: _TEXT + "SELECT DISTINCT 'F' || f AS file_id FROM n WHERE f % 5 = 0",
    raw_tail: "SELECT DISTINCT 'F' || (o_orderkey // 20) AS file_id, 'LEFT OVER F' || (o_orderkey // 20) AS tail FROM orders WHERE (o_orderkey // 20) % 3 = 0",
    transaction_split: _TEXT + "SELECT 'F' || f AS file_id, count(*) AS n_docs, sum(size + 2)::BIGINT AS n_segments FROM body GROUP BY f",
    flat_scope_read: "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 19 <> 0 THEN 'PO' || o_orderkey END AS value FROM orders",
    qualified_loop_read: "SELECT o_orderkey AS doc, n_name AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
    line_scope_read: f"SELECT l_orderkey AS doc, ({_ROW})::INTEGER AS scope_ix, l_quantity::INTEGER::VARCHAR AS qty, l_partkey::VARCHAR AS part FROM lineitem",
    path_scope_read: f"SELECT l_orderkey AS doc, ({_ROW})::INTEGER AS scope_ix, 'part ' || l_partkey AS text FROM lineitem",
    segment_scope_read: "SELECT o_orderkey AS doc, strftime(o_orderdate, '%Y%m%d') AS value FROM orders",
    cell_counts: """WITH o AS (SELECT o_orderkey AS k FROM orders), l AS (SELECT count(*) AS n FROM lineitem), c AS (SELECT count(*) AS n FROM o)
SELECT unnest(['BEG', 'BEG', 'BEG', 'REF', 'REF', 'DTM', 'DTM', 'N1', 'N1', 'N4', 'CTT', 'AMT', 'AMT']) AS seg_id, unnest([1, 2, 5, 1, 2, 1, 2, 1, 2, 1, 1, 1, 2])::INTEGER AS elem_ix, unnest([1, 1, 1, 1, 1, 1, 1, 2, 2, 1, 1, 1, 1]) * n AS n FROM c
UNION ALL SELECT 'BEG', 3, count(*) FROM o WHERE k % 19 <> 0 UNION ALL SELECT 'N1', unnest([3, 4]), count(*) FROM o UNION ALL SELECT 'ITD', unnest([1, 2]), count(*) FROM o WHERE k % 43 = 0
UNION ALL SELECT 'SAC', unnest([1, 2, 5]), count(*) FROM o WHERE k % 3 = 0 UNION ALL SELECT 'PO1', unnest([1, 2, 3, 4, 6, 7]), n FROM l UNION ALL SELECT 'PID', unnest([1, 5]), n FROM l""",
    leaf_walk: _BASE + """SELECT 'order.' || unnest(['purpose', 'type', 'drop_ship', 'po_date', 'record_type', 'vendor', 'due_date', 'release']) AS norm_path, count(*) AS n, count(*) AS n_docs FROM o
UNION ALL SELECT unnest(['ship_to.name', 'ship_to.city', 'summary.line_count', 'summary.total']), count(*), count(*) FROM o UNION ALL SELECT 'order.po_number', count(*), count(*) FROM o WHERE k % 19 <> 0
UNION ALL SELECT 'order.allowance', count(*), count(*) FROM o WHERE k % 3 = 0 UNION ALL SELECT 'order.extra', count(*), count(*) FROM o WHERE k % 41 = 0 UNION ALL SELECT 'ship_to.id', count(*), count(*) FROM o WHERE k % 5 <> 0
UNION ALL SELECT 'lines[].' || unnest(['line_no', 'qty', 'uom', 'price', 'text']), count(*), count(DISTINCT k) FROM l JOIN o USING (k) WHERE NOT (k % 7 = 0 AND ix = lines - 1)
UNION ALL SELECT 'lines[].part', count(*), count(DISTINCT k) FROM l JOIN o USING (k) WHERE NOT (k % 7 = 0 AND ix = lines - 1) AND part % 5 <> 0""",
    path_get: _BASE + "SELECT o.k AS doc, CASE WHEN o.k % 19 = 0 THEN NULL WHEN o.k % 11 = 0 THEN 'XX' || o.k ELSE 'PO' || o.k END AS po, CASE WHEN NOT (o.k % 7 = 0 AND lines = 2) THEN qty END AS qty, NULL::VARCHAR AS nothing FROM o LEFT JOIN l ON l.k = o.k AND ix = 1",
    loop_placement: """WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT 0 AS area_ix, '-' AS loop_id, unnest(['BEG', 'REF', 'DTM']) AS seg_id, count(*) AS n FROM o UNION ALL SELECT 0, '-', 'ITD', count(*) FROM o WHERE k % 43 = 0 UNION ALL SELECT 0, '-', 'SAC', count(*) FROM o WHERE k % 3 = 0
UNION ALL SELECT 0, 'N1', 'N1', 2 * count(*) FROM o UNION ALL SELECT 0, 'N1', 'N4', count(*) FROM o UNION ALL SELECT 2, '-', unnest(['CTT', 'AMT']), count(*) FROM o UNION ALL SELECT 1, 'PO1', unnest(['PO1', 'PID']), count(*) FROM lineitem""",
    unknown_segments: "SELECT o_orderkey AS doc, 'ZZZ' AS seg_id FROM orders WHERE o_orderkey % 47 = 0",
    recon_line_count: "SELECT o_orderkey AS doc, count(l_orderkey) + 1 AS claimed, count(l_orderkey) AS actual FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 31 = 0 GROUP BY 1",
    line_count_mismatch: _BASE + "SELECT k AS doc, lines AS source_lines, lines - 1 AS output_lines FROM o WHERE k % 7 = 0 AND lines > 0",
    required_element: "SELECT o_orderkey AS doc, 'BEG' AS segment, 3 AS elem_ix FROM orders WHERE o_orderkey % 19 = 0",
    required_segment: "SELECT o_orderkey AS doc, 'SAC' AS segment FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'PO1' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    presence_rules: """WITH n AS (SELECT o_orderkey AS k, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT k AS doc, 'N104' AS label, 'N1[BT]' AS loop, 'base' AS origin, false AS absent FROM n UNION ALL SELECT k, 'N104*{ST|BT}', 'N1', 'base', false FROM n
UNION ALL SELECT l_orderkey, 'PO105', 'PO1', 'base', false FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 5 = 0 UNION ALL SELECT k, 'BEG03', '', 'partner', false FROM n WHERE k % 19 = 0
UNION ALL SELECT k, 'SAC*{A|C}', '', 'base', true FROM n WHERE k % 3 <> 0 UNION ALL SELECT k, 'N4', 'N1[BT]', 'base', true FROM n
UNION ALL SELECT k, 'PID*F', 'PO1', 'base', true FROM n WHERE lines = 0 UNION ALL SELECT k, 'ITD', '', 'partner', true FROM n WHERE k % 43 <> 0""",
    document_notes: """SELECT 'F' || (o_orderkey // 20) AS file_id, lpad(o_orderkey::VARCHAR, 9, '0') AS control, 'group' AS note, 'PO' AS expected, 'IN' AS actual FROM orders WHERE (o_orderkey // 20) % 4 = 0
UNION ALL SELECT 'F' || (o_orderkey // 20), lpad(o_orderkey::VARCHAR, 9, '0'), 'version', '004010', '005010' FROM orders WHERE (o_orderkey // 20) % 6 = 0""",
    required_pair: "SELECT l_orderkey AS doc, count(*) AS n FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1",
    unmapped_source: "SELECT 'ITD' AS seg_id, count(*) AS n FROM orders WHERE o_orderkey % 43 = 0 UNION ALL SELECT 'SAC', count(*) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'N1', count(*) FROM orders",
    unmapped_target: _BASE + "SELECT k AS doc, 'order.extra' AS norm_path, '?' AS leaf_text FROM o WHERE k % 41 = 0",
    pairing_orphans: "SELECT 'unmatched_source' AS issue, count(*) AS n FROM orders WHERE o_orderkey % 19 <> 0 AND (o_orderkey % 23 = 0 OR o_orderkey % 11 = 0) UNION ALL SELECT 'unmatched_target', count(*) FROM orders WHERE o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 11 = 0 UNION ALL SELECT 'no_key_source', count(*) FROM orders WHERE o_orderkey % 19 = 0 UNION ALL SELECT 'no_key_target', count(*) FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey % 23 <> 0",
    pairing_duplicates: """WITH o AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT k - CASE WHEN k % 29 = 1 THEN 1 ELSE 0 END AS key FROM o)
SELECT key::VARCHAR AS key, 'duplicate_source' AS issue FROM s GROUP BY key HAVING count(*) > 1 UNION ALL SELECT k::VARCHAR, 'unmatched_target' FROM o WHERE k NOT IN (SELECT key FROM s)
UNION ALL SELECT key::VARCHAR, 'unmatched_source' FROM (SELECT DISTINCT key FROM s) WHERE key NOT IN (SELECT k FROM o)""",
    validate_interchange: _BASE + """, h AS (SELECT *, count(*) OVER () AS c FROM o), x AS (SELECT l.*, o.lines, l.k % 7 = 0 AND ix = lines - 1 AS dropped FROM l JOIN o USING (k))
SELECT * FROM (
SELECT unnest(['R-01', 'R-02', 'R-03', 'R-06', 'R-07', 'R-08', 'R-09', 'R-10', 'R-11', 'R-12', 'R-31', 'R-32']) AS row_id, 'PASS' AS status, '-' AS category, count(*) AS n FROM o
UNION ALL SELECT 'R-40', 'NOT TESTED', '-', count(*) FROM o
UNION ALL SELECT 'R-04', 'NOT TESTED', '-', count(*) FROM o WHERE k % 19 = 0 UNION ALL SELECT 'R-04', 'FAIL', 'value_mismatch', count(*) FROM o WHERE k % 19 <> 0 AND k % 11 = 0 UNION ALL SELECT 'R-04', 'PASS', '-', count(*) FROM o WHERE k % 19 <> 0 AND k % 11 <> 0
UNION ALL SELECT 'R-05', 'FAIL', 'format', count(*) FROM o WHERE k % 37 = 0 UNION ALL SELECT 'R-05', 'PASS', '-', count(*) FROM o WHERE k % 37 <> 0
UNION ALL SELECT 'R-13', 'PASS', '-', count(*) FROM o WHERE k % 3 = 0 UNION ALL SELECT 'R-13', 'NOT TESTED', '-', count(*) FROM o WHERE k % 3 <> 0
UNION ALL SELECT 'R-30', 'FAIL', 'value_mismatch', count(*) FROM o WHERE k % 31 = 0 UNION ALL SELECT 'R-30', 'PASS', '-', count(*) FROM o WHERE k % 31 <> 0
UNION ALL SELECT unnest(['R-20', 'R-21', 'R-23', 'R-25']), 'PASS', '-', count(*) FROM x WHERE NOT dropped UNION ALL SELECT unnest(['R-20', 'R-21', 'R-22', 'R-23', 'R-25']), 'FAIL', 'missing_output', count(*) FROM x WHERE dropped
UNION ALL SELECT 'R-22', 'FAIL', 'code_translation', count(*) FROM x WHERE NOT dropped AND k % 17 = 0 UNION ALL SELECT 'R-22', 'PASS', '-', count(*) FROM x WHERE NOT dropped AND k % 17 <> 0
UNION ALL SELECT 'R-24', 'PASS', '-', count(*) FROM x WHERE NOT dropped OR part % 5 = 0 UNION ALL SELECT 'R-24', 'FAIL', 'missing_output', count(*) FROM x WHERE dropped AND part % 5 <> 0
UNION ALL SELECT '-', 'FAIL', 'source_data', count(*) FROM o WHERE k % 19 = 0 UNION ALL SELECT '-', 'FAIL', 'count_mismatch', count(*) FROM o WHERE k % 7 = 0 AND lines > 0 UNION ALL SELECT '-', 'WARNING', 'count_mismatch', count(*) FROM o WHERE k % 31 = 0
UNION ALL SELECT '-', 'FAIL', 'missing_output', count(*) FROM orders WHERE o_orderkey % 23 = 0 UNION ALL SELECT '-', 'FAIL', 'control', (count(*) FILTER (o_orderkey % 13 = 0) + count(DISTINCT o_orderkey // 20) FILTER ((o_orderkey // 20) % 7 = 0) + count(DISTINCT o_orderkey // 20) FILTER ((o_orderkey // 20) % 5 = 0))::BIGINT FROM orders
UNION ALL SELECT '-', 'WARNING', 'unmapped_target', count(*) FROM o WHERE k % 41 = 0 UNION ALL SELECT '-', 'WARNING', 'unmapped_source', (count(*) + count(*) FILTER (k % 43 = 0) + count(*) FILTER (k % 3 = 0))::BIGINT FROM o) WHERE n > 0""",
    status_rollup: _BASE + _ALL + """SELECT k AS doc, fail, warning, not_tested, pass, CASE WHEN fail > 0 THEN 'FAIL' WHEN warning > 0 THEN 'WARNING' ELSE 'PASS' END AS result FROM v
UNION ALL SELECT o_orderkey, (1 + (o_orderkey % 13 = 0)::INT)::BIGINT, 0, 0, 0, 'FAIL' FROM orders WHERE o_orderkey % 23 = 0
UNION ALL SELECT NULL, n, 0, 0, 0, 'FAIL' FROM files WHERE n > 0""",
    category_rollup: _BASE + _ALL + """SELECT * FROM (SELECT 'value_mismatch' AS category, (count(*) FILTER (k % 19 <> 0 AND k % 11 = 0) + count(*) FILTER (k % 31 = 0))::BIGINT AS n FROM o UNION ALL SELECT 'format', count(*) FROM o WHERE k % 37 = 0
UNION ALL SELECT 'missing_output', (coalesce(sum(lost), 0) + (SELECT count(*) FROM orders WHERE o_orderkey % 23 = 0))::BIGINT FROM x UNION ALL SELECT 'code_translation', coalesce(sum(untranslated), 0)::BIGINT FROM x UNION ALL SELECT 'source_data', count(*) FROM o WHERE k % 19 = 0
UNION ALL SELECT 'count_mismatch', (count(*) FILTER (k % 7 = 0 AND lines > 0) + count(*) FILTER (k % 31 = 0))::BIGINT FROM o UNION ALL SELECT 'unmapped_target', count(*) FROM o WHERE k % 41 = 0
UNION ALL SELECT 'unmapped_source', (count(*) + count(*) FILTER (k % 43 = 0) + count(*) FILTER (k % 3 = 0))::BIGINT FROM o UNION ALL SELECT 'control', ((SELECT n FROM files) + (SELECT count(*) FROM orders WHERE o_orderkey % 13 = 0))::BIGINT) WHERE n > 0""",
    regression_diff: _DIFF,
    regress_by_id: _DIFF,

    rules_as_rows: _rules_as_rows_sql(),
    mixed_placement: """WITH n AS (SELECT o_orderkey AS k, o_orderkey % 3 AS t, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
s AS (SELECT t, sum(lines) AS l, count(*) AS d, sum(lines * (lines + 1) // 2) AS tri, sum(lines) AS x FROM n GROUP BY t),
r AS (SELECT * FROM s, (VALUES (0, '850', 'BEG', '-', '-', 'd', NULL), (0, '850', 'N1', 'N1', '-', 'd', 'd'), (0, '850', 'N4', 'N1', '-', 'd', 'd'), (0, '850', 'PO1', 'PO1', '-', 'l', 't'), (0, '850', 'PID', 'PO1', '-', 'l', 't'), (0, '850', 'CTT', '-', '-', 'd', NULL),
  (1, '855', 'BAK', '-', '-', 'd', NULL), (1, '855', 'ZZZ', '-', '-', 'd', NULL), (1, '855', 'PO1', 'PO1', '-', 'l', 't'), (1, '855', 'ACK', 'PO1', '-', 'l', 't'), (1, '855', 'CTT', '-', '-', 'd', NULL),
  (2, '856', 'BSN', '-', '-', 'd', NULL), (2, '856', 'TD1', 'HL', '-', 'd', 'd'), (2, '856', 'N1', 'HL', 'N1', 'd', 'd'), (2, '856', 'N4', 'HL', 'N1', 'd', 'd'), (2, '856', 'HL', 'HL', '-', 'h', 'h'), (2, '856', 'SN1', 'HL', '-', 'l', 's'), (2, '856', 'CTT', '-', '-', 'd', NULL))
  v(t2, set_code, seg_id, loop_id, child_id, many, occ) WHERE t = t2)
SELECT set_code, seg_id, loop_id, child_id, seg_id <> 'ZZZ' AS known, (CASE many WHEN 'd' THEN d WHEN 'l' THEN l ELSE d + l END)::BIGINT AS n, (CASE occ WHEN 'd' THEN d WHEN 't' THEN tri WHEN 's' THEN tri + l WHEN 'h' THEN tri + l + d END)::BIGINT AS occurrences
FROM r WHERE many <> 'l' OR l > 0""",
    mixed_recon: """WITH n AS (SELECT o_orderkey AS doc, count(l_orderkey) AS lines, coalesce(sum(l_quantity::INTEGER), 0)::BIGINT AS qty FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT doc, '850' AS set_code, 'ctt-line-count' AS rule, lines + 1 AS left_value, lines AS right_value FROM n WHERE doc % 3 = 0 AND doc % 7 = 0
UNION ALL SELECT doc, '855', 'ack-qty-accounted', qty - lines, qty FROM n WHERE doc % 3 = 1 AND doc % 5 = 0 AND lines > 0
UNION ALL SELECT doc, '856', 'td1-carton-count', 1, 0 FROM n WHERE doc % 3 = 2""",
    pairing_by_key: _KEYED + """SELECT run, '-' AS category, 'pair ' || key || ' ' || x || ' ' || y AS what FROM pairs
UNION ALL SELECT run, CASE sort WHEN 2 THEN 'unexpected_output' ELSE 'missing_output' END, CASE sort WHEN 2 THEN 'target' ELSE 'source' END || ' key ' || key || ': no partner' FROM sk ANTI JOIN tk USING (run, key)
UNION ALL SELECT run, CASE sort WHEN 2 THEN 'missing_output' ELSE 'unexpected_output' END, CASE sort WHEN 2 THEN 'source' ELSE 'target' END || ' key ' || key || ': no partner' FROM tk ANTI JOIN sk USING (run, key)
UNION ALL SELECT run, 'count_mismatch', CASE sort WHEN 2 THEN 'target' ELSE 'source' END || ' key ' || key || ': shared' FROM sk WHERE n > 1 UNION ALL SELECT run, 'count_mismatch', CASE sort WHEN 2 THEN 'source' ELSE 'target' END || ' key ' || key || ': shared' FROM tk WHERE n > 1
UNION ALL SELECT run, 'missing_output', CASE sort WHEN 2 THEN 'target' ELSE 'source' END || ' #' || nth || ': no key' FROM s WHERE sort < 3 AND key IS NULL UNION ALL SELECT run, 'missing_output', CASE sort WHEN 2 THEN 'source' ELSE 'target' END || ' #' || nth || ': no key' FROM t WHERE sort < 3 AND key IS NULL
UNION ALL SELECT run, CASE WHEN a = 1 AND b = 1 THEN '-' ELSE 'spec' END, CASE WHEN a = 1 AND b = 1 THEN 'pair #1 ' || x || ' ' || y ELSE '(pairing): ' || a || ' to ' || coalesce(b, 0) || ' without a key' END
FROM (SELECT run, count(*) AS a, min(k) AS x FROM s WHERE sort = 3 GROUP BY run) LEFT JOIN (SELECT run, count(*) AS b, min(k) AS y FROM t WHERE sort = 3 GROUP BY run) USING (run)""",
    keyed_findings: _KEYED + """, l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ix, l_quantity::INTEGER AS qty FROM lineitem),
m AS (SELECT k, count(*) AS n FROM l GROUP BY k), p AS (SELECT pairs.*, CASE WHEN x % 19 <> 0 THEN 'PO' || x END AS want, CASE WHEN y % 19 = 0 THEN NULL WHEN y % 11 = 0 THEN 'XX' || y ELSE 'PO' || y END AS got FROM pairs WHERE sort < 2),
h AS (SELECT sort, 'R-04' AS row_id, CASE WHEN want IS NULL AND got IS NULL THEN 'NOT TESTED' WHEN want IS NULL OR got IS NULL OR want <> got THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN want IS NULL AND got IS NOT NULL THEN 'unexpected_output' WHEN want IS NOT NULL AND got IS NULL THEN 'missing_output' WHEN want <> got THEN 'value_mismatch' ELSE '-' END AS category FROM p),
a AS (SELECT p.sort, p.x, l.ix, l.qty FROM p JOIN l ON l.k = p.x), b AS (SELECT p.sort, p.x, l.ix, l.qty FROM p JOIN l ON l.k = p.y JOIN m ON m.k = p.y WHERE NOT (p.y % 7 = 0 AND l.ix = m.n)),
r AS (SELECT coalesce(a.sort, b.sort) AS sort, 'R-21' AS row_id, CASE WHEN a.qty = b.qty THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN a.qty = b.qty THEN '-' WHEN a.qty IS NULL THEN 'count_mismatch' WHEN b.qty IS NULL THEN 'missing_output' ELSE 'value_mismatch' END AS category FROM a FULL JOIN b ON a.sort = b.sort AND a.x = b.x AND a.ix = b.ix)
SELECT 's' || sort AS spec_id, row_id, status, category, count(*) AS n FROM (SELECT * FROM h UNION ALL SELECT * FROM r) GROUP BY ALL""",
    run_children: """WITH k AS (SELECT o_orderkey AS doc FROM orders), d AS (SELECT 1 AS interchange_id, doc, CASE WHEN doc % 10 = 0 THEN 'FAIL' ELSE 'PASS' END AS result FROM k WHERE doc % 97 <> 0 UNION ALL SELECT 2, doc, CASE WHEN doc % 15 = 0 THEN 'FAIL' ELSE 'PASS' END FROM k WHERE doc % 89 <> 0),
f AS (SELECT 1 AS interchange_id, count(*) AS n FROM k WHERE doc % 50 = 0 AND doc % 100 <> 0 UNION ALL SELECT 2, count(*) FROM k WHERE doc % 50 = 0 AND doc <> 0), t AS (SELECT interchange_id, count(*) AS n_documents, count(*) FILTER (result = 'FAIL') AS bad FROM d GROUP BY 1)
SELECT interchange_id::BIGINT AS interchange_id, doc, result, 'FAIL' AS run_result, bad + n AS run_fail, n AS file_findings, n_documents FROM d JOIN f USING (interchange_id) JOIN t USING (interchange_id)""",
    json_file_errors: """WITH f AS (SELECT c_custkey::VARCHAR AS file_id, c_custkey % 6 AS k FROM customer)
SELECT file_id, 'many' AS mode, CASE WHEN k = 4 THEN 1 ELSE -1 END AS doc_ix, CASE k WHEN 2 THEN 'empty_array' WHEN 3 THEN 'not_json' ELSE 'not_an_object' END AS error FROM f WHERE k IN (2, 3, 4, 5)
UNION ALL SELECT file_id, 'one', -1, CASE k WHEN 3 THEN 'not_json' WHEN 5 THEN 'not_an_object' ELSE 'array' END FROM f WHERE k > 0""",
    record_errors: """WITH n AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS file_id, count(l_orderkey)::INTEGER AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT file_id, 1 AS line_no, 'unknown_record' AS error, 'flat' AS layout FROM n WHERE k % 7 = 0 AND lines > 0 UNION ALL SELECT file_id, lines + 1, unnest(['no_role', 'torn_pair']), 'flat' FROM n WHERE k % 5 = 0
UNION ALL SELECT file_id, 0, CASE WHEN k % 11 = 0 THEN 'no_control_record' ELSE 'other_type' END, 'fixed' FROM n WHERE k % 11 = 0 OR k % 3 = 0 UNION ALL SELECT file_id, 1, 'child_before_line', 'fixed' FROM n WHERE k % 2 = 0 AND lines > 0 UNION ALL SELECT file_id, lines + 1, 'unknown_record', 'fixed' FROM n""",
    segment_labels: """WITH n AS (SELECT o_orderkey AS doc, count(l_orderkey)::INTEGER AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT doc, place, label, seg_id FROM (SELECT doc, unnest([1, 2, 3, 4, 5, 6 + 2 * l, 7 + 2 * l, 8 + 2 * l]) AS place, unnest(['header', 'HL #1', 'HL #1', 'HL #2', 'HL #2', 'N1[SF]', 'N1[SF]', 'summary']) AS label, unnest(['BSN', 'HL', 'TD1', 'HL', 'PRF', 'N1', 'N4', 'CTT']) AS seg_id FROM n)
UNION ALL SELECT doc, 4 + 2 * i + t, 'HL #' || (i + 2), CASE t WHEN 0 THEN 'HL' ELSE 'SN1' END FROM (SELECT doc, unnest(range(1, l + 1))::INTEGER AS i FROM n), (VALUES (0), (1)) v(t)""",
    same_run: "SELECT 0::BIGINT AS n FROM orders LIMIT 1",
    docs_added_removed: "SELECT 'DOC REMOVED' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0 UNION ALL SELECT 'DOC ADDED', count(*) FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 89 <> 0",
    trend_pass_rate: """WITH r AS (SELECT o_orderkey AS k, 'spec' || (o_custkey % 9) AS spec_file, CASE WHEN o_orderkey % 7 = 0 THEN 'FAIL' WHEN o_orderkey % 5 = 0 THEN 'WARNING' ELSE 'PASS' END AS result FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 200) WHERE o_orderkey % 3 <> 0)
SELECT spec_file, count(*) AS total, count(*) FILTER (result = 'PASS') AS passed, round(avg(CASE WHEN result = 'PASS' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, max_by(result, k) AS latest, count(*) AS series_length FROM r GROUP BY spec_file""",
    recent_runs: "SELECT o_orderkey AS run_id, 'spec' || (o_custkey % 9) AS spec_file, CASE WHEN o_orderkey % 7 = 0 THEN 'FAIL' WHEN o_orderkey % 5 = 0 THEN 'WARNING' ELSE 'PASS' END AS result FROM orders ORDER BY o_orderkey DESC LIMIT 20",
    baseline_keys: "SELECT c_custkey, replace(replace(c_name || '|%', '%', '%25'), '|', '%7C') || '|' || c_mktsegment AS baseline_key FROM customer",
    top_root_causes: "SELECT event_type AS category, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8",
    recon_sum: "SELECT l_orderkey AS doc, 'ack-qty-accounted' AS rule, (sum(l_quantity::INTEGER) - count(*))::BIGINT AS acknowledged, sum(l_quantity::INTEGER)::BIGINT AS ordered FROM lineitem WHERE l_orderkey % 6 = 0 GROUP BY 1",
    recon_combine: "SELECT o_orderkey AS doc, 1.00::DECIMAL(18,2) AS difference FROM orders WHERE o_orderkey % 9 = 0",
    recon_ordering: "SELECT o_orderkey AS doc, 'received-lte-included' AS rule FROM orders WHERE o_orderkey % 8 = 0 UNION ALL SELECT o_orderkey, 'accepted-lte-received' FROM orders WHERE o_orderkey % 12 = 0",
    hl_orphans: "SELECT l_orderkey AS doc, (count(*) + 2)::VARCHAR AS hl_id, 'orphan' AS error FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1",
    hl_ancestors: """WITH n AS (SELECT o_orderkey AS k, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), m AS (SELECT k, lines - CASE WHEN k % 10 = 0 AND lines > 0 THEN 1 ELSE 0 END AS items FROM n)
SELECT k AS doc, 1 + 2 * items AS n, CASE WHEN items > 0 THEN 2 ELSE 1 END AS depth FROM m""",
    hl_unit_sum: "SELECT l_orderkey AS doc, (sum(l_quantity::INTEGER) + 5)::BIGINT AS claimed, sum(l_quantity::INTEGER)::BIGINT AS units FROM lineitem WHERE l_orderkey % 14 = 0 GROUP BY 1",
    hl_nested_party: "SELECT unnest(['N1', 'N4']) AS seg_id, 'HL' AS loop_id, 'N1' AS child_id, count(*) AS n FROM orders",
    scrub_redact: "SELECT o_orderkey AS doc, 'ST' AS code, regexp_replace(c_name, '[\\p{L}\\p{N}]', 'X', 'g') AS name FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, 'BT', n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
    scrub_pseudonymize: """WITH n AS (SELECT o_orderkey AS doc, 'ST' AS code, c_name AS v FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, 'BT', n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
u AS (SELECT v, sha256('salt' || chr(0) || v) AS h FROM n GROUP BY v), c AS (SELECT v, h, unnest(range(1, length(v) + 1)) AS i FROM u),
d AS (SELECT v, i, substr(v, i, 1) AS ch, ('0x' || substr(h, 2 * length(regexp_replace(substr(v, 1, i - 1), '[^\\p{Nd}\\p{L}]', '', 'g')) + 1, 2))::INTEGER AS b FROM c),
p AS (SELECT v, string_agg(CASE WHEN regexp_matches(ch, '\\p{Nd}') THEN (b % 10)::VARCHAR WHEN regexp_matches(ch, '\\p{L}') THEN chr(65 + b % 26) ELSE ch END, '' ORDER BY i) AS name FROM d GROUP BY v)
SELECT doc, code, name FROM n JOIN p USING (v)""",
    mask_counts: """WITH x AS (SELECT o_orderkey, o_custkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), names AS (SELECT c_name AS v FROM x UNION ALL SELECT n_name FROM x)
SELECT 'N1' AS segment, 2 AS element, count(*) AS n, count(DISTINCT v) AS n_distinct FROM names UNION ALL SELECT 'N1', 4, count(*), count(DISTINCT o_custkey) FROM x UNION ALL SELECT 'REF', 2, count(*), count(DISTINCT o_custkey) FROM x""",
    recon_warehouse: "SELECT l_orderkey AS doc, 'w03-transfer-sum' AS rule, 1::BIGINT AS missing FROM lineitem WHERE l_orderkey % 9 = 0 GROUP BY 1",
    recon_scoped_total: "SELECT l_orderkey AS doc, 3::BIGINT AS difference FROM lineitem WHERE l_orderkey % 25 = 0 GROUP BY 1",
    import_classify: """WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'CODE_LIST' WHEN p_partkey % 13 = 0 THEN 'DIRECT' WHEN p_partkey % 19 = 0 THEN 'CODE_LIST' WHEN p_partkey % 6 = 0 AND p_partkey % 3 = 0 THEN 'CONSTANT'
  WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'CONDITIONAL' WHEN p_partkey % 3 <> 0 THEN 'DIRECT' ELSE 'TODO' END AS kind FROM part)
SELECT kind, CASE WHEN k % 17 = 0 THEN 'no target' WHEN kind = 'TODO' THEN 'no evidence of a rule' WHEN kind <> 'CONSTANT' AND k % 3 = 0 THEN 'source is no element' WHEN kind = 'CODE_LIST' AND k % 19 <> 0 THEN 'no code list'
  WHEN kind = 'CONDITIONAL' AND k % 5 <> 0 THEN 'condition is prose' ELSE '-' END AS review, count(*) AS n FROM r GROUP BY ALL""",
    delta_merge: "SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 <> 0 THEN 0 ELSE 1 END AS part, CASE WHEN p_partkey % 5 = 0 THEN 'partner rule' ELSE p_name END AS body, CASE WHEN p_partkey % 5 = 0 THEN 'partner' ELSE 'base' END AS origin FROM part WHERE p_partkey % 10 <> 0 AND (p_partkey % 3 <> 0 OR p_partkey % 5 = 0)",
    overlay_apply: """WITH b AS (SELECT 'S' || (p_partkey // 2) AS segment, CASE WHEN p_partkey % 4 = 0 THEN 'N1' END AS loop FROM part WHERE p_partkey % 2 = 0), o AS (SELECT 'S' || (p_partkey // 2) AS segment, p_partkey % 5 = 0 AS other, CASE WHEN p_partkey % 3 = 0 THEN 'N1' ELSE 'PO1' END AS loop FROM part)
SELECT 'base' AS origin, segment, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'partner', segment, count(*) FROM o WHERE other OR NOT EXISTS (SELECT 1 FROM b WHERE b.segment = o.segment AND (b.loop IS NULL OR b.loop = o.loop)) GROUP BY 2""",
    draft_prefill: "SELECT count(*) FILTER (p_partkey % 4 <> 0) AS required, count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 5 <> 0) AS prefilled, count(*) FILTER (p_partkey % 5 = 0) AS todo, round(count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 5 <> 0) / count(*) FILTER (p_partkey % 4 <> 0), 6) AS prefill FROM part",
    batch_totals: "SELECT count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 5 <> 0) AS pass, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 5 = 0) AS warning, count(*) FILTER (p_partkey % 7 = 0) AS fail, 0::BIGINT AS error, 1 AS exit_code FROM part",
    envelope_capture: _TEXT + "SELECT 'F' || f AS file_id, 'SENDER' AS sender, 'RECEIVER' AS receiver, lpad(f::VARCHAR, 9, '0') AS control, 'P' AS usage, 'PO' AS group_code, '004010' AS version, '850' AS first_set FROM n GROUP BY f",
    first_transaction: _TEXT + "SELECT 'F' || f AS file_id, '850' AS set_code, (count(*) - 1)::INTEGER AS further, arg_min(size, k) + 2 AS n_segments FROM body GROUP BY f",
    split_issues: _TEXT + """, g AS (SELECT f, count(*) AS docs FROM n GROUP BY f)
SELECT 'F' || f AS file_id, 'nested_st' AS issue, docs AS n FROM g WHERE f % 13 = 0 UNION ALL SELECT 'F' || f, 'orphan_se', 1 FROM g WHERE f % 11 = 0 UNION ALL SELECT 'F' || f, 'unknown_set', docs FROM g WHERE f % 17 = 0 AND f % 13 <> 0""",
    mixed_sets: "SELECT DISTINCT 'F' || (o_orderkey // 20) AS file_id, '855' AS others FROM orders WHERE o_orderkey % 10 = 0",
    scrub_round_trip: "SELECT DISTINCT 'F' || (o_orderkey // 20) AS file_id, true AS same_length, true AS same_rest, false AS unmasked, false AS names_sender FROM orders",
    line_surplus: _BASE + """SELECT doc, row_id, line_ix, 'FAIL' AS status, 'count_mismatch' AS category, 'lines[' || line_ix || '].' || field AS target FROM (
  SELECT l.k AS doc, unnest(['R-20', 'R-21', 'R-22', 'R-23', 'R-24', 'R-25']) AS row_id, unnest(['line_no', 'qty', 'uom', 'price', 'part', 'text']) AS field, ix AS line_ix, part
  FROM l JOIN o USING (k) WHERE l.k % 29 = 0 AND l.k % 7 <> 0 AND ix = lines - 1) WHERE row_id <> 'R-24' OR part % 5 <> 0""",
    xml_fold: f"SELECT * FROM ({_LAYOUT.format(po='po', count='001')}) WHERE file_id::BIGINT % 9 <> 0",
    xml_guard: "SELECT c_custkey, c_custkey % 4 <> 3 AS refused FROM customer",
    format_detection: "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' WHEN 2 THEN 'control' ELSE 'flat' END AS format FROM customer",
    outbound_header: _BASE + """SELECT * FROM (SELECT unnest(['O-02', 'O-04', 'O-06']) AS row_id, 'PASS' AS status, '-' AS category, count(*) AS n FROM o
UNION ALL SELECT 'O-01', 'NOT TESTED', '-', count(*) FROM o WHERE k % 19 = 0 UNION ALL SELECT 'O-01', 'FAIL', 'value_mismatch', count(*) FROM o WHERE k % 19 <> 0 AND k % 11 = 0 UNION ALL SELECT 'O-01', 'PASS', '-', count(*) FROM o WHERE k % 19 <> 0 AND k % 11 <> 0
UNION ALL SELECT 'O-03', 'FAIL', 'source_data', count(*) FROM o WHERE k % 37 = 0 UNION ALL SELECT 'O-03', 'PASS', '-', count(*) FROM o WHERE k % 37 <> 0 UNION ALL SELECT 'O-05', 'PASS', '-', count(*) FROM o WHERE k % 3 = 0 UNION ALL SELECT 'O-05', 'NOT TESTED', '-', count(*) FROM o WHERE k % 3 <> 0
UNION ALL SELECT 'O-07', CASE WHEN (k % 31 = 0) <> (k % 7 = 0 AND lines > 0) OR (k % 31 = 0 AND k % 7 = 0 AND lines > 0) THEN 'FAIL' ELSE 'PASS' END, CASE WHEN (k % 31 = 0) <> (k % 7 = 0 AND lines > 0) OR (k % 31 = 0 AND k % 7 = 0 AND lines > 0) THEN 'count_mismatch' ELSE '-' END, count(*) FROM o GROUP BY 2, 3) WHERE n > 0""",
    outbound_lines: _BASE + """, x AS (SELECT l.*, l.k % 7 = 0 AND ix = lines - 1 AS dropped FROM l JOIN o USING (k))
SELECT * FROM (SELECT unnest(['O-10', 'O-11', 'O-12']) AS row_id, 'FAIL' AS status, 'count_mismatch' AS category, count(*) AS n FROM x WHERE dropped UNION ALL SELECT unnest(['O-10', 'O-12']), 'PASS', '-', count(*) FROM x WHERE NOT dropped
UNION ALL SELECT 'O-11', CASE WHEN k % 17 = 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN k % 17 = 0 THEN 'source_data' ELSE '-' END, count(*) FROM x WHERE NOT dropped GROUP BY 2, 3) WHERE n > 0""",
    outbound_unmapped_source: _BASE + """SELECT * FROM (SELECT unnest(['order.purpose', 'order.drop_ship', 'order.record_type', 'order.due_date', 'order.release', 'ship_to.name', 'ship_to.city', 'summary.line_count', 'summary.total']) AS norm_path, count(*) AS n FROM o
UNION ALL SELECT 'order.extra', count(*) FROM o WHERE k % 41 = 0 UNION ALL SELECT 'ship_to.id', count(*) FROM o WHERE k % 5 <> 0 UNION ALL SELECT unnest(['lines[].line_no', 'lines[].text']), count(*) FROM l JOIN o USING (k) WHERE NOT (k % 7 = 0 AND ix = lines - 1)
UNION ALL SELECT 'lines[].part', count(*) FROM l JOIN o USING (k) WHERE NOT (k % 7 = 0 AND ix = lines - 1) AND part % 5 <> 0) WHERE n > 0""",
    outbound_unmapped_target: """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT * FROM (SELECT unnest(['DTM', 'DTM', 'N4', 'AMT', 'AMT']) AS seg_id, unnest([1, 2, 1, 1, 2])::INTEGER AS elem_ix, count(*) AS n FROM o UNION ALL SELECT 'N1', unnest([1, 2]), 2 * count(*) FROM o UNION ALL SELECT 'N1', unnest([3, 4]), count(*) FROM o
UNION ALL SELECT 'ITD', unnest([1, 2]), count(*) FROM o WHERE k % 43 = 0 UNION ALL SELECT 'SAC', 2, count(*) FROM o WHERE k % 3 = 0 UNION ALL SELECT 'PO1', unnest([1, 6, 7]), count(*) FROM lineitem UNION ALL SELECT 'PID', unnest([1, 5]), count(*) FROM lineitem) WHERE n > 0""",
    hl_line_scope: _BASE + """SELECT l.k AS doc, ix AS line_ix, qty::VARCHAR AS "SN102", CASE WHEN NOT bad THEN 'PO' || l.k END AS "PRF01", CASE WHEN NOT bad THEN 'CTN25' END AS "TD101" FROM (SELECT *, k % 10 = 0 AND ix = count(*) OVER (PARTITION BY k) - 1 AS bad FROM l) l""",
    spec_errors: """WITH r AS (SELECT p_partkey AS k, 'P' || CASE WHEN p_partkey % 29 = 1 THEN p_partkey - 1 ELSE p_partkey END AS row_id FROM part), d AS (SELECT row_id FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT DISTINCT * FROM (SELECT row_id, 'duplicate_row_id' AS error FROM d UNION ALL SELECT row_id, 'bad_source' FROM r WHERE k % 7 = 0 UNION ALL SELECT row_id, 'no_source' FROM r WHERE k % 7 <> 0 AND k % 5 = 0 AND k % 17 <> 0 UNION ALL SELECT row_id, 'bad_context' FROM r WHERE k % 11 = 0
UNION ALL SELECT row_id, 'no_target' FROM r WHERE k % 13 = 0 UNION ALL SELECT row_id, 'unknown_kind' FROM r WHERE k % 17 = 0 UNION ALL SELECT row_id, 'unknown_code_list' FROM r WHERE k % 3 = 0 AND k % 2 <> 0 UNION ALL SELECT row_id, 'bad_data_type' FROM r WHERE k % 19 = 0 UNION ALL SELECT row_id, 'bad_format' FROM r WHERE k % 23 = 0
UNION ALL SELECT 'UOM:N' || (n_nationkey % 20), 'duplicate_code' FROM nation GROUP BY n_nationkey % 20 HAVING count(*) > 1)""",
    spec_delta: "SELECT 'a.f' || p_partkey AS row_id, CASE WHEN p_partkey % 5 = 0 THEN 'TODO' WHEN p_partkey % 17 = 0 THEN 'GUESS' WHEN p_partkey % 3 = 0 THEN 'CODE_LIST' ELSE 'DIRECT' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'partner' ELSE 'base' END AS origin FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 10 <> 0",
    spec_from_rows: _BASE + """SELECT * FROM (SELECT 'T-1' AS row_id, CASE WHEN k % 19 = 0 THEN 'NOT TESTED' WHEN k % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN k % 19 <> 0 AND k % 11 = 0 THEN 'value_mismatch' ELSE '-' END AS category, count(*) AS n FROM o GROUP BY 2, 3
UNION ALL SELECT 'T-2', CASE WHEN type = 'NE' THEN 'FAIL' ELSE 'PASS' END, CASE WHEN type = 'NE' THEN 'source_data' ELSE '-' END, count(*) FROM o GROUP BY 2, 3)""",
    flat_fold: _LAYOUT.format(po="po_number", count="count"),
    fixed_width_fold: _LAYOUT.format(po="po", count="001"),
    delimited_fold: _LAYOUT.format(po="po", count="001"),
    json_array_documents: "SELECT o_orderkey // 10 AS file_id, (row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) - 1)::INTEGER AS doc_ix, o_custkey::VARCHAR AS vendor FROM orders WHERE o_orderkey % 23 <> 0",
    x12_dates: "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderdate::DATE END AS day FROM orders",
    x12_decimals: "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN (p_size / 100.0)::DECIMAL(18,2) END AS amount, length(CASE WHEN p_partkey % 3 = 0 THEN p_size || 'x' ELSE p_size::VARCHAR END) <> 2 AS wrong_length FROM part",
}


def queries():
    out = {f.__name__: f for f in (*QUERIES, *partner_queries.QUERIES)}
    out.update({name: _rule(row_id, kind) for name, (row_id, kind, _) in RULES.items()})
    return out


def oracle_sql():
    out = {f.__name__: sql for f, sql in (QUERIES | partner_queries.QUERIES).items() if sql}
    out.update({name: sql for name, (_, _, sql) in RULES.items()})
    return out
