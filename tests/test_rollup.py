"""Verdicts cover all findings of a document, by SQL of their own."""

import duckdb

from edigrain import queries as engine

SF = "/root/testdata/sf0.001"


def _sql(sql):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(sql).fetchall()


def test_verdicts_cover_all_findings(spark):
    # documents with a sound envelope and an output
    want = _sql(engine._BASE + f""", x AS (SELECT l.k, count(*) FILTER (l.k % 7 = 0 AND ix = lines - 1) * 5 + count(*) FILTER (l.k % 7 = 0 AND ix = lines - 1 AND part % 5 <> 0)
  + count(*) FILTER (l.k % 17 = 0 AND NOT (l.k % 7 = 0 AND ix = lines - 1)) AS bad FROM l JOIN o USING (k) GROUP BY 1),
v AS (SELECT o.k, {engine._HEADER_FAIL.replace("k %", "o.k %")} + coalesce(bad, 0) + (o.k % 19 = 0)::INT + (o.k % 7 = 0 AND lines > 0)::INT AS fail,
  1 + (o.k % 31 = 0)::INT + (o.k % 41 = 0)::INT + (o.k % 43 = 0)::INT + (o.k % 3 = 0)::INT AS warning FROM o LEFT JOIN x ON x.k = o.k)
SELECT k, fail, warning, CASE WHEN fail > 0 THEN 'FAIL' ELSE 'WARNING' END FROM v WHERE k % 13 <> 0""")
    got = engine.status_rollup(spark, SF).where("doc % 13 <> 0 and doc % 23 <> 0").select("doc", "fail", "warning", "result").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_root_causes_cover_all_findings(spark):
    got = {r.category for r in engine.category_rollup(spark, SF).collect()}
    assert got >= {"missing_output", "code_translation", "source_data", "count_mismatch", "unmapped_source", "unmapped_target", "value_mismatch", "format"}
