"""Queries that use whole tables, by SQL of their own."""

import duckdb

from edigrain import queries as engine

SF = "/root/testdata/sf0.001"


def _same(df, sql):
    con = duckdb.connect()
    for t in ("orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.sql(sql).fetchall())


def test_tail_of_every_file(spark):
    _same(engine.raw_tail(spark, SF), "SELECT DISTINCT 'F' || (o_orderkey // 20), 'LEFT OVER F' || (o_orderkey // 20) FROM orders WHERE (o_orderkey // 20) % 3 = 0")


def test_overlay_of_all_parts(spark):
    _same(engine.overlay_apply(spark, SF), """WITH b AS (SELECT 'S' || (p_partkey // 2) AS segment, CASE WHEN p_partkey % 4 = 0 THEN 'N1' END AS loop FROM part WHERE p_partkey % 2 = 0),
o AS (SELECT 'S' || (p_partkey // 2) AS segment, p_partkey % 5 = 0 AS other, CASE WHEN p_partkey % 3 = 0 THEN 'N1' ELSE 'PO1' END AS loop FROM part)
SELECT 'base', segment, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'partner', segment, count(*) FROM o WHERE other OR NOT EXISTS (SELECT 1 FROM b WHERE b.segment = o.segment AND (b.loop IS NULL OR b.loop = o.loop)) GROUP BY 2""")
