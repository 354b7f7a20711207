"""Queries of partner tables and guides, with the SQL that recomputes each answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import drafts
from .plans.transactions import DEFINITIONS
from .sources import grids, guides


def _cells(*values) -> Column:
    return F.array(*((v if isinstance(v, Column) else F.lit(v)).cast("string") for v in values))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping tables of 25 parts each, in three layouts, and files of numbers."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr("p_partkey div 25").alias("f"))
    k, layout = F.col("p_partkey"), F.col("f") % 4

    def by_layout(*options: Column) -> Column:
        return F.when(layout == 0, options[0]).when(layout == 1, options[1]).when(layout == 2, options[2]).otherwise(options[3])

    top = by_layout(_cells("Target Field", "X12 Element", "Business Rule", "Rule", "Notes", " ", "Notes"), _cells("no", "FIELD-NAME", "Source", "Default", "Lookup"), _cells("Element", "Comment"), _cells("1", "2,000.5"))
    heads = parts.select("f").distinct()
    data = by_layout(
        _cells(F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("T"), k)), F.when(k % 3 == 0, "prose").otherwise("BEG03"), F.when(k % 5 == 0, 'If REF01 = "IA"').otherwise(""), F.when(k % 2 == 0, "Move").otherwise(""), "n", F.when(k % 7 == 0, "x").otherwise(""), ""),
        _cells(k, F.concat(F.lit(" F"), k), F.when(k % 2 == 0, "PO102").otherwise(""), F.when(k % 3 == 0, "X").otherwise(""), F.when(k % 5 == 0, "UOM")),
        _cells("BEG03", F.when(k % 2 == 0, "c").otherwise("")), _cells(k, k),
    )
    rows = heads.select("f", F.lit(0).alias("row_ix"), _cells("Mapping guide", "").alias("cells")).union(heads.select("f", F.lit(1), top)).union(parts.select("f", (k + 2).cast("int"), data))
    return rows.select(F.col("f").cast("string").alias("file_id"), "row_ix", "cells")


def import_rows(spark, sf_dir):
    rows = grids.mapping_rows(_grid(spark, sf_dir))
    return rows.select("file_id", "row_id", F.coalesce("target", F.lit("-")).alias("target"), "kind", F.coalesce("review", F.lit("-")).alias("review"))


def import_unmapped(spark, sf_dir):
    return grids.unmapped_columns(_grid(spark, sf_dir))


def import_errors(spark, sf_dir):
    return grids.table_errors(_grid(spark, sf_dir))


def import_ratio(spark, sf_dir):
    return grids.auto_classified(grids.mapping_rows(_grid(spark, sf_dir)))


def import_overrides(spark, sf_dir):
    """The comment column named as target: files that lack it say so."""
    grid, named = _grid(spark, sf_dir), {"target": "comment"}
    good = grids.mapping_rows(grid, named).where("target is not null").groupBy("file_id").agg(F.count("*").alias("n"))
    bad = grids.table_errors(grid, named).where("error = 'unknown_override'").select("file_id", F.lit(-1).cast("long").alias("n"))
    return good.unionByName(bad)


def import_lookups(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    top = n.select("n_regionkey").distinct().select("n_regionkey", F.lit(-1).alias("row_ix"), _cells("Desc", "Table", "From", "To").alias("cells"))
    rows = top.union(n.select("n_regionkey", F.col("n_nationkey").cast("int"), _cells("d", F.when(F.col("n_nationkey") % 5 != 0, F.lit("NATION")), F.col("n_nationkey"), F.col("n_name"))))
    return grids.lookup_rows(rows.select(F.col("n_regionkey").cast("string").alias("file_id"), "row_ix", "cells"))


def _tabular_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guides of 25 parts each: an index page, and a page with a segment block a part.
    Lines of half the pages are running heads, so texts name their part."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.expr("p_partkey div 25").alias("f"))
    k = F.col("p_partkey")
    seg, pos = F.concat(F.lit("Q"), 10 + k % 90), (100 + k % 900).cast("string")
    some = lambda on, text: F.when(on, text if isinstance(text, Column) else F.lit(text))
    page = F.concat_ws(
        "\n", F.lit("\fGuide of a partner"), some(k % 13 != 0, seg), F.concat(F.lit("Segment: "), "p_name"), F.concat(F.lit("Position: "), pos), some(k % 3 == 0, "Loop: N1 Optional"),
        F.when(k % 7 == 0, "Usage: Perhaps").when(k % 2 == 0, "Usage: Mandatory").otherwise("Usage: Optional"), F.concat(F.lit("Notes: read this\nin full "), k), F.lit("Data Element Summary"),
        F.concat(seg, F.lit("01 128 Qualifier M ID 2/3 M\nAA First "), k), some(k % 3 == 0, "BB Second\nof two"), some(k % 11 == 0, F.concat(seg, F.lit("09 torn"))), some(k % 17 == 0, "REF02 127 Reference X AN 1/30 M"),
        F.concat(seg, F.lit("02 127 Value O AN 1/30"), F.when(k % 4 == 0, " M").otherwise("")), F.concat(F.lit("Page "), k),
    )
    row = F.concat(F.lit("1 "), pos, F.lit(" "), seg, F.lit(" Name of it "), F.when(k % 2 == 0, "M").otherwise("O"), F.lit(" 1"))
    files = parts.groupBy("f").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), page.alias("page"), F.when(k % 5 != 0, row).alias("row")))).alias("p"))
    join = lambda name, by: F.array_join(F.transform("p", lambda x: x[name]), by)
    text = F.concat(F.lit("Guide of a partner\nHeading:\n"), join("row", "\n"), F.lit("\nPage 1"), join("page", ""))
    return files.select(F.col("f").cast("string").alias("file_id"), text.alias("text"))


def _guide(spark: SparkSession, sf_dir: str) -> guides.Guide:
    return guides.Guide(guides.guide_lines(_tabular_files(spark, sf_dir)))


def _terse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terse guides of 25 parts each: index rows of segments, and a page for each."""
    k, seg = F.col("p_partkey"), F.concat(F.lit("Q"), 10 + F.col("p_partkey") % 90)
    usage = F.when(k % 2 == 0, "M").when(k % 3 == 0, "C").otherwise("O")
    row = F.concat(seg, F.lit(" Name of it "), usage, F.lit(" >1"), F.when(k % 4 == 0, " N1 / 3").otherwise(""))
    page = F.concat_ws(
        "\n", F.concat(F.lit("\fSegment "), seg, F.when(k % 2 == 0, " – ").otherwise(" - "), "p_name"), F.lit("Level Heading"), F.concat(F.lit("Max. Use "), k % 7), F.lit("Purpose to say so\nat length"),
        F.concat(F.lit("Comments see part "), k), F.when(k % 3 == 0, "and ask"), F.lit("Example: Q1*A*B\nID ELEMENT NAME FEATURES COMMENTS"),
        F.concat(seg, F.lit("01 Qualifier of it M ID 2/3 "), F.when(k % 5 == 0, F.concat(F.lit('"AA" = First '), k, F.lit(" BB – Second"))).otherwise("as agreed")), F.when(k % 6 == 0, "C1 - third of all\nwhich is prose"),
        F.concat(seg, F.lit("02 Not this N")), F.when(k % 7 == 0, F.concat(seg, F.lit("09 torn"))), F.when(k % 11 == 0, "REF02 Reference O AN 1/30"), F.lit("DD = no list of codes"), F.concat(F.lit("- "), k, F.lit(" -")),
    )
    files = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.expr("p_partkey div 25").alias("f")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), page.alias("page"), F.when(k % 13 != 0, row).alias("row")))).alias("p"))
    join = lambda name, by: F.array_join(F.transform("p", lambda x: x[name]), by)
    text = F.concat(F.lit("Data Segment Sequence for the Heading Area\nSeg. Req. Max\nID Use\n"), join("row", "\n"), F.lit("\nGLOSSARY M 1\nM = Mandatory"), join("page", ""))
    return files.select(F.concat(F.lit("t"), "f").alias("file_id"), text.alias("text"))


def guide_terse(spark, sf_dir):
    """Segments of terse guides, joined with their index; elements and codes counted."""
    g = guides.TerseGuide(guides.guide_lines(_terse_files(spark, sf_dir)))
    els = g.elements().groupBy("file_id", "block").agg(F.count("elem_ix").alias("n_elements"), F.count_if(F.col("usage") == "not_used").alias("n_not_used"))
    codes = g.codes().groupBy("file_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("=", "code", "name").alias("t")))), lambda x: x["t"]), "|").alias("codes"))
    met = g.segments().join(els, ["file_id", "block"], "left").join(codes, ["file_id", "block"], "left")
    return met.select("file_id", "seg_id", "name", "max_use", "loop", "usage", "notes", "n_elements", "n_not_used", F.coalesce("codes", F.lit("")).alias("codes"))


def guide_families(spark, sf_dir):
    """Guides of all families, and of none, in one reading: coverage and reviews."""
    every = _terse_files(spark, sf_dir).unionByName(_templated_files(spark, sf_dir)).unionByName(_tabular_files(spark, sf_dir).withColumn("file_id", F.concat(F.lit("b"), "file_id")))
    every = every.unionByName(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey").alias("file_id"), F.concat(F.lit("Segment: "), "n_name").alias("text")))
    g = guides.AnyGuides(every)
    seen = g.reviews().groupBy("file_id").agg(F.count("*").alias("n_reviews"))
    return g.families.join(g.coverage().drop("family"), "file_id", "left").join(seen, "file_id", "left").select("file_id", F.coalesce("family", F.lit("-")).alias("family"), F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("confident", F.lit(0)).alias("confident"), F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"))


def _templated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templated guides of 25 parts each, with boxes apart from their names."""
    k, seg = F.col("p_partkey"), F.concat(F.lit("Q"), 10 + F.col("p_partkey") % 90)
    box = F.concat(F.lit("Pos: "), k, F.lit(" Max: 1"))
    block = F.concat_ws(
        "\n", F.when(k % 3 == 0, F.concat(box, F.lit("\n\n"), seg, F.lit(" Name of it"))).otherwise(F.concat(seg, F.lit(" Name of it "), box)), F.when(k % 5 == 0, "Loop: N1 Elements: 2").otherwise("Loop: N/A"),
        F.when(k % 2 == 0, "User Option (Usage): Must use").otherwise("User Option (Usage): Used"), F.lit("Element Summary:"), F.concat(seg, F.lit("01 128 Qualifier M ID 2/3 "), F.when(k % 4 == 0, "Must use").otherwise("Not used")),
        F.lit("Code List Summary\nCode Name\nAA First"), F.when(k % 7 == 0, "\nBB after a blank line"), F.when(k % 11 == 0, F.concat(seg, F.lit("02 torn"))),
    )
    files = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.expr("p_partkey div 25").alias("f")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), block.alias("t")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "\n")
    return files.select(F.col("f").cast("string").alias("file_id"), text.alias("text"))


def guide_templated(spark, sf_dir):
    """Rules of templated guides."""
    g = guides.TemplatedGuide(guides.guide_lines(_templated_files(spark, sf_dir), blank=True))
    n = g.codes().groupBy("file_id").agg(F.count("*").alias("n_codes"))
    return g.presence_rules().groupBy("file_id").agg(F.count("*").alias("n_rules"), F.count_if(F.col("loop") == "N1").alias("n_in_n1")).join(n, "file_id").join(g.coverage(), "file_id")


def guide_segments(spark, sf_dir):
    return _guide(spark, sf_dir).segments().select("file_id", "seg_id", "name", "pos", "loop", "usage", "notes")


def guide_elements(spark, sf_dir):
    return _guide(spark, sf_dir).elements().select("file_id", "seg_id", "ref", F.coalesce("elem_ix", F.lit(-1)).alias("elem_ix"), "type", "usage")


def guide_codes(spark, sf_dir):
    return _guide(spark, sf_dir).codes().select("file_id", "ref", "code", "name")


def guide_coverage(spark, sf_dir):
    return _guide(spark, sf_dir).coverage()


def guide_cross_check(spark, sf_dir):
    return _guide(spark, sf_dir).cross_check()


def guide_overlay(spark, sf_dir):
    return _guide(spark, sf_dir).presence_rules().select("file_id", "segment", "elem_ix", F.size("codes").alias("n_codes"), "loop")


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of 25 parts each."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    source = F.concat(F.element_at(F.array(*map(F.lit, ("BEG", "N1", "PO1", "REF"))), (k % 4 + 1).cast("int")), F.lit("0"), k % 3 + 1)
    kind = F.when(k % 13 == 0, "TODO").when(k % 7 == 0, "LOOP_COUNT").when(k % 3 == 0, "CODE_LIST").otherwise("DIRECT")
    return parts.select(
        F.expr("p_partkey div 25").alias("draft"), k.alias("place"), F.concat(F.lit("t"), k).alias("target"), kind.alias("kind"), source.alias("source"), F.when(k % 11 == 0, "N1[ST]").alias("context"),
        F.when(k % 10 == 0, "EXISTS(PO107) AND BEG02 = 'N104'").alias("condition"), F.when(k % 3 == 0, F.concat(F.lit("L"), k % 2)).alias("code_list"),
    )


def _usage(spark, sf_dir) -> DataFrame:
    own = _drafts(spark, sf_dir).select("draft").distinct()
    return own.select("draft", F.lit("BEG").alias("seg_id"), F.lit(3).alias("elem_ix"), F.lit("not_used").alias("usage")).union(own.where("draft % 2 = 0").select("draft", F.lit("PO1"), F.lit(7), F.lit("must_use")))


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lists of five codes, and guides that name other codes for BEG01 or REF01."""
    ids = spark.range(5).select(F.concat(F.lit("c"), "id").alias("source"), F.concat(F.lit("t"), "id").alias("target"))
    codes = ids.select(F.lit("L0").alias("code_list"), "*").union(ids.select(F.lit("L1"), "*"))
    own = _drafts(spark, sf_dir).select("draft").distinct()
    said = own.where("draft % 3 = 0").select("draft", F.lit("BEG01").alias("ref"), F.explode(F.array(*map(F.lit, ("c1", "c3", "c9")))).alias("code"))
    said = said.union(own.where("draft % 3 = 1").select("draft", F.lit("REF01"), F.explode(F.array(*map(F.lit, ("c0", "c8"))))))
    return codes, said.withColumn("name", F.concat(F.lit("name of "), "code"))


def draft_rows(spark, sf_dir):
    return drafts.numbered(_drafts(spark, sf_dir), "place").select("draft", "row_id", "target")


def draft_unmapped(spark, sf_dir):
    names = spark.createDataFrame([(s, i, f"{s} {i}") for s, n in (("BEG", 4), ("N1", 4), ("PO1", 7), ("REF", 3), ("ZZZ", 2)) for i in range(1, n + 1)], "seg_id string, elem_ix int, name string")
    elements = drafts.source_elements(drafts.segment_walk(spark, DEFINITIONS["850"]), names)
    return drafts.unmapped_elements(elements, _drafts(spark, sf_dir), _usage(spark, sf_dir)).drop("place")


def draft_unused_sources(spark, sf_dir):
    return drafts.unused_sources(_drafts(spark, sf_dir), _usage(spark, sf_dir))


def draft_code_lists(spark, sf_dir):
    return drafts.partner_lists(_drafts(spark, sf_dir), *_lists(spark, sf_dir))


def draft_untranslated(spark, sf_dir):
    return drafts.untranslated(_drafts(spark, sf_dir), *_lists(spark, sf_dir))


_IMPORT = """WITH p AS (SELECT p_partkey AS k, p_partkey // 25 AS f, (p_partkey // 25) % 4 AS t, row_number() OVER (PARTITION BY p_partkey // 25 ORDER BY p_partkey) AS n FROM part),
r AS (SELECT f::VARCHAR AS file_id, 'IMP-' || lpad(n::VARCHAR, 3, '0') AS row_id, CASE WHEN t = 0 AND k % 17 <> 0 THEN 'T' || k WHEN t = 1 THEN 'F' || k ELSE '-' END AS target,
  CASE t WHEN 0 THEN CASE WHEN k % 2 <> 0 AND k % 5 = 0 THEN 'CONDITIONAL' ELSE 'DIRECT' END WHEN 2 THEN 'DIRECT' ELSE CASE WHEN k % 5 = 0 THEN 'CODE_LIST' WHEN k % 3 = 0 AND k % 2 <> 0 THEN 'CONSTANT' WHEN k % 2 = 0 THEN 'DIRECT' ELSE 'TODO' END END AS kind,
  CASE t WHEN 0 THEN CASE WHEN k % 17 = 0 THEN 'no target' WHEN k % 3 = 0 THEN 'source is no element' ELSE '-' END WHEN 2 THEN 'no target'
    ELSE CASE WHEN k % 2 = 0 THEN '-' WHEN k % 5 = 0 THEN 'source is no element' WHEN k % 3 = 0 THEN '-' ELSE 'no evidence of a rule' END END AS review FROM p WHERE t <> 3)
"""

_GUIDE = """WITH p AS (SELECT p_partkey AS k, (p_partkey // 25)::VARCHAR AS file_id, 'Q' || (10 + p_partkey % 90) AS seg, (100 + p_partkey % 900)::VARCHAR AS pos, p_name,
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'must_use' ELSE 'used' END AS usage, CASE WHEN p_partkey % 3 = 0 THEN 'N1' ELSE '' END AS loop FROM part),
b AS (SELECT * FROM p WHERE k % 13 <> 0)
"""

_DRAFT = """WITH d AS (SELECT p_partkey // 25 AS draft, p_partkey AS k, 't' || p_partkey AS target, CASE WHEN p_partkey % 13 = 0 THEN 'TODO' WHEN p_partkey % 7 = 0 THEN 'LOOP_COUNT' WHEN p_partkey % 3 = 0 THEN 'CODE_LIST' ELSE 'DIRECT' END AS kind,
  ['BEG', 'N1', 'PO1', 'REF'][(p_partkey % 4 + 1)::INT] AS seg, (p_partkey % 3 + 1)::INTEGER AS ix FROM part),
u AS (SELECT draft, 'L' || (k % 2) AS code_list, seg || '0' || ix AS ref FROM d WHERE kind = 'CODE_LIST'),
g AS (SELECT DISTINCT draft, 'BEG01' AS ref, unnest(['c1', 'c3', 'c9']) AS code FROM d WHERE draft % 3 = 0 UNION SELECT DISTINCT draft, 'REF01', unnest(['c0', 'c8']) FROM d WHERE draft % 3 = 1),
a AS (SELECT DISTINCT draft, code_list, code FROM u JOIN g USING (draft, ref))
"""

_TERSE = """
WITH p AS (SELECT p_partkey AS k, p_name, 't' || (p_partkey // 25) AS file_id, 'Q' || (10 + p_partkey % 90) AS seg FROM part),
t AS (SELECT *, CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'must_use' ELSE 'used' END END AS usage, CASE WHEN k % 13 <> 0 AND k % 4 = 0 THEN 'N1' END AS loop FROM p)
"""

QUERIES = {
    import_rows: _IMPORT + "SELECT * FROM r",
    import_unmapped: _IMPORT + """SELECT f::VARCHAR AS file_id, unnest(['Notes']) AS header, count(*) AS n FROM p WHERE t = 0 GROUP BY f UNION ALL SELECT f::VARCHAR, 'column_6', count(*) FROM p WHERE t = 0 AND k % 7 = 0 GROUP BY f
UNION ALL SELECT f::VARCHAR, 'no', count(*) FROM p WHERE t = 1 GROUP BY f UNION ALL SELECT f::VARCHAR, 'Comment', count(*) FROM p WHERE t = 2 AND k % 2 = 0 GROUP BY f""",
    import_errors: "SELECT DISTINCT (p_partkey // 25)::VARCHAR AS file_id, CASE WHEN (p_partkey // 25) % 4 = 2 THEN 'no_target_column' ELSE 'no_header' END AS error, '' AS what FROM part WHERE (p_partkey // 25) % 4 IN (2, 3)",
    import_ratio: _IMPORT + "SELECT file_id, count(*) AS n_rows, round(avg((review = '-')::INT), 6) AS ratio FROM r GROUP BY 1",
    import_overrides: _IMPORT + "SELECT f::VARCHAR AS file_id, count(*) AS n FROM p WHERE t = 2 AND k % 2 = 0 GROUP BY f UNION ALL SELECT DISTINCT f::VARCHAR, -1 FROM p WHERE t IN (0, 1)",
    draft_rows: "SELECT p_partkey // 25 AS draft, 'D-' || lpad((row_number() OVER (PARTITION BY p_partkey // 25 ORDER BY p_partkey))::VARCHAR, 3, '0') AS row_id, 't' || p_partkey AS target FROM part",
    draft_unmapped: _DRAFT + """, e AS (SELECT 'BEG' AS seg_id, unnest(range(1, 5))::INTEGER AS elem_ix, '' AS context UNION ALL SELECT 'N1', unnest(range(1, 5)), 'N1' UNION ALL SELECT 'PO1', unnest(range(1, 8)), 'PO1' UNION ALL SELECT 'REF', unnest(range(1, 4)), ''),
r AS (SELECT draft, seg, ix FROM d WHERE kind NOT IN ('TODO', 'LOOP_COUNT') UNION SELECT draft, 'N1', 1 FROM d WHERE kind <> 'TODO' AND k % 11 = 0 UNION SELECT draft, unnest(['PO1', 'BEG']), unnest([7, 2]) FROM d WHERE kind <> 'TODO' AND k % 10 = 0)
SELECT draft, seg_id, elem_ix, context, seg_id || ' ' || elem_ix AS name, CASE WHEN seg_id = 'PO1' AND elem_ix = 7 AND draft % 2 = 0 THEN 'must_use' ELSE '' END AS usage FROM (SELECT DISTINCT draft FROM d) d, e
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.draft = d.draft AND seg = seg_id AND ix = elem_ix) AND NOT (seg_id = 'BEG' AND elem_ix = 3)""",
    draft_unused_sources: _DRAFT + "SELECT draft, target, 'BEG03' AS source FROM d WHERE seg = 'BEG' AND ix = 3 AND kind <> 'TODO'",
    draft_code_lists: _DRAFT + """SELECT draft, code_list, 'c' || i AS source, 't' || i AS target FROM (SELECT DISTINCT draft, code_list FROM u) x, range(5) n(i)
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.draft = x.draft AND a.code_list = x.code_list) OR EXISTS (SELECT 1 FROM a WHERE a.draft = x.draft AND a.code_list = x.code_list AND code = 'c' || i)""",
    draft_untranslated: _DRAFT + "SELECT draft, code_list, code, 'name of ' || code AS name FROM a WHERE code IN ('c8', 'c9')",
    guide_templated: """WITH c AS (SELECT (p_partkey // 25)::VARCHAR AS file_id, count(*) FILTER (p_partkey % 2 = 0) + count(*) FILTER (p_partkey % 4 = 0) AS n_rules, count(*) FILTER (p_partkey % 10 = 0) + count(*) FILTER (p_partkey % 20 = 0) AS n_in_n1,
  count(*) AS n_codes, 3 * count(*) + count(*) FILTER (p_partkey % 11 = 0) AS detected, 3 * count(*) AS confident FROM part GROUP BY 1)
SELECT *, round(confident / detected, 6) AS ratio FROM c WHERE n_rules > 0""",
    guide_terse: _TERSE + """SELECT file_id, seg AS seg_id, p_name AS name, (k % 7)::VARCHAR AS max_use, coalesce(loop, '') AS loop, coalesce(usage, '') AS usage, 'see part ' || k || CASE WHEN k % 3 = 0 THEN ' and ask' ELSE '' END AS notes,
  2::BIGINT AS n_elements, 1::BIGINT AS n_not_used, concat_ws('|', CASE WHEN k % 5 = 0 THEN 'AA=First ' || k || '|BB=Second' END, CASE WHEN k % 6 = 0 THEN 'C1=third of all' END) AS codes FROM t""",
    guide_families: _TERSE + """SELECT file_id, 'terse' AS family, (count(*) + count(*) FILTER (k % 13 <> 0) + sum(2 + (k % 7 = 0)::INT + (k % 11 = 0)::INT))::BIGINT AS detected, (count(*) + count(*) FILTER (k % 13 <> 0) + 2 * count(*))::BIGINT AS confident,
  (count(*) FILTER (k % 7 = 0) + count(*) FILTER (k % 11 = 0) + count(*) FILTER (k % 13 = 0))::BIGINT AS n_reviews FROM t GROUP BY 1
UNION ALL SELECT (p_partkey // 25)::VARCHAR, 'templated', 3 * count(*) + count(*) FILTER (p_partkey % 11 = 0), 3 * count(*), count(*) FILTER (p_partkey % 11 = 0) FROM part GROUP BY 1
UNION ALL SELECT 'b' || (p_partkey // 25), 'tabular', count(*) + (sum((p_partkey % 13 <> 0)::INT * (3 + (p_partkey % 11 = 0)::INT + (p_partkey % 17 = 0)::INT)))::BIGINT, sum((p_partkey % 13 <> 0)::INT * (3 + (p_partkey % 7 <> 0)::INT))::BIGINT,
  (count(*) FILTER (p_partkey % 13 = 0) + count(*) FILTER (p_partkey % 13 <> 0 AND p_partkey % 11 = 0) + count(*) FILTER (p_partkey % 13 <> 0 AND p_partkey % 17 = 0) + count(*) FILTER (p_partkey % 13 <> 0 AND p_partkey % 7 = 0))::BIGINT FROM part GROUP BY 1
UNION ALL SELECT 'n' || n_nationkey, '-', 0, 0, 1 FROM nation""",
    guide_segments: _GUIDE + "SELECT file_id, seg AS seg_id, p_name AS name, pos, loop, usage, 'read this in full ' || k AS notes FROM b",
    guide_elements: _GUIDE + """SELECT file_id, seg AS seg_id, seg || '01' AS ref, 1 AS elem_ix, 'ID' AS type, 'must_use' AS usage FROM b
UNION ALL SELECT file_id, seg, seg || '02', 2, 'AN', CASE WHEN k % 4 = 0 THEN 'must_use' ELSE 'used' END FROM b UNION ALL SELECT file_id, seg, 'REF02', -1, 'AN', 'must_use' FROM b WHERE k % 17 = 0""",
    guide_codes: _GUIDE + "SELECT file_id, seg || '01' AS ref, 'AA' AS code, 'First ' || k AS name FROM b UNION ALL SELECT file_id, seg || '01', 'BB', 'Second of two' FROM b WHERE k % 3 = 0",
    guide_coverage: _GUIDE + """, c AS (SELECT file_id, count(*) + (sum((k % 13 <> 0)::INT * (3 + (k % 11 = 0)::INT + (k % 17 = 0)::INT)))::BIGINT AS detected, sum((k % 13 <> 0)::INT * (3 + (k % 7 <> 0)::INT))::BIGINT AS confident FROM p GROUP BY 1)
SELECT *, round(confident / detected, 6) AS ratio FROM c""",
    guide_cross_check: _GUIDE + """SELECT file_id, seg AS seg_id, pos, 'no_block' AS what FROM p WHERE k % 13 = 0 AND k % 5 <> 0 UNION ALL SELECT file_id, seg, pos, 'usage' FROM b WHERE k % 5 <> 0 AND k % 7 = 0
UNION ALL SELECT file_id, seg, pos, 'not_listed' FROM b WHERE k % 5 = 0 AND file_id IN (SELECT file_id FROM p WHERE k % 5 <> 0)""",
    guide_overlay: _GUIDE + """SELECT file_id, seg AS segment, unnest([0, 1]) AS elem_ix, 0 AS n_codes, loop FROM b WHERE usage = 'must_use' UNION ALL SELECT file_id, seg, 2, 0, loop FROM b WHERE usage = 'must_use' AND k % 4 = 0""",
    import_lookups: "SELECT n_regionkey::VARCHAR AS file_id, 'NATION' AS list_name, n_nationkey::VARCHAR AS source, n_name AS target, 'd' AS description FROM nation WHERE n_nationkey % 5 <> 0",
}
