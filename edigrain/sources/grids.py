"""Partner tables of any shape: header rows found, columns met by their names.

A grid is (file_id, row_ix, cells ARRAY<STRING>), many files at once. What is
decided for a file (its header, its columns) is one small row of that file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.partners import classify, normal

# Words by which columns of mapping tables are known, strongest column first.
SYNONYMS = {
    "source": ("source field", "source", "x12 element", "x12", "element", "segment element", "edi element", "source element", "from"),
    "context": ("loop context", "loop", "context", "segment loop", "occurrence"),
    "target": ("target field", "target", "destination", "erp field", "idoc field", "field name", "internal field", "to", "output field", "field", "destination field"),
    "rule_type": ("rule type", "mapping type", "map type", "rule kind", "rule"),
    "condition": ("condition", "logic", "rule logic", "condition text", "notes logic", "mapping logic", "comments logic", "business rule", "mapping rule", "instructions", "instruction"),
    "coded": ("condition coded", "coded condition", "condition code"),
    "then": ("then", "if true", "true value"),
    "else": ("else", "if false", "false value", "otherwise"),
    "default": ("default value", "default", "constant", "hardcode", "hard code", "literal", "fixed value", "hardcoded"),
    "code_list": ("code list ref", "code list", "codelist", "lookup", "xref", "cross reference", "translation", "translate", "value map"),
    "data_type": ("data type", "datatype", "type of data", "type"),
    "format": ("format", "picture", "data format", "output format"),
}
# Words by which columns of lookup tables are known.
LOOKUP = {
    "list_name": ("list name", "list", "table", "name"),
    "source": ("source value", "source", "from", "x12", "code"),
    "target": ("target value", "target", "to", "value", "mapped"),
    "description": ("description", "desc", "notes"),
}


def _is_number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def headers(grid: DataFrame) -> DataFrame:
    """file_id, header_ix, headers of each file: the first row of which at least two
    cells, and three in five of those filled, are short labels and no numbers; null
    if there is none. Blank headers are named by their place, repeats are numbered."""
    filled = F.filter("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    labels = F.size(F.filter(filled, lambda c: (F.length(F.trim(c)) <= 40) & ~_is_number(F.trim(c))))
    fits = (F.size(filled) >= 2) & (labels >= F.greatest(F.lit(2), F.size(filled) * 0.6))
    own = grid.groupBy("file_id").agg(F.min(F.when(fits, F.struct("row_ix", "cells"))).alias("h"))
    named = F.transform("h.cells", lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))

    def number(name, i):
        n = F.size(F.filter(F.slice("names", 1, i + 1), lambda x: x == name))
        return F.when(n > 1, F.concat(name, F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(name)

    return own.withColumn("names", named).select("file_id", F.col("h.row_ix").alias("header_ix"), F.transform("names", number).alias("headers"))


def _tries(rank: int, ours: str, words: tuple[str, ...], forced: str | None) -> Column:
    """(worth, rank, at, name, header) of every header for one of our columns."""

    def quality(h):
        plain = normal(h)
        if forced is not None:
            return F.when(h == forced, 5).when(plain == normal(F.lit(forced)), 4).otherwise(0)
        part = F.array(*(F.lit(w) for w in words))
        word = F.exists(part, lambda w: F.array_contains(F.split(plain, " "), w))
        return F.when(plain.isin(*words), 3).when(word, 2).when(F.exists(part, lambda w: F.contains(plain, w)), 1).otherwise(0)

    return F.transform("headers", lambda h, i: F.struct((-quality(h)).alias("worth"), F.lit(rank).alias("rank"), i.alias("at"), F.lit(ours).alias("name"), h.alias("header")))


def columns(heads: DataFrame, synonyms: dict[str, tuple[str, ...]] = SYNONYMS, overrides: dict[str, str] | None = None) -> DataFrame:
    """Adds picks, an array of (name, at, header), to `headers`: our column names and
    the place (from 0) of the header that each of them got. An override (ours to a
    header, as written or normalised) comes first; then equal names, names that hold a
    synonym as a word, and names that hold one at all. A header serves one column."""
    tries = F.concat(*(_tries(rank, ours, words, (overrides or {}).get(ours)) for rank, (ours, words) in enumerate(synonyms.items())))
    kind = "array<struct<name:string,at:int,header:string>>"
    free = lambda got, t: ~F.exists(got, lambda g: (g["name"] == t["name"]) | (g["at"] == t["at"]))
    pick = lambda got, t: F.when(free(got, t), F.concat(got, F.array(F.struct(t["name"], t["at"], t["header"])))).otherwise(got)
    ranked = heads.withColumn("tries", F.array_sort(F.filter(tries, lambda t: t["worth"] < 0)))
    return ranked.withColumn("picks", F.aggregate(F.coalesce("tries", F.array().cast(ranked.schema["tries"].dataType)), F.array().cast(kind), pick)).drop("tries")


def rows(grid: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows below each file's header that hold anything: file_id, n (from 1), cells
    (trimmed), headers, picks. Files without a header have none. A file's rows are
    numbered in one task: it is one partner's document."""
    text = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    below = grid.join(picked, "file_id").where("row_ix > header_ix").withColumn("cells", text).where(F.exists("cells", lambda c: c != ""))
    return below.select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("row_ix")).alias("n"), "cells", "headers", "picks")


def _pick(name: str) -> Column:
    at = F.get(F.filter("picks", lambda p: p["name"] == name), 0)["at"]
    return F.nullif(F.get("cells", at), F.lit(""))


def mapping_rows(grid: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Mapping tables of partners, classified: file_id, row_id (IMP-001 on), our
    columns, kind and review."""
    own = rows(grid, columns(headers(grid), overrides=overrides))
    named = own.select("file_id", F.format_string("IMP-%03d", "n").alias("row_id"), *(_pick(c).alias(c) for c in SYNONYMS))
    return classify(named)


def lookup_rows(grid: DataFrame) -> DataFrame:
    """Code lists of partners: file_id, list_name, source, target, description."""
    own = rows(grid, columns(headers(grid), LOOKUP))
    return own.select("file_id", *(_pick(c).alias(c) for c in LOOKUP)).where("list_name is not null and source is not null and target is not null")


def unmapped_columns(grid: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """file_id, header, n: columns with data that became none of ours."""
    own = rows(grid, columns(headers(grid), overrides=overrides))
    cells = own.select("file_id", "headers", "picks", F.posexplode("cells").alias("at", "value")).where("value != '' and at < size(headers)")
    lost = cells.where(~F.exists("picks", lambda p: p["at"] == F.col("at")))
    return lost.groupBy("file_id", F.get("headers", F.col("at")).alias("header")).agg(F.count("*").alias("n"))


def table_errors(grid: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """file_id, error, what: files without a header row or a target column, and
    overrides that name no header of a file."""
    got = columns(headers(grid), overrides=overrides)
    has = lambda name: F.exists("picks", lambda p: p["name"] == name)
    tests = [F.when(F.col("header_ix").isNull(), F.struct(F.lit("no_header").alias("error"), F.lit("").alias("what"))), F.when(F.col("header_ix").isNotNull() & ~has("target"), F.struct(F.lit("no_target_column").alias("error"), F.lit("").alias("what")))]
    tests += [F.when(F.col("header_ix").isNotNull() & ~has(ours), F.struct(F.lit("unknown_override").alias("error"), F.lit(theirs).alias("what"))) for ours, theirs in (overrides or {}).items()]
    return got.select("file_id", F.explode(F.array_compact(F.array(*tests))).alias("e")).select("file_id", "e.*")


def auto_classified(mapped: DataFrame) -> DataFrame:
    """file_id, n_rows, ratio of a file's rows that nobody need look at."""
    return mapped.groupBy("file_id").agg(F.count("*").alias("n_rows"), F.round(F.avg(F.col("review").isNull().cast("double")), 6).alias("ratio"))
