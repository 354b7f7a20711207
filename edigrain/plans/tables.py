"""Specs as tables: rows of rules and code lists, checked as columns, so that all
defects of all rows come back at once, and then compiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spec import CONTEXT, ELEMENT, RULE_TYPES, Rule, Spec, SpecError

COLUMNS = ("row_id", "source", "context", "target", "kind", "condition", "then", "otherwise", "default", "code_list", "data_type", "fmt")
DATA_TYPES = ("string", "integer", "decimal", "date", "time")
_FORMAT = r"(%[^;]+|implied:[0-9]+|places:[0-9]+|len:[0-9]+(\.\.[0-9]+)?|tol:[0-9]*\.?[0-9]+|shift:[+-]?[0-9]+[dw])"


def read_csv(spark, path: str) -> DataFrame:
    """Rule or code rows of CSV files with a header, all text."""
    return spark.read.option("header", True).option("mode", "FAILFAST").csv(path)


def code_rows(spark, path: str, header: bool = True) -> DataFrame:
    """list, source, target of CSV files, by position; one column less means that
    the file's name is the list's."""
    raw = spark.read.option("header", header).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    cols = [F.trim(F.col(f"`{c}`")) for c in raw.columns[:3]]
    own = cols if len(cols) == 3 else [name, *cols]
    return raw.select(*(c.alias(n) for c, n in zip(own, ("list", "source", "target"))))


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def code_errors(codes: DataFrame) -> DataFrame:
    """row_id (list:code), error of code rows: empty_code, and duplicate_code for a
    code that a list translates twice."""
    n = F.count("*").over(Window.partitionBy("list", "source"))
    error = F.when(~_filled("source") | ~_filled("list"), "empty_code").when(n > 1, "duplicate_code")
    own = codes.withColumn("error", error).where(F.col("error").isNotNull())
    return own.select(F.concat_ws(":", "list", "source").alias("row_id"), "error").distinct()


def rule_errors(rules: DataFrame, codes: DataFrame) -> DataFrame:
    """row_id, error for every defect of every row of an inbound spec (COLUMNS;
    nulls are empty). Lists that rules name are looked up in codes."""
    lists = codes.select(F.col("list").alias("code_list")).distinct().withColumn("listed", F.lit(True))
    n = F.count("*").over(Window.partitionBy("row_id"))
    rows = rules.withColumn("n", n).join(lists, "code_list", "left")
    kind, source = F.upper(F.trim("kind")), F.col("source")
    element = f"^{ELEMENT.pattern}$"
    context = f"^{CONTEXT.pattern}(>{CONTEXT.pattern})?$"
    outcome = "^(SOURCE|SKIP|BLANK|'[^']*')$"
    tests = {
        "no_row_id": ~_filled("row_id"), "duplicate_row_id": _filled("row_id") & (F.col("n") > 1), "no_target": ~_filled("target"), "unknown_kind": ~F.coalesce(kind.isin(*RULE_TYPES), F.lit(False)),
        "no_source": kind.isin("DIRECT", "CODE_LIST") & ~_filled("source"), "bad_source": _filled("source") & (kind != "LOOP_COUNT") & ~source.rlike(element),
        "bad_context": _filled("context") & ~F.col("context").rlike(context), "no_code_list": (kind == "CODE_LIST") & ~_filled("code_list"), "unknown_code_list": _filled("code_list") & F.col("listed").isNull(),
        "no_default": (kind == "CONSTANT") & ~_filled("default"), "no_condition": (kind == "CONDITIONAL") & ~(_filled("condition") & _filled("then")),
        "bad_outcome": (_filled("then") & ~F.trim("then").rlike(outcome)) | (_filled("otherwise") & ~F.trim("otherwise").rlike(outcome)),
        "bad_data_type": _filled("data_type") & ~F.lower(F.trim("data_type")).isin(*DATA_TYPES), "bad_format": _filled("fmt") & ~F.col("fmt").rlike(f"^{_FORMAT}(;{_FORMAT})*$"),
    }
    found = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in tests.items())))
    return rows.select("row_id", F.explode(found).alias("error")).distinct().unionByName(code_errors(codes))


def compile_spec(set_code: str, rules: DataFrame, codes: DataFrame, most: int = 20000) -> Spec:
    """The spec of rows without errors. A spec is code: its rows come to the driver
    to become columns of a plan, and more than `most` are refused."""
    rows, pairs = rules.limit(most + 1).collect(), codes.limit(most + 1).collect()
    if max(len(rows), len(pairs)) > most:
        raise SpecError(f"more than {most} rows")
    lists: dict[str, dict[str, str]] = {}
    for r in pairs:
        lists.setdefault(r["list"], {})[r["source"]] = r["target"]
    text = lambda r, c: (r[c] or "").strip()
    return Spec(set_code, tuple(
        Rule(text(r, "row_id"), text(r, "source") or None, text(r, "context"), text(r, "target"), text(r, "kind").upper(), text(r, "condition"), text(r, "then"), text(r, "otherwise"), r["default"], text(r, "code_list") or None, text(r, "data_type").lower() or "string", text(r, "fmt"))
        for r in rows
    ), lists)


def merge_delta(rules: DataFrame, delta: DataFrame) -> DataFrame:
    """Rule rows with a partner's delta over them: a row of kind REMOVE takes its
    row away, others replace or follow; adds origin."""
    d = delta.select("row_id", F.struct(*COLUMNS).alias("d"), F.lit(True).alias("in_delta"))
    met = rules.select("row_id", F.struct(*COLUMNS).alias("b")).join(d, "row_id", "full_outer").where(~F.coalesce(F.upper("d.kind") == "REMOVE", F.lit(False)))
    return met.select(F.when(F.col("in_delta"), F.col("d")).otherwise(F.col("b")).alias("r"), F.when(F.col("in_delta"), "partner").otherwise("base").alias("origin")).select("r.*", "origin")


def delta_errors(rules: DataFrame, delta: DataFrame) -> DataFrame:
    """row_id, error of removals of rows that the base does not have."""
    gone = delta.where(F.upper("kind") == "REMOVE").select("row_id")
    return gone.join(rules.select("row_id"), "row_id", "left_anti").withColumn("error", F.lit("removes_nothing"))
