"""Partner material as tables: imported mapping rows, deltas, overlays, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rule types in words that partners use, as `normal` writes them.
EXPLICIT = {
    "direct": "DIRECT", "move": "DIRECT", "copy": "DIRECT", "passthrough": "DIRECT", "pass through": "DIRECT",
    "constant": "CONSTANT", "hardcode": "CONSTANT", "hardcoded": "CONSTANT", "default": "CONSTANT", "literal": "CONSTANT", "fixed": "CONSTANT",
    "conditional": "CONDITIONAL", "condition": "CONDITIONAL", "if": "CONDITIONAL", "if then": "CONDITIONAL",
    "code list": "CODE_LIST", "codelist": "CODE_LIST", "xref": "CODE_LIST", "lookup": "CODE_LIST", "translate": "CODE_LIST", "translation": "CODE_LIST",
    "loop count": "LOOP_COUNT", "count": "LOOP_COUNT",
}


def normal(text):
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def classify(rows: DataFrame) -> DataFrame:
    """rows (row_id, rule_type, source, target, condition, default, code_list):
    adds kind, by the strongest evidence a row has, and review, why a person
    should look at it."""
    def has(c: str):
        return F.coalesce(F.trim(c) != "", F.lit(False))

    said = F.try_element_at(F.create_map(*(F.lit(x) for kv in EXPLICIT.items() for x in kv)), normal(F.coalesce("rule_type", F.lit(""))))
    kind = (
        F.when(said.isNotNull(), said).when(has("code_list"), "CODE_LIST").when(has("default") & ~has("source"), "CONSTANT")
        .when(has("condition"), "CONDITIONAL").when(has("source"), "DIRECT").otherwise("TODO")
    )
    out = rows.withColumn("kind", kind)
    fine = F.col("source").rlike("^[A-Z][A-Z0-9]{1,2}[0-9]{2}$")
    review = (
        F.when(~has("target"), "no target").when(F.col("kind") == "TODO", "no evidence of a rule").when(~F.col("kind").isin("CONSTANT", "LOOP_COUNT") & ~F.coalesce(fine, F.lit(False)), "source is no element")
        .when((F.col("kind") == "CODE_LIST") & ~has("code_list"), "no code list").when((F.col("kind") == "CONDITIONAL") & coded_condition().isNull(), "condition is prose")
    )
    return out.withColumn("review", review)


def coded_condition(c: str = "condition"):
    """A coded predicate for prose of a few plain forms, else null."""
    e = "([A-Z][A-Z0-9]{1,2}[0-9]{2})"
    there = F.regexp_extract(c, f"(?i:if|when)\\s+{e}\\s+(?i:is present|exists|is sent)", 1)
    equal = F.regexp_extract(c, f"(?i:if|when)\\s+{e}\\s*(?:=|(?i:is|equals))\\s*['\"]?([A-Za-z0-9]+)['\"]?", 1)
    value = F.regexp_extract(c, f"(?i:if|when)\\s+{e}\\s*(?:=|(?i:is|equals))\\s*['\"]?([A-Za-z0-9]+)['\"]?", 2)
    return F.when(there != "", F.concat(F.lit("EXISTS("), there, F.lit(")"))).when(equal != "", F.concat(equal, F.lit(" = '"), value, F.lit("'")))


def merge_rules(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base (row_id, place, body) with delta (row_id, place, body, removed) over
    it: removed rows go, others are replaced in place, new ones follow."""
    b, d = base.alias("b"), delta.alias("d")
    met = b.join(d, F.col("b.row_id") == F.col("d.row_id"), "full_outer").where(~F.coalesce("d.removed", F.lit(False)))
    origin = F.when(F.col("d.row_id").isNull(), "base").otherwise("partner")
    return met.select(F.coalesce("b.row_id", "d.row_id").alias("row_id"), F.when(F.col("b.row_id").isNotNull(), 0).otherwise(1).alias("part"), F.coalesce("b.place", "d.place").alias("place"), F.when(F.col("d.row_id").isNotNull(), F.col("d.body")).otherwise(F.col("b.body")).alias("body"), origin.alias("origin"))


def apply_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Presence rules (segment, codes ARRAY, loop): those of the overlay that no
    base rule covers are added. A base rule covers rules with the same codes, and
    one without a loop covers any."""
    o = overlay.withColumn("key", F.array_join(F.array_sort("codes"), ","))
    b = base.withColumn("key", F.array_join(F.array_sort("codes"), ","))
    covers = (o.segment == b.segment) & (o.key == b.key) & (b.loop.isNull() | o.loop.eqNullSafe(b.loop))
    return base.withColumn("origin", F.lit("base")).unionByName(o.join(b, covers, "left_anti").drop("key").withColumn("origin", F.lit("partner")))


def assemble_draft(targets: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """targets (path, required) with what a crosswalk (path, file_ix, source,
    kind) knows, the later file winning; what is left is TODO."""
    w = Window.partitionBy("path").orderBy(F.desc("file_ix"))
    last = crosswalk.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "file_ix")
    return targets.join(last, "path", "left").withColumn("kind", F.coalesce("kind", F.lit("TODO")))


def prefill(draft: DataFrame) -> DataFrame:
    """required, prefilled, todo and the ratio of a draft."""
    need = F.col("required")
    got = draft.agg(F.count_if(need).alias("required"), F.count_if(need & (F.col("kind") != "TODO")).alias("prefilled"), F.count_if(F.col("kind") == "TODO").alias("todo"))
    return got.withColumn("prefill", F.round(F.try_divide("prefilled", "required"), 6))


def batch_totals(checks: DataFrame) -> DataFrame:
    """checks (name, result PASS, WARNING, FAIL or ERROR) to totals and the exit
    code: 2 for an error, else 1 for a failure, else 0."""
    got = checks.agg(*(F.count_if(F.col("result") == r).alias(r.lower()) for r in ("PASS", "WARNING", "FAIL", "ERROR")))
    return got.withColumn("exit_code", F.when(F.col("error") > 0, 2).when(F.col("fail") > 0, 1).otherwise(0))
