"""Drafts of mapping specs: many at once, each from its crosswalk and a guide.

A draft is rows (draft, target, kind, source, context, condition, code_list), as
`partners.assemble_draft` makes them; draft names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.transactions import Definition, Loop

ELEMENT = "\\b([A-Z][A-Z0-9]{1,2})([0-9]{2})\\b"


def numbered(draft: DataFrame, order: str) -> DataFrame:
    """Adds row_id: D-001 on, in the order of each draft's targets."""
    return draft.withColumn("row_id", F.format_string("D-%03d", F.row_number().over(Window.partitionBy("draft").orderBy(order))))


def segment_walk(spark: SparkSession, definition: Definition) -> DataFrame:
    """place, seg_id, context of a definition's segments in the order in which it
    lists them, a loop's trigger before its members; a segment counts where it
    stands first."""
    first: dict[str, str] = {}

    def loop(x: Loop) -> None:
        for s in (x.trigger, *x.segments):
            first.setdefault(s, x.trigger)
        for child in x.children:
            loop(child)

    for area in definition.areas:
        for s in area.segments:
            first.setdefault(s, "")
        for x in area.loops:
            loop(x)
    return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(first.items())], "place int, seg_id string, context string")


def source_elements(walk: DataFrame, names: DataFrame) -> DataFrame:
    """place, seg_id, elem_ix, context, name: a walk with the dictionary of elements
    (seg_id, elem_ix, name); segments without entries are left out."""
    return walk.join(names, "seg_id").select("place", "seg_id", "elem_ix", "context", "name")


def referenced_elements(draft: DataFrame) -> DataFrame:
    """draft, seg_id, elem_ix that rules read: sources (those of counts name no
    element), elements of conditions outside quotes, and qualifiers of contexts."""
    bare = F.regexp_replace(F.coalesce("condition", F.lit("")), "'[^']*'", "")
    own = F.when(F.col("kind") != "LOOP_COUNT", F.coalesce("source", F.lit(""))).otherwise("")
    found = F.regexp_extract_all(F.concat_ws(" ", own, bare), F.lit(ELEMENT), F.lit(0))
    loops = F.regexp_extract_all(F.coalesce("context", F.lit("")), F.lit("([A-Z][A-Z0-9]{1,2})\\["), F.lit(1))
    whole = F.concat(found, F.transform(loops, lambda x: F.concat(x, F.lit("01"))))
    ref = draft.where("kind != 'TODO'").select("draft", F.explode(whole).alias("ref"))
    return ref.select("draft", F.expr("left(ref, length(ref) - 2)").alias("seg_id"), F.expr("right(ref, 2)").cast("int").alias("elem_ix")).distinct()


def unmapped_elements(elements: DataFrame, draft: DataFrame, guide: DataFrame) -> DataFrame:
    """draft, seg_id, elem_ix, context, name, usage: source elements that no rule of a
    draft reads, with the usage that its guide (draft, seg_id, elem_ix, usage) gives,
    those not used apart. Elements of a definition are few and fixed."""
    every = draft.select("draft").distinct().crossJoin(F.broadcast(elements))  # of one definition, met with the names of drafts
    free = every.join(referenced_elements(draft), ["draft", "seg_id", "elem_ix"], "left_anti")
    said = free.join(guide.select("draft", "seg_id", "elem_ix", "usage"), ["draft", "seg_id", "elem_ix"], "left")
    return said.where("usage is null or usage != 'not_used'").select("draft", "place", "seg_id", "elem_ix", "context", "name", F.coalesce("usage", F.lit("")).alias("usage"))


def unused_sources(draft: DataFrame, guide: DataFrame) -> DataFrame:
    """draft, target, source of rules whose source the guide says is not used."""
    at = lambda i: F.regexp_extract("source", f"^{ELEMENT}$", i)
    own = draft.where("kind != 'TODO'").select("draft", "target", "source", at(1).alias("seg_id"), at(2).try_cast("int").alias("elem_ix"))
    return own.join(guide.where("usage = 'not_used'"), ["draft", "seg_id", "elem_ix"], "left_semi").select("draft", "target", "source")


def _partner_codes(draft: DataFrame, guide_codes: DataFrame) -> DataFrame:
    lists = draft.where("kind = 'CODE_LIST' and code_list is not null").select("draft", "code_list", F.col("source").alias("ref"))
    return lists.join(guide_codes, ["draft", "ref"]).groupBy("draft", "code_list", "code").agg(F.min("name").alias("name"))


def partner_lists(draft: DataFrame, codes: DataFrame, guide_codes: DataFrame) -> DataFrame:
    """draft, code_list, source, target of the code lists that a draft names: those
    for whose sources the guide (draft, ref, code, name) lists codes hold these codes
    alone, others are whole."""
    asked = _partner_codes(draft, guide_codes)
    used = draft.where("kind = 'CODE_LIST' and code_list is not null").select("draft", "code_list").distinct()
    marked = used.join(asked.select("draft", "code_list", F.lit(True).alias("part")).distinct(), ["draft", "code_list"], "left")
    rows = marked.join(codes, "code_list")
    kept = rows.join(asked.select("draft", "code_list", F.col("code").alias("source"), F.lit(True).alias("wanted")), ["draft", "code_list", "source"], "left")
    return kept.where("part is null or wanted").select("draft", "code_list", "source", "target")


def untranslated(draft: DataFrame, codes: DataFrame, guide_codes: DataFrame) -> DataFrame:
    """draft, code_list, code, name: codes of a guide that its code list lacks."""
    own = codes.select("code_list", F.col("source").alias("code"))
    return _partner_codes(draft, guide_codes).join(own, ["code_list", "code"], "left_anti").select("draft", "code_list", "code", "name")
