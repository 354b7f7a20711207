"""What a loop context selects, and how a rule reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import split_context, split_element
from ..plans.transactions import Definition
from ..sources.x12 import element
from . import structure


def loop_ids(definition: Definition) -> set[str]:
    return {x.trigger for a in definition.areas for x in a.loops} | {c.trigger for a in definition.areas for x in a.loops for c in x.children}


def selects(context: str, definition: Definition) -> Column:
    """Rows of the first part of a context: of a loop (with its qualifier), of
    flat segments of one id (with element 01), or of all flat segments."""
    if not context:
        return F.col("flat")
    name, q = split_context(context)[0]
    if name in loop_ids(definition):
        own = F.coalesce((F.col("loop_id") == name) | (F.col("child_id") == name), F.lit(False))
        return own & F.coalesce(F.col("qualifier") == q, F.lit(False)) if q else own
    own = F.col("flat") & (F.col("seg_id") == name)
    return own & F.coalesce(element(1) == q, F.lit(False)) if q else own


def opens(context: str, definition: Definition) -> Column:
    """Rows that open an occurrence of a loop context, child loops apart."""
    name, q = split_context(context)[0]
    own = F.col("is_trigger") & (F.col("inner_id") == name)
    return F.coalesce(own & (F.col("qualifier") == q) if q else own, F.lit(False))


def hierarchical(definition: Definition) -> list[str]:
    return [x.trigger for a in definition.areas for x in a.loops if x.levels]


def inherit(placed: DataFrame, definition: Definition) -> DataFrame:
    """Placed rows with a column distance, 0; for each occurrence of a hierarchical
    loop its ancestors' own segments follow, with the occurrence's run and
    qualifier and the distance of the ancestor. Only reads of a scope want these:
    counts and sums take an occurrence's own segments."""
    rows = placed.withColumn("distance", F.lit(0))
    for loop in hierarchical(definition):
        above = structure.ancestors(structure.hierarchy(placed, loop))
        own = placed.where(F.col("is_trigger") & (F.col("seg_id") == loop)).select("doc", F.col("run").alias("seq"), F.col("qualifier").alias("own_qualifier"))
        above = above.join(own, ["doc", "seq"]).select("doc", F.col("seq").alias("own_run"), F.col("ancestor_seq").alias("run"), "own_qualifier", F.col("distance").alias("away"))
        lent = placed.where((F.col("loop_id") == loop) & F.col("child_id").isNull()).join(above, ["doc", "run"])
        put = {"run": F.col("own_run"), "qualifier": F.col("own_qualifier"), "distance": F.col("away"), "is_trigger": F.lit(False)}
        rows = rows.unionByName(lent.select(*(put.get(c, F.col(c)).alias(c) for c in rows.columns)))
    return rows


def scope_rows(placed: DataFrame, context: str, definition: Definition) -> DataFrame:
    """doc, scope_ix, seq, seg_id, elements: one scope for each occurrence of a
    loop or matching flat segment; a path keeps every base occurrence, narrowed."""
    parts = split_context(context)
    name = parts[0][0] if parts else None
    rows = placed.where(selects(context, definition))
    if name is None:
        return rows.select("doc", F.lit(1).alias("scope_ix"), "seq", "seg_id", "elements")
    start = F.coalesce("sub", "run") if name in loop_ids(definition) else F.col("seq")
    rows = rows.withColumn("start", start).withColumn("scope_ix", F.dense_rank().over(Window.partitionBy("doc").orderBy("start")))
    if len(parts) == 1:
        return rows.select("doc", "scope_ix", "seq", "seg_id", "elements")
    sub, q = parts[1]
    fits = (F.col("seg_id") == sub) & (F.coalesce(element(1) == q, F.lit(False)) if q else F.lit(True))
    scope = Window.partitionBy("doc", "scope_ix")
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("none", ~F.max("fits").over(scope)).withColumn("nth", F.row_number().over(scope.orderBy("seq")))
    kept = rows.where("fits or (none and nth = 1)")
    return kept.select("doc", "scope_ix", *(F.when(F.col("fits"), F.col(c)).alias(c) for c in ("seq", "seg_id", "elements")))


def first_read(source: str, context: str, definition: Definition, order: Column | None = None) -> tuple[Column, Column]:
    """(first start, first matching segment of each scope start): aggregates over
    a transaction, to be finished by `finish_read`. Only the first scope counts,
    and in it only the first segment of the id, by `order` (seq unless given)."""
    order = F.col("seq") if order is None else order
    seg, _ = split_element(source)
    name = split_context(context)[0][0] if context else None
    inside = selects(context, definition)
    start = F.lit(0).cast("long") if name is None else F.coalesce("sub", "run") if name in loop_ids(definition) else F.col("seq")
    if len(split_context(context)) > 1:
        sub, q = split_context(context)[1]
        fits = inside & (F.col("seg_id") == sub) & (F.coalesce(element(1) == q, F.lit(False)) if q else F.lit(True))
    else:
        fits = inside & (F.col("seg_id") == seg)
    return F.min(F.when(inside, start)), F.min_by(F.struct(start.alias("start"), "elements"), F.when(fits, F.struct(start.alias("start"), order.alias("order"))))


def finish_read(first: str, found: str, source: str) -> Column:
    _, at = split_element(source)
    return F.when(F.col(first) == F.col(found)["start"], F.nullif(F.get(F.col(found)["elements"], at - 1), F.lit("")))


def cells(placed: DataFrame) -> DataFrame:
    """Non-empty elements: doc, seq, seg_id, elem_ix (from 1), value, and the
    place of their segment."""
    own = placed.select("doc", "seq", "seg_id", "flat", "loop_id", "child_id", "qualifier", element(1).alias("first"), F.posexplode("elements").alias("e", "value"))
    return own.where(F.col("value") != "").withColumn("elem_ix", F.col("e") + 1).drop("e")


def nesting(docs: DataFrame) -> int:
    """Levels of the deepest of (doc, v VARIANT): open brackets of its text,
    without escapes and strings. Brackets that are alike are walked once."""
    brackets = F.regexp_replace(F.regexp_replace(F.to_json("v"), r"\\.", ""), r'"[^"]*"|[^\[\]{}"]+', "")
    turn = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walk = F.aggregate(F.split("brackets", ""), start, lambda a, c: F.struct((a["now"] + turn(c)).alias("now"), F.greatest(a["most"], a["now"] + turn(c)).alias("most")))
    return docs.select(brackets.alias("brackets")).distinct().agg(F.max(walk["most"])).first()[0] or 0


def leaves(docs: DataFrame) -> DataFrame:
    """Leaves of (doc, v VARIANT) at every depth: doc, norm_path (lists as []),
    concrete_path, line_ix (of the outermost list), leaf_type, leaf_text. Empty
    objects and lists yield nothing. Counts the levels of docs first; a step
    opens one, and leaves found pass through."""
    tvf = docs.sparkSession.tvf
    none = F.lit(None).cast("string")
    rows = docs.select("doc", "v", F.lit("").alias("norm_path"), F.lit("").alias("concrete_path"), F.lit(None).cast("int").alias("line_ix"), none.alias("leaf_type"), F.col("v").alias("inner"), F.lit(True).alias("open"))
    for _ in range(nesting(docs)):
        step = rows.lateralJoin(tvf.variant_explode_outer(F.col("inner").outer()).toDF("pos", "key", "value")).where("not open or pos is not null")
        put = lambda new, old: F.when(F.col("open"), new).otherwise(F.col(old)).alias(old)
        dot = lambda c: F.when(F.col(c) == "", F.col("key")).otherwise(F.concat(F.col(c), F.lit("."), "key"))
        step = step.select(
            "doc", "open", put(F.col("value"), "v"), put(F.when(F.col("key").isNull(), F.concat("norm_path", F.lit("[]"))).otherwise(dot("norm_path")), "norm_path"),
            put(F.when(F.col("key").isNull(), F.format_string("%s[%d]", "concrete_path", "pos")).otherwise(dot("concrete_path")), "concrete_path"),
            put(F.coalesce("line_ix", F.when(F.col("key").isNull(), F.col("pos"))), "line_ix"), put(F.schema_of_variant("value"), "leaf_type"),
        )
        nested = F.col("open") & (F.col("leaf_type").startswith("OBJECT") | F.col("leaf_type").startswith("ARRAY"))
        rows = step.withColumn("open", nested).withColumn("inner", F.when(F.col("open"), F.col("v")))
    return rows.where(~F.col("open")).select("doc", "norm_path", "concrete_path", "line_ix", "leaf_type", F.try_variant_get("v", "$", "string").alias("leaf_text"))
