"""Areas, loops and hierarchies of a transaction, as window functions.

Input rows are (doc, seq, seg_id, elements); all windows are ordered by seq and
partitioned by doc, so one exchange by doc and one sort serve them all. One transaction is bounded (a set allows some hundred
thousand loops), and its rows must be seen in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.transactions import Definition, Loop
from ..sources.x12 import element
from .store import share

SEG = F.col


def _is(names) -> Column:
    return F.col("seg_id").isin(*names) if names else F.lit(False)


def _any(cols) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


class _Compiled:
    """What one definition says of a segment, as columns of literals."""

    def __init__(self, definition: Definition):
        self.areas = definition.areas
        self.loops = {x.trigger: x for a in self.areas for x in a.loops}
        self.children: dict[str, Loop] = {c.trigger: c for x in self.loops.values() for c in x.children}

    def _by_area(self, f) -> Column:
        return reduce(lambda c, ia: F.when(F.col("area_ix") == ia[0], f(ia[1])).otherwise(c), enumerate(self.areas), F.lit(False))

    def _by_loop(self, f) -> Column:
        return reduce(lambda c, x: F.when(F.col("run_id") == x.trigger, f(x)).otherwise(c), self.loops.values(), F.lit(False))

    def opener(self) -> Column:
        return reduce(lambda c, ia: c.when(F.col("seg_id") == ia[1].opener, ia[0]) if ia[1].opener else c, enumerate(self.areas), F.when(F.lit(False), 0))

    def trigger(self) -> Column:
        return self._by_area(lambda a: _is([x.trigger for x in a.loops]))

    def member(self) -> Column:
        return self._by_loop(lambda x: _is(x.segments))

    def child(self) -> Column:
        return self._by_loop(lambda x: _is([c.trigger for c in x.children]))

    def child_member(self) -> Column:
        return reduce(lambda c, x: F.when(F.col("sub_id") == x.trigger, _is(x.segments)).otherwise(c), self.children.values(), F.lit(False))

    def of_area(self) -> Column:
        return self._by_area(lambda a: _is(a.segments))

    def leveled(self) -> Column:
        """The innermost loop is hierarchical."""
        names = [x.trigger for x in self.loops.values() if x.levels]
        return F.coalesce(F.col("inner_id").isin(*names), F.lit(False)) if names else F.lit(False)

    def occurrences(self, doc) -> Column:
        """How many loops of the row's innermost loop the document opened so far."""
        own = lambda x: F.col("inner_id") == x
        return reduce(lambda c, x: c.when(own(x), F.count_if(F.col("is_trigger") & own(x)).over(doc)), sorted({*self.loops, *self.children}), F.when(F.lit(False), 0))


class _Looked:
    """The same from the column `facts` that the rows bring along."""

    def _in(self, name: str, at: str) -> Column:
        return F.coalesce(F.array_contains(F.col(f"facts.{name}"), F.col(at)), F.lit(False))

    def opener(self) -> Column:
        return F.col("facts.opens")

    def trigger(self) -> Column:
        return self._in("trigger", "area_ix")

    def member(self) -> Column:
        return self._in("member", "run_id")

    def child(self) -> Column:
        return self._in("child", "run_id")

    def child_member(self) -> Column:
        return self._in("child_member", "sub_id")

    def of_area(self) -> Column:
        return self._in("area", "area_ix")

    def leveled(self) -> Column:
        return F.coalesce(F.array_contains(F.col("facts.leveled"), F.col("inner_id")), F.lit(False))

    def occurrences(self, doc) -> Column:
        """Loops are no literals here: rows are sorted once more, by loop."""
        loop = Window.partitionBy("doc", "inner_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        return F.count_if("is_trigger").over(loop)


def place(segments: DataFrame, definition: Definition) -> DataFrame:
    """Adds area_ix, loop_id and run (the seq of the trigger) of the open loop,
    child_id and sub of an open child loop, flat, known, and occ_ix (occurrence
    of the innermost loop in the transaction)."""
    return _walk(segments, _Compiled(definition))


DEFINITION_ROW = "set_code string, role string, area_ix int, loop string, sub string, seg_id string, code string, repeats int, leveled boolean"
#: Roles of definition rows: a segment opens an area, belongs to it, opens a loop or
#: belongs to it, opens a child loop (sub) or belongs to that; line is the loop of lines.
ROLES = ("opener", "area", "trigger", "member", "child", "child_member", "line")


def definition_rows(spark, definitions: dict[str, Definition]) -> DataFrame:
    """Definitions as rows (DEFINITION_ROW)."""
    out = []
    for d in definitions.values():
        row = lambda role, at, loop=None, sub=None, seg=None, code=None, repeats=None, leveled=None, d=d: out.append((d.set_code, role, at, loop, sub, seg, code, repeats, leveled))
        for i, a in enumerate(d.areas):
            if a.opener:
                row("opener", i, seg=a.opener)
            for s in a.segments:
                row("area", i, seg=s)
            for x in a.loops:
                row("trigger", i, x.trigger, seg=x.trigger, repeats=x.max_repeats, leveled=bool(x.levels))
                for s in x.segments:
                    row("member", i, x.trigger, seg=s)
                for c in x.children:
                    row("child", i, x.trigger, c.trigger, c.trigger, repeats=c.max_repeats)
                    for s in c.segments:
                        row("child_member", i, x.trigger, c.trigger, s)
        loop, _, code = d.line_loop.partition("[")
        row("line", 0, loop, seg=loop, code=code.rstrip("]") or None)
    return spark.createDataFrame(out, DEFINITION_ROW)


def definition_errors(rows: DataFrame) -> DataFrame:
    """set_code, error, seg_id of definition rows that cannot be meant: unknown_role,
    no_set, no_segment, no_area, no_loop (of a loop's row), loop_never_opens,
    no_line_loop and two_line_loops (a set defined twice)."""
    member = F.col("role").isin("member", "child", "child_member", "trigger", "line")
    opened = rows.where("role = 'trigger'").select("set_code", "loop").distinct().withColumn("opened", F.lit(True))
    met = rows.join(opened, ["set_code", "loop"], "left")
    error = (
        F.when(F.col("set_code").isNull() | (F.col("set_code") == ""), "no_set").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown_role").when(F.col("seg_id").isNull() | (F.col("seg_id") == ""), "no_segment")
        .when(F.col("area_ix").isNull() | (F.col("area_ix") < 0), "no_area").when(member & F.col("loop").isNull(), "no_loop").when(F.col("role").isin("child", "child_member") & F.col("sub").isNull(), "no_loop")
        .when(member & F.col("opened").isNull(), "loop_never_opens")
    )
    one = met.withColumn("error", error).where("error is not null").select("set_code", "error", "seg_id")
    lines = rows.groupBy("set_code").agg(F.count_if(F.col("role") == "line").alias("n")).where("n != 1 and set_code is not null")
    return one.unionByName(lines.select("set_code", F.when(F.col("n") == 0, "no_line_loop").otherwise("two_line_loops").alias("error"), F.lit(None).cast("string").alias("seg_id"))).distinct()


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to all executors if it has `most` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def place_by(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """`place` for documents of many sets at once: segments have a set_code besides,
    and each set is placed by its definition rows, in one plan. Segments of a set
    without rows are left out: they are an issue of `split_issues`."""
    of = lambda role, c: F.array_distinct(F.collect_list(F.when(F.col("role") == role, F.col(c)))).alias(role)
    leveled = rows.where("role = 'trigger' and leveled").groupBy("set_code").agg(F.collect_set("loop").alias("leveled"))
    facts = rows.where("role != 'line'").groupBy("set_code", "seg_id").agg(F.min(F.when(F.col("role") == "opener", F.col("area_ix"))).alias("opens"), of("trigger", "area_ix"), of("area", "area_ix"), of("member", "loop"), of("child", "loop"), of("child_member", "sub"))
    named = F.struct("opens", "trigger", "area", "member", "child", "child_member", "leveled").alias("facts")
    none = F.array().cast("array<string>")
    # one row more for each set, for segments that it does not name
    sets = rows.select("set_code").distinct().join(leveled, "set_code", "left").withColumn("leveled", F.coalesce("leveled", none))
    facts = facts.join(sets, "set_code").select("set_code", "seg_id", named)
    known = small(sets, 100_000).withColumnRenamed("leveled", "own_leveled")
    met = segments.join(known, "set_code").join(small(facts, 100_000), ["set_code", "seg_id"], "left")
    empty = F.struct(F.lit(None).cast("int").alias("opens"), F.array().cast("array<int>").alias("trigger"), F.array().cast("array<int>").alias("area"), none.alias("member"), none.alias("child"), none.alias("child_member"), F.col("own_leveled").alias("leveled"))
    met = met.withColumn("facts", F.coalesce("facts", empty)).drop("own_leveled")
    return _walk(met, _Looked(), "set_code")


def _walk(segments: DataFrame, of, *carried: str) -> DataFrame:
    """Areas, runs of loops and their child loops are stretches of a document. What
    is latest in one of them is therefore the latest of the document, unless it lies
    before its start: one order by seq serves all steps, and rows are sorted once."""
    doc = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda on, c: F.last(F.when(on, c), True).over(doc)
    since = lambda on, start: F.coalesce(latest(on, F.col("seq")) >= start, F.lit(False))
    rows = segments.where(~F.col("seg_id").isin("ISA", "GS", "ST", "SE", "GE", "IEA"))
    rows = rows.withColumn("area_ix", F.coalesce(F.max(of.opener()).over(doc), F.lit(0)))
    rows = rows.withColumn("t0", of.trigger())
    rows = rows.withColumn("r", latest(F.col("t0"), F.struct("seq", "seg_id", "area_ix", element(1).alias("first"), element(3).alias("level"))))
    rows = rows.withColumn("r", F.when(F.col("r.area_ix") == F.col("area_ix"), F.col("r"))).withColumn("run", F.col("r.seq")).withColumn("run_id", F.col("r.seg_id"))
    rows = rows.withColumn("mem", of.member())
    rows = rows.withColumn("t1", F.col("run").isNotNull() & ~F.col("t0") & of.child())
    rows = rows.withColumn("s", latest(F.col("t1"), F.struct("seq", "seg_id", element(1).alias("first"))))
    rows = rows.withColumn("s", F.when(F.col("s.seq") > F.col("run"), F.col("s"))).withColumn("sub", F.col("s.seq")).withColumn("sub_id", F.col("s.seg_id"))
    rows = rows.withColumn("cmem", F.coalesce(of.child_member(), F.lit(False)))
    rows = rows.withColumn("popped", since(F.col("sub").isNotNull() & F.col("mem") & ~F.col("cmem") & ~F.col("t0") & ~F.col("t1"), F.col("sub")))
    rows = rows.withColumn("aseg", of.of_area())
    aseg = F.col("aseg")
    rows = rows.withColumn("cleared", since(~F.col("t0") & ~F.col("t1") & aseg & ~F.col("mem") & ~(F.col("sub").isNotNull() & ~F.col("popped") & F.col("cmem")), F.col("run")))
    flat = F.col("run").isNull() | F.col("cleared")
    known = F.col("t0") | F.col("t1") | F.col("mem") | aseg | F.col("cmem")
    rows = rows.withColumn("flat", flat).withColumn("known", known)
    inner = ~F.col("flat") & F.col("sub").isNotNull() & ~F.col("popped")
    rows = rows.withColumn("child_id", F.when(inner, F.col("sub_id"))).withColumn("sub", F.when(inner, F.col("sub"))).withColumn("loop_id", F.when(~F.col("flat"), F.col("run_id"))).withColumn("run", F.when(~F.col("flat"), F.col("run")))
    rows = rows.withColumn("inner_id", F.coalesce("child_id", "loop_id")).withColumn("is_trigger", (F.col("t0") | F.col("t1")) & ~F.col("flat"))
    # the innermost loop was opened by the trigger of its run, or of its child loop
    trigger = F.when(F.col("sub").isNotNull(), F.col("s.first")).otherwise(F.col("r.first"))
    rows = rows.withColumn("qualifier", F.when(~F.col("flat"), F.when(of.leveled(), F.col("r.level")).otherwise(trigger)))
    rows = rows.select(*carried, "doc", "seq", "seg_id", "elements", "area_ix", "flat", "known", "loop_id", "run", "child_id", "sub", "inner_id", "qualifier", "is_trigger")
    occ_ix = F.when(~F.col("flat"), of.occurrences(doc)).cast("int").alias("occ_ix")
    return rows.select(*carried, "doc", "seq", "seg_id", "elements", "area_ix", "flat", "known", "loop_id", "run", "child_id", "sub", "inner_id", occ_ix, "qualifier", "is_trigger")


def business_segments(placed: DataFrame, definition: Definition) -> DataFrame:
    """doc, place (from 1), label, seq, seg_id, elements: segments depth first, as
    reports list them. An area's flat segments come first, then its loops, each with
    all its occurrences before those of the loops inside it. Flat segments bear their
    area's name, the loop of lines LOOP #n, other loops LOOP[qualifier] (? if there
    is none). A loop id is listed where the definition first names it."""
    ranks: dict[str, int] = {}

    def walk(loops) -> None:
        for x in loops:
            ranks.setdefault(x.trigger, len(ranks))
            walk(x.children)

    for i, a in enumerate(definition.areas):
        ranks[f"{i}"] = len(ranks)
        walk(a.loops)
    name = F.element_at(F.create_map(*(F.lit(x) for i, a in enumerate(definition.areas) for x in (i, a.name))), F.col("area_ix"))
    group = F.when(F.col("flat"), F.col("area_ix").cast("string")).otherwise(F.col("inner_id"))
    rank = F.try_element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), group)
    line = F.col("inner_id") == definition.line_loop.split("[")[0]
    label = F.when(F.col("flat"), name).when(line, F.concat("inner_id", F.lit(" #"), "occ_ix")).otherwise(F.concat("inner_id", F.lit("["), F.coalesce("qualifier", F.lit("?")), F.lit("]")))
    order = Window.partitionBy("doc").orderBy(rank, F.coalesce("occ_ix", F.lit(0)), "seq")
    return placed.select("doc", F.row_number().over(order).alias("place"), label.alias("label"), "seq", "seg_id", "elements")


def repeat_notes(placed: DataFrame, definition: Definition) -> DataFrame:
    """doc, loop_id, seq where a loop first passes its number of repeats."""
    most = {x.trigger: x.max_repeats for a in definition.areas for x in a.loops if x.max_repeats}
    limit = reduce(lambda c, kv: F.when(F.col("inner_id") == kv[0], kv[1]).otherwise(c), most.items(), F.lit(None).cast("int"))
    return placed.where(F.col("is_trigger") & (F.col("occ_ix") == limit + 1)).select("doc", F.col("inner_id").alias("loop_id"), "seq")


def unknown_segments(placed: DataFrame) -> DataFrame:
    """doc, seg_id, seq of the first of each segment id no area or loop names."""
    return placed.where(~F.col("known")).groupBy("doc", "seg_id").agg(F.min("seq").alias("seq"))


def hierarchy(placed: DataFrame, loop: str = "HL") -> DataFrame:
    """doc, seq, hl_id, level, parent_id, parent_seq, parent_level: the parent is the
    first earlier holder of the id. Holders and seekers of an id meet in a window, so
    that rows stay dealt by doc."""
    own = placed.where(F.col("is_trigger") & (F.col("seg_id") == loop)).select("doc", "seq", element(1).alias("hl_id"), element(2).alias("parent_id"), element(3).alias("level"))
    side = lambda c, holds: F.struct(F.col(c).alias("id"), F.lit(holds).alias("holds"))
    met = own.select("*", F.inline(F.array(side("hl_id", True), side("parent_id", False))))
    held = F.min(F.when(F.col("holds") & F.col("id").isNotNull(), F.struct("seq", "level"))).over(Window.partitionBy("doc", "id"))
    met = met.withColumn("held", held).where("not holds")
    early = F.col("held.seq") < F.col("seq")
    return met.select("doc", "seq", "hl_id", "level", "parent_id", F.when(early, F.col("held.seq")).alias("parent_seq"), F.when(early, F.col("held.level")).alias("parent_level"))


def hierarchy_errors(tree: DataFrame, definition: Definition, loop: str = "HL") -> DataFrame:
    """doc, seq, error: missing_id, duplicate_id, missing_level, unknown_level,
    orphan or nesting."""
    levels = next(x.levels for a in definition.areas for x in a.loops if x.trigger == loop)
    pairs = [f"{p}>{c}" for p, cs in levels.items() for c in cs]
    nth = F.row_number().over(Window.partitionBy("doc", "hl_id").orderBy("seq"))
    rows = tree.withColumn("nth", F.when(F.col("hl_id").isNotNull(), nth))
    error = (
        F.when(F.col("hl_id").isNull(), "missing_id").when(F.col("nth") > 1, "duplicate_id").when(F.col("level").isNull(), "missing_level")
        .when(~F.col("level").isin(*levels), "unknown_level").when(F.col("parent_id").isNotNull() & F.col("parent_seq").isNull(), "orphan")
        .when(F.col("parent_seq").isNotNull() & ~F.concat_ws(">", "parent_level", "level").isin(*pairs), "nesting")
    )
    return rows.select("doc", "seq", "hl_id", error.alias("error")).where(F.col("error").isNotNull())


def ancestors(tree: DataFrame) -> DataFrame:
    """doc, seq, distance, ancestor_seq, nearest first, at every depth: a round of
    joins finds the next ancestors, until one finds none. A parent stands before
    its children, so there are no cycles."""
    tree = share(tree.select("doc", "seq", "parent_seq").where("parent_seq is not null"))
    up = tree.select("doc", F.col("seq").alias("ancestor_seq"), F.col("parent_seq").alias("next"))
    found, d = [tree.select("doc", "seq", F.lit(1).alias("distance"), F.col("parent_seq").alias("ancestor_seq"))], 1
    while True:
        d += 1
        now = share(found[-1].join(up, ["doc", "ancestor_seq"]).select("doc", "seq", F.lit(d).alias("distance"), F.col("next").alias("ancestor_seq")))
        if now.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(now)
