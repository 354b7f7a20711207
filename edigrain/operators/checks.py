"""Checks of whole documents: presence, reconciliation, counts, sweeps, pairing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import Spec, split_context, split_element
from ..plans.transactions import Definition, Presence
from ..sources.x12 import element
from .judge import referenced
from .scopes import cells, finish_read, first_read, leaves, opens, selects


def required_elements(placed: DataFrame, definition: Definition) -> DataFrame:
    """doc, seq, segment, elem_ix of required elements that are empty."""
    out = []
    for segment, at, *when in definition.required_elements:
        missing = (F.col("seg_id") == segment) & element(at).isNull()
        if when:
            missing = missing & element(when[0]).isNotNull()
        out.append(placed.where(missing).select("doc", "seq", F.lit(segment).alias("segment"), F.lit(at).alias("elem_ix")))
    return reduce(DataFrame.unionByName, out)


def required_segments(placed: DataFrame, docs: DataFrame, wanted: list[tuple[str, str | None]]) -> DataFrame:
    """doc, segment, code of required segments (id, code in element 01 or None)
    of which a document has none."""
    spark = placed.sparkSession
    rules = docs.select("doc").crossJoin(F.broadcast(spark.createDataFrame(wanted, "segment string, code string")))  # a few rules
    held = placed.select("doc", F.col("seg_id").alias("segment"), element(1).alias("first"))
    fits = (rules.doc == held.doc) & (rules.segment == held.segment) & (rules.code.isNull() | (rules.code == held["first"]))
    return rules.join(held, fits, "left_anti")


def required_pairs(placed: DataFrame, segment: str, first: int, last: int, step: int, code: str) -> DataFrame:
    """doc, seq of segments without `code` in a qualifier slot followed by a value."""
    slots = F.sequence(F.lit(first), F.lit(last), F.lit(step))
    has = F.exists(slots, lambda p: (F.get("elements", p - 1) == code) & (F.coalesce(F.get("elements", p), F.lit("")) != ""))
    return placed.where((F.col("seg_id") == segment) & ~F.coalesce(has, F.lit(False))).select("doc", "seq")


def _within(rule: Presence) -> Column:
    """Rows that a presence rule looks at."""
    on = F.col("seg_id") == rule.segment
    if rule.codes:
        on = on & element(rule.at).isin(*rule.codes)
    if rule.loop:
        name, q = split_context(rule.loop)[0]
        on = on & (F.col("inner_id") == name) & (F.col("qualifier") == q if q else F.lit(True))
    if rule.when:
        on = on & element(rule.when).isNotNull() & (element(rule.when).isin(*rule.values) if rule.values else F.lit(True))
    return F.coalesce(on, F.lit(False))


def presence(placed: DataFrame, rules: list[Presence]) -> DataFrame:
    """doc, seq (null for a segment that is absent), label, loop, origin of what
    presence rules miss. Elements are looked up row by row; segments by one
    aggregate over a document for all rules."""
    note = lambda r: F.struct(F.lit(r.label).alias("label"), F.lit(r.loop).alias("loop"), F.lit(r.origin).alias("origin"))
    none = F.array().cast("array<struct<label:string,loop:string,origin:string>>")
    each, once = [r for r in rules if r.element], [r for r in rules if not r.element]
    empty = F.concat(none, *(F.when(_within(r) & element(r.element).isNull(), F.array(note(r))).otherwise(none) for r in each))
    own = placed.where(F.col("seg_id").isin(*{r.segment for r in each})) if each else placed.limit(0)
    held = placed.groupBy("doc").agg(F.count("*"), *(F.max(_within(r)).alias(f"r{i}") for i, r in enumerate(once)))
    absent = F.concat(none, *(F.when(~F.col(f"r{i}"), F.array(note(r))).otherwise(none) for i, r in enumerate(once)))
    out = own.select("doc", "seq", F.explode(empty).alias("n")).unionByName(held.select("doc", F.lit(None).cast("long").alias("seq"), F.explode(absent).alias("n")))
    return out.select("doc", "seq", "n.*")


def _number(c: Column, implied: int = 0) -> Column:
    own = F.when(c.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), c.try_cast("decimal(38,10)"))
    return F.try_divide(own, F.lit(10**implied)).try_cast("decimal(38,10)") if implied else own


class Operands:
    """Operands compiled to aggregates over a transaction. Products need a value
    for each occurrence first, so everything is summed over occurrences."""

    def __init__(self, definition: Definition):
        self.definition = definition
        self.per_run: dict[str, Column] = {}
        self.per_doc: dict[str, Column] = {}

    def _name(self, into: dict[str, Column], c: Column) -> str:
        name = f"x{len(self.per_run)}_{len(self.per_doc)}"
        into[name] = c
        return name

    def compile(self, op: tuple, implied: int = 0):
        """A function that gives the operand's column after aggregation."""
        kind = op[0]
        if kind == "implied":
            return self.compile(op[2], op[1])
        if kind == "value":
            source, context = op[1], op[2] if len(op) > 2 else ""
            first, found = first_read(source, context, self.definition)
            a, b = self._name(self.per_doc, first), self._name(self.per_doc, found)
            return lambda: _number(finish_read(a, b, source), implied), lambda: finish_read(a, b, source)
        if kind == "count":
            a = self._name(self.per_doc, F.count_if(opens(op[1], self.definition)))
            return lambda: F.col(a).cast("decimal(38,10)"), lambda: F.col(a)
        if kind == "sum":
            seg, at = split_element(op[2])
            own = selects(op[1], self.definition) & (F.col("seg_id") == seg)
            a = self._name(self.per_doc, F.try_sum(F.when(own, _number(F.get("elements", at - 1), implied))))
            return lambda: F.col(a), lambda: F.col(a)
        if kind == "product":
            names = []
            for source in op[2:]:
                seg, at = split_element(source)
                own = selects(op[1], self.definition) & (F.col("seg_id") == seg)
                names.append(self._name(self.per_run, F.min_by(_number(F.get("elements", at - 1), implied), F.when(own, F.col("seq")))))
            a = self._name(self.per_doc, F.lit(None))
            self.per_doc[a] = ("product", names)
            return lambda: F.col(a), lambda: F.col(a)
        add, subtract = [self.compile(x) for x in op[1]], [self.compile(x) for x in op[2]]
        none = F.lit(0).cast("decimal(38,10)")
        total = lambda: reduce(lambda c, x: F.try_subtract(c, F.coalesce(x[0](), none)).try_cast("decimal(38,10)"), subtract, reduce(lambda c, x: F.try_add(c, F.coalesce(x[0](), none)).try_cast("decimal(38,10)"), add, none))
        return total, total


def reconcile(placed: DataFrame, definition: Definition) -> DataFrame:
    """doc, rule, status, left_value, right_value of the rules that a
    transaction breaks; operands that cannot be resolved keep a rule silent."""
    ops = Operands(definition)
    plans = [(r, ops.compile(r.left), ops.compile(r.right), ops.compile(r.when) if r.when else None) for r in definition.recon]
    plain = {k: v for k, v in ops.per_doc.items() if not isinstance(v, tuple)}
    wide = placed.groupBy("doc").agg(*(c.alias(k) for k, c in plain.items())) if plain else placed.select("doc").distinct()
    if ops.per_run:
        each = placed.where(F.col("run").isNotNull()).groupBy("doc", "run").agg(*(c.alias(k) for k, c in ops.per_run.items()))
        sums = [F.try_sum(reduce(F.try_multiply, (F.col(n).try_cast("decimal(28,6)") for n in v[1]))).alias(k) for k, v in ops.per_doc.items() if isinstance(v, tuple)]
        wide = wide.join(each.groupBy("doc").agg(*sums), "doc", "left")

    def one(r, left, right, when) -> Column:
        a, b = left[0](), right[0]()
        broken = a != b if r.check == "equals" else a > b
        guard = when[1]().isNotNull() if when else F.lit(True)
        return F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("status"), a.try_cast("decimal(28,2)").alias("left_value"), b.try_cast("decimal(28,2)").alias("right_value"), F.coalesce(broken & guard, F.lit(False)).alias("broken"))

    return wide.select("doc", F.explode(F.array(*(one(*p) for p in plans))).alias("r")).where("r.broken").select("doc", "r.rule", "r.status", "r.left_value", "r.right_value")


def reconcile_sets(placed: DataFrame, definitions: dict[str, Definition]) -> DataFrame:
    """doc, set_code and what `reconcile` finds, for placed rows of many sets: each
    set is reconciled by its own rules. Placed rows should be shared: each set with
    rules reads its own."""
    out = [reconcile(placed.where(F.col("set_code") == d.set_code), d).withColumn("set_code", F.lit(d.set_code)) for d in definitions.values() if d.recon]
    return reduce(DataFrame.unionByName, out)


def line_counts(placed: DataFrame, docs: DataFrame, definition: Definition, list_path: str = "lines") -> DataFrame:
    """doc, source_lines, output_lines where they differ."""
    own = placed.groupBy("doc").agg(F.count_if(opens(definition.line_loop, definition)).alias("source_lines"))
    out = docs.select("doc", F.coalesce(F.expr(f"size(try_variant_get(v, '$.{list_path}', 'array<variant>'))"), F.lit(0)).cast("long").alias("output_lines"))
    return own.join(out, "doc").where("source_lines != output_lines")


def unmapped_source(placed: DataFrame, spec: Spec, definition: Definition) -> DataFrame:
    """doc, seq, seg_id, elements: non-empty elements that no rule reads, listed
    for each segment."""
    free = cells(placed).where(~F.coalesce(referenced(spec, definition), F.lit(False)))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("elem_ix", "value"))), lambda x: F.concat(F.lpad(x["elem_ix"].cast("string"), 2, "0"), F.lit("="), x["value"])), ",")
    return free.groupBy("doc", "seq", "seg_id").agg(names.alias("elements"))


def unmapped_target(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc, concrete_path, leaf_text of output leaves that no rule produces."""
    return leaves(docs).where(~F.col("norm_path").isin(*(r.target for r in spec.rules))).select("doc", "norm_path", "concrete_path", "leaf_text")


def pair(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, issues) of (doc, key) on both sides: the first document of a key
    is paired; further ones are reported once a side, and so is what is left.
    Each document without a key is an issue of its own."""
    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        none = df.where("key is null").select("key", F.lit(f"no_key_{name}").alias("issue"))
        w = Window.partitionBy("key").orderBy("doc")
        own = df.where("key is not null").withColumn("nth", F.row_number().over(w)).withColumn("of", F.count("*").over(Window.partitionBy("key")))
        dup = own.where("nth = 2").select("key", F.lit(f"duplicate_{name}").alias("issue"))
        return own.where("nth = 1").select("key", F.col("doc").alias(f"{name}_doc")), dup.unionByName(none)

    (s, ds), (t, dt) = side(source, "source"), side(target, "target")
    both = s.join(t, "key", "full_outer")
    lost = both.where(F.col("source_doc").isNull() | F.col("target_doc").isNull()).select("key", F.when(F.col("source_doc").isNull(), "unmatched_target").otherwise("unmatched_source").alias("issue"))
    return both.where(F.col("source_doc").isNotNull() & F.col("target_doc").isNotNull()), lost.unionByName(ds).unionByName(dt)
