"""The outbound direction: documents are the source, X12 is the target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..plans.spec import Format, Rule, Spec, parse_condition, parse_format, parse_outcome
from ..plans.transactions import Definition
from .judge import MISMATCH, holds, line_reads, paired_lines
from .scopes import cells, finish_read, first_read, leaves, loop_ids

NEUTRAL = Format()


class Reads:
    """The paths that rules read, as columns in steps: the variant, then its text and
    type, so that none is worked out twice. Absent, null and empty are all nothing."""

    def __init__(self, rules: list[Rule]):
        own = [n for r in rules if r.kind != "LOOP_COUNT" for n in [r.source, *(t.name for t in (parse_condition(r.condition) if r.condition else ()))] if n]
        self.names = {path: f"r{i}" for i, path in enumerate(dict.fromkeys(own))}

    def add(self, rows: DataFrame, read) -> DataFrame:
        """read(path) is a variant."""
        rows = rows.withColumns({n: read(path) for path, n in self.names.items()})
        return rows.withColumns({n + k: c for n in self.names.values() for k, c in (("t", F.nullif(F.try_variant_get(n, "$", "string"), F.lit(""))), ("l", F.schema_of_variant(n)))})

    def text(self, path: str) -> Column:
        return F.col(self.names[path] + "t")

    def leaf(self, path: str) -> Column:
        return F.col(self.names[path] + "l")


def expected(rule: Rule, spec: Spec, reads: Reads, count: Column) -> tuple[Column, Column]:
    """(kind, typed value). The format describes the target, so the source reads by
    its type alone, and literals read as the target does."""
    fmt = parse_format(rule.fmt)
    none = values.typed_x12(F.lit(None).cast("string"), rule.data_type, fmt)
    literal = lambda text: (F.lit("value"), values.typed_x12(F.lit(text), rule.data_type, fmt))
    text = reads.text

    def source() -> tuple[Column, Column]:
        raw = text(rule.source)
        if rule.kind == "CODE_LIST":
            got = F.try_element_at(F.create_map(*(F.lit(x) for kv in spec.code_lists[rule.code_list].items() for x in kv)), raw)
            typed = values.typed_x12(got, rule.data_type, fmt)
        else:
            typed = values.typed_actual(raw, reads.leaf(rule.source), rule.data_type, NEUTRAL)
        kind = F.when(raw.isNull(), "untestable").when(typed.isNull(), "source_defect").otherwise("value")
        if rule.default is not None:
            k, v = literal(rule.default)
            kind, typed = F.when(raw.isNull(), k).otherwise(kind), F.when(raw.isNull(), v).otherwise(typed)
        return kind, typed

    if rule.kind == "CONSTANT":
        return literal(rule.default)
    if rule.kind == "LOOP_COUNT":
        return F.lit("value"), count.cast("string")
    if rule.kind == "TODO":
        return F.lit("untestable"), none
    if rule.kind == "CONDITIONAL":
        def branch(outcome: str) -> tuple[Column, Column]:
            what, lit = parse_outcome(outcome)
            return source() if what == "SOURCE" else literal(lit) if what == "LITERAL" else (F.lit("absent" if what == "SKIP" else "empty"), none)

        yes = holds(parse_condition(rule.condition), text)
        (k1, v1), (k2, v2) = branch(rule.then), branch(rule.otherwise)
        return F.when(yes, k1).otherwise(k2), F.when(yes, v1).otherwise(v2)
    return source()


def _judged(rows: DataFrame, rules: list[tuple[Rule, Column, Column, Column]], line: Column, extra: Column) -> DataFrame:
    """Findings of (rule, kind, value, element) over rows, in steps that read
    columns of the step before. Rows where `extra` holds have no source entry."""
    rows = rows.withColumns({f"{p}{i}": c for i, (_, *own) in enumerate(rules) for p, c in zip("kva", own)})
    rows = rows.withColumns({f"y{i}": values.typed_x12(F.col(f"a{i}"), r.data_type, parse_format(r.fmt)) for i, (r, *_) in enumerate(rules)})

    def one(i: int, r: Rule) -> Column:
        k, v, a, y = (F.col(f"{p}{i}") for p in "kvay")
        fmt = parse_format(r.fmt)
        there = a.isNotNull()
        bad = y.isNull() | (values.wrong_places(a, fmt) if r.data_type == "decimal" and fmt.implied is None else F.lit(False)) | values.wrong_length(a, fmt)
        wrong = MISMATCH.get(r.kind, "value_mismatch")
        say = lambda s, c="": F.lit(f"{s}|{c}")
        code = (
            F.when(extra, F.when(there, say("FAIL", "count_mismatch"))).when(F.lit(r.kind == "TODO"), say("NOT TESTED"))
            .when(k == "source_defect", say("FAIL", "source_data")).when(k == "untestable", F.when(there, say("FAIL", "unexpected_output")).otherwise(say("NOT TESTED")))
            .when(k == "absent", F.when(there, say("FAIL", wrong)).otherwise(say("PASS"))).when(k == "empty", say("NOT TESTED"))
            .when(~there, say("FAIL", "constant_default" if r.kind == "CONSTANT" else "missing_output")).when(bad, say("FAIL", "format"))
            .when(~F.coalesce(values.same(y, v, r.data_type, fmt), F.lit(False)), say("FAIL", wrong)).otherwise(say("PASS"))
        )
        return F.struct(code.alias("code"), F.lit(r.row_id).alias("row_id"), F.lit(r.source).cast("string").alias("source_ref"), F.lit(r.target).alias("target"), v.cast("string").alias("expected"), a.alias("actual"))

    found = rows.select("doc", line.cast("int").alias("line_ix"), F.explode(F.array(*(one(i, r) for i, (r, *_) in enumerate(rules)))).alias("f")).where("f.code is not null")
    return found.select("doc", F.substring_index("f.code", "|", 1).alias("status"), F.nullif(F.substring_index("f.code", "|", -1), F.lit("")).alias("category"), "f.row_id", "f.source_ref", "f.target", "line_ix", "f.expected", "f.actual")


def header_findings(placed: DataFrame, docs: DataFrame, spec: Spec, definition: Definition) -> DataFrame:
    """Verdicts of the rules whose element is read once in a transaction; empty and
    absent elements are both missing."""
    rules = [r for r in spec.rules if not r.is_line]
    aggs = [F.count("*").alias("n_segments")]
    for i, r in enumerate(rules):
        first, found = first_read(r.target, r.context, definition)
        aggs += [first.alias(f"p{i}"), found.alias(f"q{i}")]
    reads = Reads(rules)
    rows = reads.add(docs.join(placed.groupBy("doc").agg(*aggs), "doc"), lambda path: F.try_variant_get("v", f"$.{path}", "variant"))
    count = lambda r: F.coalesce(F.expr(f"size(try_variant_get(v, '$.{(r.source or '').removesuffix('[]')}', 'array<variant>'))"), F.lit(0))
    own = [(r, *expected(r, spec, reads, count(r) if r.kind == "LOOP_COUNT" else F.lit(None)), finish_read(f"p{i}", f"q{i}", r.target)) for i, r in enumerate(rules)]
    return _judged(rows, own, F.lit(None), F.lit(False))


def line_findings(placed: DataFrame, docs: DataFrame, spec: Spec, definition: Definition) -> DataFrame:
    """Verdicts of the rules read for each entry of the list, paired by position
    with the occurrences of the line loop, both ways; an occurrence without an
    entry is a wrong count for each element it holds."""
    rules = [r for r in spec.rules if r.is_line]
    reads, head = Reads(rules), f"{spec.list_path}[]."
    # what lines read of their document is read once for all of them
    lent = {path: f"h{i}" for i, path in enumerate(p for p in reads.names if not p.startswith(head))}
    docs = docs.withColumns({n: F.try_variant_get("v", f"$.{path}", "variant") for path, n in lent.items()})
    rows = paired_lines(line_reads(placed, definition, sorted({r.target for r in rules})), docs, spec.list_path, *lent.values(), place="run")
    rows = reads.add(rows, lambda path: F.col(lent[path]) if path in lent else F.try_variant_get("item", "$." + path.removeprefix(head), "variant"))
    return _judged(rows, [(r, *expected(r, spec, reads, F.lit(None)), F.col(r.target)) for r in rules], F.col("line_ix"), F.col("item").isNull())


def unmapped_source(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc, norm_path, concrete_path, leaf_text of leaves that no rule and no
    condition reads; a rule that counts a list reads none of its leaves."""
    read = {r.source for r in spec.rules if r.source and r.kind != "LOOP_COUNT"} | {t.name for r in spec.rules if r.condition for t in parse_condition(r.condition)}
    return leaves(docs).where(~F.col("norm_path").isin(*sorted(read))).select("doc", "norm_path", "concrete_path", "leaf_text")


def unmapped_target(placed: DataFrame, spec: Spec, definition: Definition) -> DataFrame:
    """doc, seq, seg_id, elem_ix, value of elements that no rule produces;
    qualifiers that a rule's context names count as produced."""
    tests = [F.lit(False)]
    for r in spec.rules:
        context = definition.line_loop if r.is_line else r.context
        name, _, code = context.partition("[")
        inside = F.lit(True) if name in loop_ids(definition) else F.col("flat")
        if code:
            inside = inside & (F.coalesce(F.col("qualifier"), F.col("first")) == code.rstrip("]"))
            tests.append(inside & (F.col("seg_id") == name) & (F.col("elem_ix") == 1))
        tests.append(inside & (F.col("seg_id") == r.target[:-2]) & (F.col("elem_ix") == int(r.target[-2:])))
    made = F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))
    return cells(placed).where(~made).select("doc", "seq", "seg_id", "elem_ix", "value")
