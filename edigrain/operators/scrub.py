"""Masking of sensitive elements: redact or pseudonymise, byte for byte."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.x12 import quoted


@dataclass(frozen=True)
class Mask:
    segment: str
    element: int
    strategy: str = "redact"  # or pseudonymize
    when: tuple[int, tuple[str, ...]] | None = None  # (element, values)


def redact(c: Column) -> Column:
    return F.regexp_replace(c, "[\\p{L}\\p{N}]", "X")


def pseudonymize(c: Column, salt: str) -> Column:
    """Digits and letters drawn, in turn, from the bytes of SHA-256 of salt, NUL and
    value, and then of the SHA-256 of the bytes before; all else stays."""
    drawn = F.length(F.regexp_replace(c, "[^\\p{Nd}\\p{L}]", ""))
    first = F.sha2(F.concat(F.lit(salt), F.lit("\0"), c).cast("binary"), 256)
    more = F.when(drawn > 32, F.sequence(F.lit(2), F.ceil(drawn / 32).cast("int"))).otherwise(F.array().cast("array<int>"))
    stream = F.aggregate(more, first, lambda a, _: F.concat(a, F.sha2(F.unhex(F.right(a, F.lit(64))), 256)))

    def put(a: Column, ch: Column) -> Column:
        byte = F.conv(F.substring(a["hex"], a["at"] * 2 + 1, F.lit(2)), 16, 10).cast("int")
        digit, letter = ch.rlike("^\\p{Nd}$"), ch.rlike("^\\p{L}$")
        new = F.when(digit, (byte % 10).cast("string")).when(letter, F.char(byte % 26 + 65)).otherwise(ch)
        return F.struct(F.concat(a["text"], new).alias("text"), (a["at"] + (digit | letter).cast("int")).alias("at"), a["hex"].alias("hex"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), stream.alias("hex"))
    return F.aggregate(F.split(c, ""), start, put, lambda a: a["text"])


def _put(elements: str, at: int, value: Column) -> Column:
    return F.transform(elements, lambda e, i: F.when(i == at, value).otherwise(e))


def scrub(segments: DataFrame, masks: list[Mask], salt: str = "") -> DataFrame:
    """Segments with masked elements; everything else as it was."""
    out = segments
    for m in masks:
        hit = F.col("seg_id") == m.segment
        if m.when:
            hit = hit & F.coalesce(F.get("elements", m.when[0] - 1).isin(*m.when[1]), F.lit(False))
        hit = hit & (F.size("elements") >= m.element)
        value = F.get("elements", m.element - 1)
        masked = redact(value) if m.strategy == "redact" else pseudonymize(value, salt)
        changed = _put("elements", m.element - 1, F.col("masked"))
        out = out.withColumn("masked", F.when(hit, masked)).withColumn("elements", F.when(hit, changed).otherwise(F.col("elements"))).drop("masked")
    return out


def reassemble(segments: DataFrame, separator: str = "*", terminator: str = "~") -> DataFrame:
    """(file_id, text) of segments: each file's scrubbed text."""
    line = F.array_join(F.concat(F.array("seg_id"), "elements"), separator)
    own = segments.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("s"))
    return own.select("file_id", F.concat(F.array_join(F.transform("s", lambda x: x["line"]), terminator), F.lit(terminator)).alias("text"))


#: The elements of the envelope that name trading partners.
ENVELOPE = (Mask("ISA", 6, "pseudonymize"), Mask("ISA", 8, "pseudonymize"), Mask("GS", 2, "pseudonymize"), Mask("GS", 3, "pseudonymize"))


def _bind(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scrub_text(files: DataFrame, masks: list[Mask], salt: str = "", envelope: bool = True) -> DataFrame:
    """(file_id, text, n_masked) of (file_id, text): masked values are put where they
    were, and all else stays byte for byte - delimiters of whatever kind, line breaks
    between segments, text around the interchange. Masks keep a value's length, so
    the fixed columns of ISA stay too. n_masked counts the elements that changed.
    Text without an interchange header is an error of the file: its text is null.
    Each file is one row and one expression; nothing is shuffled."""
    by_segment: dict[str, list[Mask]] = {}
    for m in [*masks, *(ENVELOPE if envelope else ())]:
        by_segment.setdefault(m.segment, []).append(m)
    none = F.struct(F.lit(None).cast("string").alias("raw"), F.lit(0).alias("n"))

    def masked(fields: Column, m: Mask) -> Column:
        value = F.get(fields, m.element)
        new = redact(value) if m.strategy == "redact" else pseudonymize(value, salt)
        on = F.size(fields) > m.element
        return F.when(on & F.coalesce(F.get(fields, m.when[0]).isin(*m.when[1]), F.lit(False)) if m.when else on, new)

    def put(state: Column, m: Mask) -> Column:
        return _bind(F.struct(state.alias("s"), masked(state["fields"], m).alias("new")), lambda x: F.struct(
            F.when(x["new"].isNull(), x["s"]["fields"]).otherwise(F.transform(x["s"]["fields"], lambda e, i: F.when(i == m.element, x["new"]).otherwise(e))).alias("fields"),
            (x["s"]["n"] + F.coalesce((x["new"] != F.get(x["s"]["fields"], m.element)).cast("int"), F.lit(0))).alias("n"),
        ))

    def one(raw: Column, sep: Column) -> Column:
        lead = F.regexp_extract(raw, "^[\\r\\n \\t]*", 0)
        fields = F.split(F.substring(raw, F.length(lead) + 1, F.length(raw)), quoted(sep), -1)

        def of(fields: Column) -> Column:
            out = none
            for segment, own in by_segment.items():
                state = F.struct(fields.alias("fields"), F.lit(0).alias("n"))
                for m in own:
                    state = put(state, m)
                done = _bind(state, lambda x: F.struct(F.concat(lead, F.call_function("array_join", x["fields"], sep)).alias("raw"), x["n"].alias("n")))
                out = F.when(F.get(fields, 0) == segment, done).otherwise(out)
            return out

        return _bind(fields, of)

    at = F.instr("text", "ISA")
    own = files.select("file_id", "text", F.when((at > 0) & (F.length("text") >= at + 105), at).alias("at"))
    own = own.select("file_id", "text", F.substring("text", F.col("at") + 3, F.lit(1)).alias("sep"), F.substring("text", F.col("at") + 105, F.lit(1)).alias("term"), "at")
    # the text before the header is not part of its segment
    parts = F.split(F.substring("text", F.col("at"), F.length("text")), quoted(F.col("term")), -1)
    own = own.withColumn("raws", parts).withColumn("made", F.transform("raws", lambda r: one(r, F.col("sep"))))
    text = F.call_function("array_join", F.transform(F.arrays_zip("raws", "made"), lambda x: F.coalesce(x["made"]["raw"], x["raws"])), F.col("term"))
    return own.select("file_id", F.concat(F.substring("text", F.lit(1), F.col("at") - 1), text).alias("text"), F.when(F.col("at").isNotNull(), F.aggregate("made", F.lit(0), lambda a, x: a + x["n"])).alias("n_masked"))


def mask_report(segments: DataFrame, masks: list[Mask]) -> DataFrame:
    """segment, element, n, n_distinct of the non-empty values to be masked."""
    rules = []
    for m in masks:
        hit = F.col("seg_id") == m.segment
        if m.when:
            hit = hit & F.coalesce(F.get("elements", m.when[0] - 1).isin(*m.when[1]), F.lit(False))
        rules.append(F.when(hit, F.struct(F.lit(m.segment).alias("segment"), F.lit(m.element).alias("element"), F.nullif(F.get("elements", m.element - 1), F.lit("")).alias("value"))))
    own = segments.select(F.explode(F.array(*rules)).alias("m")).where("m.value is not null").select("m.*")
    return own.groupBy("segment", "element").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))
