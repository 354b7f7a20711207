"""Partner guides as text: pages to lines, lines to segments, elements and codes.

All guides are read at once. A line's meaning depends on the lines before it in
its guide, so the lines of a guide are ordered in one task, and running windows
carry what is open: the segment block, the element table, notes. What cannot be
read is a row of `reviews`; nothing is guessed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.store import share

# The line forms of tabular guides, in the order in which they are tried.
FORMS = {
    "segment": r"^Segment:\s*\S",
    "id": r"^[A-Z][A-Z0-9]{1,2}$",
    "position": r"^Position:\s*(\S+)$",
    "level": r"^Level:\s*(Heading|Detail|Summary)$",
    "loop": r"^Loop:\s*([A-Z][A-Z0-9]{0,2})?(\s+\S.*)?$",
    "usage": r"^Usage:\s*(.+)$",
    "max": r"^Max Use:\s*(\S+)$",
    "standard": r"^(Purpose|Syntax Notes|Comments):",
    "notes": r"^Notes:",
    "table": r"^Data Element Summary$",
    "head": r"^(Ref\.|Des\.)\s",
    "element": r"^([A-Z][A-Z0-9]{1,2}[0-9]{2})\s+([0-9]+)\s+(.+?)\s+([MOCX])\s+([A-Z][A-Z0-9]{0,2})\s+([0-9]+)/([0-9]+)(?:\s+([MOCX]))?$",
    "torn": r"^[A-Z][A-Z0-9]{1,2}[0-9]{2}\b",
}
# The line forms of templated guides, in the order in which they are tried.
TEMPLATE = {
    "header": r"^([A-Z][A-Z0-9]{1,2})\s+(.+?)\s+Pos:\s*(\S+)\s+Max:\s*(\S+)$",
    "box": r"^Pos:\s*(\S+)\s+Max:\s*(\S+)$",
    "area": r"^((Heading|Detail|Summary)\s*-\s*(Mandatory|Optional)|Example:?)$",
    "loop": r"^(.*?)\s*Loop:\s*(\S+)(\s+Elements:\s*[0-9]+)?$",
    "usage": r"^User Option \(Usage\):\s*(.+)$",
    "summary": r"^Element Summary:?$",
    "list": r"^Code List Summary",
    "head": r"^Code\s+Name$",
    "about": r"^Description:",
    "note": r"^[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)? Note:\s*(.+)$",
    "element": r"^([A-Z][A-Z0-9]{1,2}[0-9]{2})\s+([0-9]+)\s+(.+?)\s+([MOCX])\s+([A-Z][A-Z0-9]{0,2})\s+([0-9]+)/([0-9]+)\s+(Must use|Used|Not used|Not Used)$",
    "torn": r"^[A-Z][A-Z0-9]{1,2}[0-9]{2}\b",
}
# The line forms of terse guides, in the order in which they are tried.
TERSE = {
    "segment": r"^Segment\s+([A-Z][A-Z0-9]{1,2})\s*[–—-]\s*(.+?)\s*$",
    "level": r"^Level\s+(Heading|Detail|Summary)\s*$",
    "max": r"^Max\.?\s*Use\s+(\S+)",
    "table": r"^ID\s+ELEMENT\s+NAME\s+FEATURES\s+COMMENTS\s*$",
    "comments": r"^Comments\b\s*(.*)$",
    "standard": r"^(Purpose|Syntax Notes|Examples?)\b",
    "element": r"^([A-Z][A-Z0-9]{1,2}[0-9]{2})\s+(.+?)\s+([MONCX])(?:\s+([A-Z][A-Z0-9]{0,2})\s+([0-9]+)/([0-9]+))?(?:\s+(.*\S))?\s*$",
    "torn": r"^[A-Z][A-Z0-9]{1,2}[0-9]{2}\b",
}
TERSE_AREA = r"^Data Segment Sequence for\b"
TERSE_INDEX_HEAD = r"^(Seg\.|ID\s+Use|GLOSSARY\b)"
TERSE_INDEX_ROW = r"^([A-Z][A-Z0-9]{1,2})\s+(?:.*?\s)??([MOC])\s+>?[0-9]+(?:\s+([A-Z][A-Z0-9]{0,2})(?=\s|$).*|\s.*)?$"
TERSE_FOOTER = r"(^-\s*[0-9]+\s*-\s*$|[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}\s*$|^Page [0-9]+)"
TERSE_CODE = r"[“”\"]?([A-Z0-9]{1,4})[“”\"]?\s*[=–—-]\s*(.+?)(?=\s+[“”\"]?[A-Z0-9]{1,4}[“”\"]?\s*[=–—-]\s|$)"
TERSE_CODE_LINE = r"^[“”\"]?[A-Z0-9]{1,4}[“”\"]?\s*[=–—-]\s"
TERSE_WORDS = {"M": "must_use", "O": "used", "C": "used", "X": "used", "N": "not_used"}
# Further line forms, words and segments of these guides.
BOX_NAME = r"^([A-Z][A-Z0-9]{1,2})\s+([A-Z(].*)$"
OPTION_WORDS = {"must use": "must_use", "used": "used", "not used": "not_used"}
INDEX_ROW = r"^[0-9]{1,3}\s+([0-9]{2,4})\s+([A-Z][A-Z0-9]{1,2})\s+.+?\s+(?:[MOCX]\s+)?([MOCX])\s+>?[0-9]+$"
INDEX_LIKE = r"^[0-9]{1,3}\s+[0-9]{2,4}\s+[A-Z][A-Z0-9]{1,2}\s+.+$"
INDEX_HEAD = r"^(Page\s+Pos\.|No\.\s+No\.|LOOP ID\b|Heading:|Detail:|Summary:)"
FOOTER = r"([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}$|^Page [0-9]+( of [0-9]+)?$)"
CODE_ROW = r"^([A-Z0-9]{1,10})\s+(\S.*)$"
RAW_SAMPLE = r"[A-Z][A-Z0-9]{1,2}[|*][^ ]"
USAGE_WORDS = {"mandatory": "must_use", "optional": "used", "conditional": "used", "not used": "not_used"}
#: Segments whose element 01 says which of a family they are, and those that carry
#: pairs of qualifier and value: first and last qualifier, step.
FAMILIES = ("REF", "DTM", "N1", "N9", "SAC", "AMT", "PER", "FOB")
PAIRED = {"PO1": (6, 24, 2), "IT1": (6, 24, 2)}


def guide_lines(files: DataFrame, blank: bool = False) -> DataFrame:
    """(file_id, text) to file_id, page (from 1, by form feeds), line, text; blank
    lines are left out unless asked for (templated guides end code lists by them)."""
    pages = files.select("file_id", F.posexplode(F.split("text", "\f")).alias("page", "body"))
    rows = pages.select("file_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\r?\n")).alias("line", "text"))
    return rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.lit(blank) | (F.col("text") != ""))


def _structural() -> Column:
    forms = [p for k, p in FORMS.items() if k not in ("id", "torn")] + [INDEX_LIKE, INDEX_HEAD]
    return reduce(lambda a, b: a | b, (F.col("text").rlike(p) for p in forms))


def strip_furniture(lines: DataFrame, structural: Column | None = None, footer: str = FOOTER) -> DataFrame:
    """Lines without running heads (the same text on half the pages and on three,
    in guides of four pages or more, unless it is structure) and without page feet
    (a page's last line that is a date or a page number)."""
    size = lines.groupBy("file_id").agg(F.max("page").alias("pages"))
    seen = lines.groupBy("file_id", "text").agg(F.count_distinct("page").alias("n")).join(size, "file_id")
    heads = seen.where((F.col("pages") >= 4) & (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2))) & ~(_structural() if structural is None else structural)).select("file_id", "text")
    last = F.max("line").over(Window.partitionBy("file_id", "page"))
    body = lines.withColumn("foot", (F.col("line") == last) & F.col("text").rlike(footer)).where(~F.col("foot")).drop("foot")
    return body.join(heads, ["file_id", "text"], "left_anti").select(*lines.columns)


def read_tabular(lines: DataFrame) -> DataFrame:
    """Lines with what they are: file_id, seq, page, text, kind, block (number of the
    segment block, 0 before the first), seg_id (null if its block names none), row
    (number of the element row that is open) and the open element's ref and type."""
    own = Window.partitionBy("file_id").orderBy("page", "line")
    rows = lines.withColumn("seq", F.row_number().over(own))
    kind = reduce(lambda c, kp: c.when(F.col("text").rlike(kp[1]), kp[0]), FORMS.items(), F.when(F.lit(False), "")).otherwise("other")
    rows = rows.withColumn("kind", kind)
    upto = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("kind") == "segment"
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(upto).cast("int"))
    rows = rows.withColumn("named", F.max(F.when(F.col("kind") == "id", F.struct("seq", "text"))).over(before)).withColumn("opened", F.coalesce(F.max(F.when(opens, F.col("seq"))).over(before), F.lit(0)))
    rows = rows.withColumn("own_id", F.when(opens & (F.col("named.seq") > F.col("opened")), F.col("named.text")))
    block = Window.partitionBy("file_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seg_id", F.max("own_id").over(block)).withColumn("in_table", F.max(F.col("kind") == "table").over(block))
    keyed = F.col("kind").isin("segment", "id", "position", "level", "loop", "usage", "max", "standard", "notes", "table")
    noting = F.last(F.when(keyed, F.col("kind") == "notes"), True).over(block)
    rows = rows.withColumn("kind", F.when(~keyed & noting, "note").when(~keyed & ~F.col("in_table"), "prose").otherwise(F.col("kind")))
    marks = F.col("kind").isin("element", "torn")
    rows = rows.withColumn("row", F.sum(marks.cast("int")).over(block).cast("int"))
    part = lambda i: F.regexp_extract("text", FORMS["element"], i)
    open_ = Window.partitionBy("file_id", "block", "row").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.max(F.when(F.col("kind") == "element", F.struct(part(1).alias("ref"), part(5).alias("type")))).over(open_)
    rows = rows.withColumn("el", first)
    return rows.select("file_id", "seq", "page", "text", "kind", "block", "seg_id", "row", F.col("el.ref").alias("ref"), F.col("el.type").alias("type"))


def position(ref: str, seg_id: str) -> Column:
    """Element 3 of BEG for BEG03; null if ref is another segment's."""
    rest = F.expr(f"substring({ref}, length({seg_id}) + 1)")
    return F.when(F.startswith(F.col(ref), F.col(seg_id)) & rest.rlike("^[0-9]+$"), rest.try_cast("int"))


class Guide:
    """What marked lines say. The marks are shared: each part reads them again."""

    #: Reviews of lines that are no facts, or facts that are read all the same.
    NO_DOUBT = ("code_of_no_list", "code_of_no_element", "text_before_loop", "not_in_index", "torn_codes")
    FACTS = "block > 0 and (kind = 'segment' or (seg_id is not null and kind in ('usage', 'element', 'torn')))"

    def __init__(self, lines: DataFrame):
        self.marked = share(read_tabular(strip_furniture(lines)))
        self.blocks = self.marked.where("seg_id is not null")

    def segments(self) -> DataFrame:
        """file_id, block, seg_id, name, pos, max_use, loop, usage, notes."""
        last = lambda kind, p, i=1: F.coalesce(F.max_by(F.regexp_extract("text", p, i), F.when(F.col("kind") == kind, F.col("seq"))), F.lit(""))
        said = F.lower(F.trim(F.regexp_extract("text", FORMS["usage"], 1)))
        words = F.create_map(*(F.lit(x) for kv in USAGE_WORDS.items() for x in kv))
        usage = F.try_element_at(words, said)
        note = F.when(F.col("kind") == "notes", F.trim(F.regexp_replace("text", r"^Notes:\s*", ""))).when(F.col("kind") == "note", F.col("text"))
        note = F.when((note != "") & ~F.startswith(F.lower(note), F.lit("example")) & ~note.rlike(RAW_SAMPLE), note)
        return self.blocks.groupBy("file_id", "block", "seg_id").agg(
            last("segment", r"^Segment:\s*(.*\S)$").alias("name"), last("position", FORMS["position"]).alias("pos"), last("max", FORMS["max"]).alias("max_use"), last("loop", FORMS["loop"]).alias("loop"),
            F.coalesce(F.max_by(usage, F.when((F.col("kind") == "usage") & usage.isNotNull(), F.col("seq"))), F.lit("")).alias("usage"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("seq", note.alias("t"))))), lambda x: x["t"]), " ").alias("notes"),
        )

    def elements(self) -> DataFrame:
        """file_id, block, row, seg_id, ref, elem_ix, name, type, shortest, longest,
        usage; elem_ix is null for a row of another segment, which is no fact."""
        part = lambda i: F.regexp_extract("text", FORMS["element"], i)
        asked = F.coalesce(F.nullif(part(8), F.lit("")), part(4))
        rows = self.blocks.where("kind = 'element'")
        return rows.select("file_id", "block", "row", "seg_id", "ref", position("ref", "seg_id").alias("elem_ix"), part(3).alias("name"), "type", part(6).try_cast("int").alias("shortest"), part(7).try_cast("int").alias("longest"), F.when(asked == "M", "must_use").otherwise("used").alias("usage"))

    def codes(self) -> DataFrame:
        """file_id, block, row, ref, seq, code, name of coded elements; a line that is
        no code row continues the name before it."""
        rows = self.blocks.where("kind = 'other' and type = 'ID'").withColumn("code", F.nullif(F.regexp_extract("text", CODE_ROW, 1), F.lit("")))
        upto = Window.partitionBy("file_id", "block", "row").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("at", F.max(F.when(F.col("code").isNotNull(), F.col("seq"))).over(upto)).where("at is not null")
        text = F.when(F.col("code").isNotNull(), F.regexp_extract("text", CODE_ROW, 2)).otherwise(F.col("text"))
        whole = F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda x: x["t"])
        return rows.groupBy("file_id", "block", "row", "ref", F.col("at").alias("seq")).agg(F.max("code").alias("code"), F.array_join(whole, " ").alias("name"))

    def reviews(self) -> DataFrame:
        """file_id, seq, page, what, text of lines that a person has to read."""
        rows = self.marked.where("block > 0")
        said = F.lower(F.trim(F.regexp_extract("text", FORMS["usage"], 1)))
        nth = F.sum(F.lit(1)).over(Window.partitionBy("file_id", "block", "row", "kind").orderBy("seq"))
        coded = (F.col("kind") == "other") & F.col("type").isNotNull() & (F.col("type") != "ID") & F.col("text").rlike(CODE_ROW) & (F.col("n") > 1)
        what = (
            F.when((F.col("kind") == "segment") & F.col("seg_id").isNull(), "no_segment_id").when(F.col("seg_id").isNull(), None).when((F.col("kind") == "usage") & ~said.isin(*USAGE_WORDS), "unknown_usage")
            .when(F.col("kind") == "torn", "torn_element").when((F.col("kind") == "element") & position("ref", "seg_id").isNull(), "foreign_element").when(coded, "code_of_no_list")
        )
        return rows.withColumn("n", nth).withColumn("what", what).where("what is not null").select("file_id", "seq", "page", "what", "text")

    def coverage(self) -> DataFrame:
        """file_id, detected, confident and the ratio of facts that were read."""
        facts = self.marked.where(self.FACTS).select("file_id", "seq")
        doubt = self.reviews().where(~F.col("what").isin(*self.NO_DOUBT)).select("file_id", "seq", F.lit(1).alias("bad"))
        got = facts.join(doubt, ["file_id", "seq"], "left").groupBy("file_id").agg(F.count("*").alias("detected"), F.count_if(F.col("bad").isNull()).alias("confident"))
        return got.withColumn("ratio", F.round(F.col("confident") / F.col("detected"), 6))

    def index(self) -> DataFrame:
        """file_id, seg_id, pos, usage of the table before the first block."""
        part = lambda i: F.regexp_extract("text", INDEX_ROW, i)
        rows = self.marked.where("block = 0 and kind != 'id'").where(F.col("text").rlike(INDEX_ROW) & ~F.col("text").rlike(INDEX_HEAD))
        return rows.select("file_id", part(2).alias("seg_id"), part(1).alias("pos"), F.when(part(3) == "M", "must_use").otherwise("used").alias("usage"))

    def cross_check(self) -> DataFrame:
        """file_id, seg_id, pos, what: where index and blocks disagree; guides without
        an index are left out."""
        sides = []
        for name, df in (("listed", self.index()), ("found", self.segments())):
            sides.append(df.groupBy("file_id", "seg_id", "pos").agg(F.array_sort(F.collect_list("usage")).alias(name)))
        both = sides[0].join(sides[1], ["file_id", "seg_id", "pos"], "full_outer").join(self.index().select("file_id").distinct(), "file_id", "left_semi")
        what = (
            F.when(F.col("found").isNull(), "no_block").when(F.col("listed").isNull(), "not_listed").when(F.size("listed") != F.size("found"), "occurrences").when(F.col("listed") != F.col("found"), "usage")
        )
        return both.withColumn("what", what).where("what is not null").select("file_id", "seg_id", "pos", "what")

    def presence_rules(self) -> DataFrame:
        """An overlay: file_id, segment, elem_ix (0 for the segment itself, null for a
        pair anywhere in its slots), codes, loop, once each. Blocks that must be used
        give their segment, by its codes if it is one of a family, inside a loop that
        it does not open, and its elements that must be used. A pair's single code
        takes its slot and the one after."""
        listed = self.codes().groupBy("file_id", "block", "row").agg(F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("c")).withColumn("codes", F.transform("c", lambda x: x["code"])).drop("c")
        els = self.elements().where("elem_ix is not null").join(listed, ["file_id", "block", "row"], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
        whole = els.groupBy("file_id", "block").agg(F.array_sort(F.collect_list(F.struct("elem_ix", "usage", "codes"))).alias("els"))
        segs = self.segments().where("usage = 'must_use'").join(whole, ["file_id", "block"], "left").withColumn("els", F.coalesce("els", F.array().cast(whole.schema["els"].dataType)))
        first = F.get(F.filter("els", lambda e: e["elem_ix"] == 1), 0)["codes"]
        none = F.array().cast("array<string>")
        segs = segs.withColumn("own", F.when(F.col("seg_id").isin(*FAMILIES), F.coalesce(first, none)).otherwise(none)).withColumn("scope", F.when(F.col("loop") != F.col("seg_id"), F.col("loop")).otherwise(""))
        need = F.filter("els", lambda e: e["usage"] == "must_use")
        slots = reduce(lambda c, kv: c.when(F.col("seg_id") == kv[0], F.sequence(*map(F.lit, kv[1]))), PAIRED.items(), F.when(F.lit(False), F.sequence(F.lit(1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        segs = segs.withColumn("need", need).withColumn("slots", slots)
        pairs = F.filter("need", lambda e: F.array_contains(F.col("slots"), e["elem_ix"]) & (F.size(e["codes"]) == 1))
        segs = segs.withColumn("pairs", F.when(F.size("own") == 0, pairs).otherwise(F.array().cast(whole.schema["els"].dataType)))
        taken = F.flatten(F.transform("pairs", lambda e: F.array(e["elem_ix"], e["elem_ix"] + 1)))
        segs = segs.withColumn("taken", taken)
        rest = F.filter("need", lambda e: ~F.array_contains(F.col("taken"), e["elem_ix"]) & ((F.size("own") == 0) | (e["elem_ix"] != 1)))
        rule = lambda at, codes, loop: F.struct(at.cast("int").alias("elem_ix"), codes.alias("codes"), loop.alias("loop"))
        all_ = F.concat(
            F.array(rule(F.lit(0), F.col("own"), F.col("scope"))), F.transform(rest, lambda e: rule(e["elem_ix"], F.col("own"), F.col("scope"))), F.transform("pairs", lambda e: rule(F.lit(None), e["codes"], F.lit(""))),
        )
        return segs.select("file_id", F.col("seg_id").alias("segment"), F.explode(all_).alias("r")).select("file_id", "segment", "r.*").distinct()


def read_templated(lines: DataFrame) -> DataFrame:
    """Lines (blank ones too) with what they are, as of `read_tabular`; a block opens
    at a header line, or at the name line after a box of position and uses. Columns
    pos, max_use and head (its name) are those of the line that opens a block."""
    own = Window.partitionBy("file_id").orderBy("page", "line")
    rows = lines.withColumn("seq", F.row_number().over(own))
    kind = reduce(lambda c, kp: c.when(F.col("text").rlike(kp[1]), kp[0]), TEMPLATE.items(), F.when(F.col("text") == "", "blank")).otherwise("other")
    rows = rows.withColumn("kind", kind)
    upto = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before, after = upto.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    filled = F.when(F.col("kind") != "blank", F.struct("kind", "text"))
    rows = rows.withColumn("prev", F.last(filled, True).over(before)).withColumn("next", F.first(filled, True).over(after))
    named = (F.col("prev.kind") == "box") & ~F.col("kind").isin("header", "box", "blank") & F.col("text").rlike(BOX_NAME)
    rows = rows.withColumn("kind", F.when(F.coalesce(named, F.lit(False)), "name").otherwise(F.col("kind")))
    lone = (F.col("kind") == "box") & F.coalesce(F.col("next.kind") != "header", F.lit(False)) & ~F.coalesce((F.col("next.kind") != "box") & F.col("next.text").rlike(BOX_NAME), F.lit(False))
    rows = rows.withColumn("kind", F.when(lone, "lone_box").otherwise(F.col("kind")))
    opens = F.col("kind").isin("header", "name")
    head = lambda i: F.regexp_extract("text", TEMPLATE["header"], i)
    name = lambda i: F.regexp_extract("text", BOX_NAME, i)
    box = lambda i: F.regexp_extract("prev.text", TEMPLATE["box"], i)
    of_name = F.col("kind") == "name"
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(upto).cast("int"))
    rows = rows.withColumn("own", F.when(opens, F.struct(F.when(of_name, name(1)).otherwise(head(1)).alias("id"), F.when(of_name, name(2)).otherwise(head(2)).alias("head"), F.when(of_name, box(1)).otherwise(head(3)).alias("pos"), F.when(of_name, box(2)).otherwise(head(4)).alias("max_use"), of_name.alias("split"))))
    block = Window.partitionBy("file_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.max("own").over(block)).withColumn("in_summary", F.max(F.col("kind") == "summary").over(block))
    element_like = F.col("kind").isin("element", "torn") & ~F.col("in_summary")
    rows = rows.withColumn("kind", F.when(element_like, "other").otherwise(F.col("kind")))
    shut = F.col("kind").isin("blank", "area", "summary", "about", "element", "header", "name")
    rows = rows.withColumn("listing", F.coalesce(F.last(F.when(F.col("kind") == "list", True).when(shut, False), True).over(block), F.lit(False)))
    rows = rows.withColumn("row", F.sum((F.col("kind") == "element").cast("int")).over(block).cast("int"))
    part = lambda i: F.regexp_extract("text", TEMPLATE["element"], i)
    open_ = Window.partitionBy("file_id", "block", "row").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("el", F.max(F.when(F.col("kind") == "element", F.struct(part(1).alias("ref"), part(5).alias("type")))).over(open_))
    code = (F.col("kind") == "other") & F.col("listing") & F.col("text").rlike(CODE_ROW)
    rows = rows.withColumn("kind", F.when(code, "code").otherwise(F.col("kind")))
    return rows.where("kind != 'blank'").select("file_id", "seq", "page", "text", "kind", "block", F.col("own.id").alias("seg_id"), "row", F.col("el.ref").alias("ref"), F.col("el.type").alias("type"), "own.head", "own.pos", "own.max_use", "own.split")


class TemplatedGuide(Guide):
    """Templated guides, from lines with their blanks. They hold no index."""

    FACTS = "kind = 'lone_box' or (block > 0 and kind in ('header', 'name', 'usage', 'element', 'torn'))"

    def __init__(self, lines: DataFrame):
        self.marked = share(read_templated(lines))
        self.blocks = self.marked.where("block > 0")
        self.words = F.create_map(*(F.lit(x) for kv in OPTION_WORDS.items() for x in kv))
        self.option = F.when(F.col("kind") == "usage", F.try_element_at(self.words, F.lower(F.trim(F.regexp_extract("text", TEMPLATE["usage"], 1)))))

    def segments(self) -> DataFrame:
        loop = F.regexp_extract("text", TEMPLATE["loop"], 2)
        said = F.max_by(F.when(F.upper(loop) == "N/A", "").otherwise(loop), F.when(F.col("kind") == "loop", F.col("seq")))
        tail = F.when((F.col("kind") == "loop") & F.col("split"), F.nullif(F.regexp_extract("text", TEMPLATE["loop"], 1), F.lit("")))
        note = F.when((F.col("kind") == "note") & (F.col("row") == 0), F.regexp_extract("text", TEMPLATE["note"], 1))
        in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("seq", c.alias("t"))))), lambda x: x["t"])
        own = F.when(F.col("row") == 0, self.option)
        return self.blocks.groupBy("file_id", "block", "seg_id").agg(
            F.array_join(F.concat(F.array(F.max("head")), in_order(tail)), " ").alias("name"), F.max("pos").alias("pos"), F.max("max_use").alias("max_use"), F.coalesce(said, F.lit("")).alias("loop"),
            F.coalesce(F.max_by(own, F.when(own.isNotNull(), F.col("seq"))), F.lit("")).alias("usage"), F.array_join(in_order(note), " ").alias("notes"),
        )

    def elements(self) -> DataFrame:
        part = lambda i: F.regexp_extract("text", TEMPLATE["element"], i)
        told = self.blocks.where("row > 0").groupBy("file_id", "block", "row").agg(F.max_by(self.option, F.when(self.option.isNotNull(), F.col("seq"))).alias("told"))
        rows = self.blocks.where("kind = 'element'").withColumn("usage", F.try_element_at(self.words, F.lower(part(8)))).join(told, ["file_id", "block", "row"])
        return rows.select("file_id", "block", "row", "seg_id", "ref", position("ref", "seg_id").alias("elem_ix"), part(3).alias("name"), "type", part(6).try_cast("int").alias("shortest"), part(7).try_cast("int").alias("longest"), F.coalesce("told", "usage").alias("usage"))

    def codes(self) -> DataFrame:
        at = lambda i: F.regexp_extract("text", CODE_ROW, i)
        return self.blocks.where("kind = 'code' and ref is not null").select("file_id", "block", "row", "ref", "seq", at(1).alias("code"), at(2).alias("name"))

    def reviews(self) -> DataFrame:
        stray = (F.col("kind") == "loop") & ~F.col("split") & (F.regexp_extract("text", TEMPLATE["loop"], 1) != "")
        what = (
            F.when(F.col("kind") == "lone_box", "no_segment_name").when(F.col("block") == 0, None).when((F.col("kind") == "usage") & self.option.isNull(), "unknown_usage").when(F.col("kind") == "torn", "torn_element")
            .when((F.col("kind") == "element") & position("ref", "seg_id").isNull(), "foreign_element").when((F.col("kind") == "code") & F.col("ref").isNull(), "code_of_no_element").when(stray, "text_before_loop")
        )
        return self.marked.withColumn("what", what).where("what is not null").select("file_id", "seq", "page", "what", "text")

    def index(self) -> DataFrame:
        return self.segments().limit(0).select("file_id", "seg_id", "pos", "usage")


def read_terse(lines: DataFrame) -> DataFrame:
    """Lines with what they are, as of `read_tabular`. A block opens at a segment's
    headline; before the first, lines are rows of the index or nothing."""
    own = Window.partitionBy("file_id").orderBy("page", "line")
    rows = lines.withColumn("seq", F.row_number().over(own))
    kind = reduce(lambda c, kp: c.when(F.col("text").rlike(kp[1]), kp[0]), TERSE.items(), F.when(F.lit(False), "")).otherwise("other")
    upto = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).withColumn("block", F.sum((F.col("kind") == "segment").cast("int")).over(upto).cast("int"))
    listed = F.col("text").rlike(TERSE_INDEX_ROW) & ~F.col("text").rlike(TERSE_AREA) & ~F.col("text").rlike(TERSE_INDEX_HEAD)
    rows = rows.withColumn("kind", F.when(F.col("block") > 0, F.col("kind")).when(listed, "index").otherwise("front"))
    block = Window.partitionBy("file_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    keyed = F.col("kind").isin("segment", "level", "max", "table", "comments", "standard")
    rows = rows.withColumn("in_table", F.max(F.col("kind") == "table").over(block)).withColumn("noting", F.last(F.when(keyed, F.col("kind") == "comments"), True).over(block))
    rows = rows.withColumn("kind", F.when(keyed | F.col("in_table") | (F.col("block") == 0), F.col("kind")).when(F.col("noting"), "note").otherwise("prose"))
    rows = rows.withColumn("row", F.sum(F.col("kind").isin("element", "torn").cast("int")).over(block).cast("int"))
    part = lambda i: F.regexp_extract("text", TERSE["element"], i)
    open_ = Window.partitionBy("file_id", "block", "row").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("el", F.max(F.when(F.col("kind") == "element", F.struct(part(1).alias("ref"), part(4).alias("type")))).over(open_))
    head = F.max(F.when(F.col("kind") == "segment", F.regexp_extract("text", TERSE["segment"], 1))).over(block)
    return rows.select("file_id", "seq", "page", "text", "kind", "block", head.alias("seg_id"), "row", F.col("el.ref").alias("ref"), F.col("el.type").alias("type"))


class TerseGuide(Guide):
    """Terse guides: two regions joined by segment id. The index before the first
    block gives usage and loop, its last row of a segment winning; blocks give
    elements, and codes out of the running text beside and below them."""

    FACTS = "kind = 'index' or (block > 0 and kind in ('segment', 'element', 'torn'))"

    def __init__(self, lines: DataFrame):
        structural = reduce(lambda a, b: a | b, (F.col("text").rlike(p) for p in [*(p for k, p in TERSE.items() if k != "torn"), TERSE_AREA, TERSE_INDEX_HEAD]))
        self.marked = share(read_terse(strip_furniture(lines, structural, TERSE_FOOTER)))
        self.blocks = self.marked.where("block > 0")
        self.words = F.create_map(*(F.lit(x) for kv in TERSE_WORDS.items() for x in kv))

    def index(self) -> DataFrame:
        part = lambda i: F.regexp_extract("text", TERSE_INDEX_ROW, i)
        loop = F.nullif(part(3), F.lit(""))
        rows = self.marked.where("kind = 'index'").select("file_id", "seq", part(1).alias("seg_id"), F.try_element_at(self.words, part(2)).alias("usage"), loop.alias("loop"))
        return rows.groupBy("file_id", "seg_id").agg(F.max_by("usage", "seq").alias("usage"), F.max_by("loop", F.when(F.col("loop").isNotNull(), F.col("seq"))).alias("loop")).withColumn("pos", F.lit(""))

    def _heads(self) -> DataFrame:
        last = lambda kind, p, i: F.coalesce(F.max_by(F.regexp_extract("text", p, i), F.when(F.col("kind") == kind, F.col("seq"))), F.lit(""))
        note = F.when(F.col("kind") == "comments", F.trim(F.regexp_extract("text", TERSE["comments"], 1))).when(F.col("kind") == "note", F.col("text"))
        note = F.when((note != "") & ~F.startswith(F.lower(note), F.lit("example")) & ~note.rlike(RAW_SAMPLE), note)
        return self.blocks.groupBy("file_id", "block", "seg_id").agg(
            F.min("seq").alias("seq"), last("segment", TERSE["segment"], 2).alias("name"), F.lit("").alias("pos"), last("max", TERSE["max"], 1).alias("max_use"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("seq", note.alias("t"))))), lambda x: x["t"]), " ").alias("notes"),
        )

    def segments(self) -> DataFrame:
        met = self._heads().join(self.index().drop("pos"), ["file_id", "seg_id"], "left")
        return met.select("file_id", "block", "seg_id", "name", "pos", "max_use", F.coalesce("loop", F.lit("")).alias("loop"), F.coalesce("usage", F.lit("")).alias("usage"), "notes")

    def elements(self) -> DataFrame:
        part = lambda i: F.regexp_extract("text", TERSE["element"], i)
        rows = self.blocks.where("kind = 'element'")
        return rows.select("file_id", "block", "row", "seg_id", "ref", position("ref", "seg_id").alias("elem_ix"), F.trim(part(2)).alias("name"), "type", part(5).try_cast("int").alias("shortest"), part(6).try_cast("int").alias("longest"), F.try_element_at(self.words, part(3)).alias("usage"))

    def _code_lines(self) -> DataFrame:
        tail = F.when(F.col("kind") == "element", F.regexp_extract("text", TERSE["element"], 7)).when(F.col("kind") == "other", F.col("text"))
        rows = self.blocks.where("type = 'ID'").withColumn("said", tail).where(F.col("said").rlike(TERSE_CODE_LINE))
        every = lambda i: F.regexp_extract_all("said", F.lit(TERSE_CODE), F.lit(i))
        return rows.withColumn("c", F.arrays_zip(every(1).alias("code"), every(2).alias("name")))

    def codes(self) -> DataFrame:
        rows = self._code_lines().select("file_id", "block", "row", "ref", "seq", F.posexplode("c").alias("nth", "x"))
        # several codes of a line keep their order
        return rows.select("file_id", "block", "row", "ref", (F.col("seq") + F.col("nth") / 1000.0).alias("seq"), F.col("x.code").alias("code"), F.trim("x.name").alias("name"))

    def reviews(self) -> DataFrame:
        what = F.when(F.col("kind") == "torn", "torn_element").when((F.col("kind") == "element") & position("ref", "seg_id").isNull(), "foreign_element")
        rows = self.blocks.withColumn("what", what).where("what is not null").select("file_id", "seq", "page", "what", "text")
        torn = self._code_lines().where((F.size("c") == 0) & (F.col("kind") == "other")).select("file_id", "seq", "page", F.lit("torn_codes").alias("what"), "text")
        lone = self.blocks.where("kind = 'segment'").join(self.index(), ["file_id", "seg_id"], "left_anti").select("file_id", "seq", "page", F.lit("not_in_index").alias("what"), "text")
        return rows.unionByName(torn).unionByName(lone)


GUIDES = {"tabular": Guide, "templated": TemplatedGuide, "terse": TerseGuide}


def families(lines: DataFrame) -> DataFrame:
    """file_id, family: templated, tabular or terse by the marks of each; null where
    no family, or more than one, has all of its marks."""
    has = lambda *forms: F.max(reduce(lambda a, b: a | b, (F.col("text").rlike(p) for p in forms)))
    marks = {
        "templated": has(TEMPLATE["header"], TEMPLATE["box"]) & has(TEMPLATE["summary"]) & has(TEMPLATE["element"]), "tabular": has(FORMS["table"]) & has(FORMS["segment"]) & has(FORMS["usage"]) & has(FORMS["element"]),
        "terse": has(TERSE_AREA) & has(TERSE["segment"]) & has(TERSE["table"]),
    }
    got = lines.groupBy("file_id").agg(*(m.alias(k) for k, m in marks.items()))
    held = F.filter(F.array(*(F.when(F.col(k), k) for k in marks)), lambda k: k.isNotNull())
    return got.select("file_id", F.when(F.size(held) == 1, F.get(held, 0)).alias("family"))


class AnyGuides:
    """Guides of all families at once: each is read by its own family's grammar, and
    a guide of no family, or of several, is a review."""

    def __init__(self, files: DataFrame):
        lines = share(guide_lines(files, blank=True))
        self.families = share(families(lines))
        of = lambda k: lines.join(self.families.where(F.col("family") == k).select("file_id"), "file_id", "left_semi")
        self.parts = {k: make(of(k) if k == "templated" else of(k).where("text != ''")) for k, make in GUIDES.items()}

    def _all(self, what: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (getattr(g, what)().withColumn("family", F.lit(k)) for k, g in self.parts.items()))

    def segments(self) -> DataFrame:
        return self._all("segments")

    def elements(self) -> DataFrame:
        return self._all("elements")

    def codes(self) -> DataFrame:
        return self._all("codes")

    def presence_rules(self) -> DataFrame:
        return self._all("presence_rules")

    def coverage(self) -> DataFrame:
        return self._all("coverage")

    def reviews(self) -> DataFrame:
        none = F.lit(None).cast("int")
        lost = self.families.where("family is null").select("file_id", none.alias("seq"), none.alias("page"), F.lit("no_family").alias("what"), F.lit(None).cast("string").alias("text"), "family")
        return self._all("reviews").unionByName(lost)
