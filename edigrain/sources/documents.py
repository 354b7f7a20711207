"""Output documents: JSON, keyed flat files, fixed-width and delimited layouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_documents(files: DataFrame) -> DataFrame:
    """(file_id, doc_ix, v) of (file_id, text): an object is one document, an
    array one for each element; v is null if the text is no JSON."""
    tvf = files.sparkSession.tvf
    read = files.select("file_id", F.try_parse_json("text").alias("whole"))
    many = F.schema_of_variant("whole").startswith("ARRAY")
    one = read.where(~F.coalesce(many, F.lit(False))).select("file_id", F.lit(0).alias("doc_ix"), F.col("whole").alias("v"))
    each = read.where(many).lateralJoin(tvf.variant_explode(F.col("whole").outer()).toDF("pos", "key", "value")).select("file_id", F.col("pos").alias("doc_ix"), F.col("value").alias("v"))
    return one.unionByName(each)


def json_errors(files: DataFrame, single: bool = False) -> DataFrame:
    """file_id, doc_ix, error of JSON files: not_json, empty_array, not_an_object (of
    a value, or of the element doc_ix of an array), and array where a single document
    was asked for."""
    tvf = files.sparkSession.tvf
    read = files.select("file_id", F.try_parse_json("text").alias("whole")).withColumn("kind", F.schema_of_variant("whole"))
    many, none = F.coalesce(F.col("kind").startswith("ARRAY"), F.lit(False)), F.lit(None).cast("int")
    object_ = lambda c: F.coalesce(F.col(c).startswith("OBJECT"), F.lit(False))
    whole = F.when(F.col("whole").isNull(), "not_json").when(many, F.when(F.lit(single), "array").when(F.expr("size(try_variant_get(whole, '$', 'array<variant>'))") == 0, "empty_array")).when(~object_("kind"), "not_an_object")
    out = read.select("file_id", none.alias("doc_ix"), whole.alias("error")).where("error is not null")
    if single:
        return out
    each = read.where(many).lateralJoin(tvf.variant_explode(F.col("whole").outer()).toDF("pos", "key", "value")).withColumn("own", F.schema_of_variant("value"))
    return out.unionByName(each.where(~object_("own")).select("file_id", F.col("pos").alias("doc_ix"), F.lit("not_an_object").alias("error")))


def guard_xml(content: Column) -> Column:
    """True for XML, as bytes or text, that declares a document type, whichever of
    UTF-8, UTF-16 and UTF-32 it is in; it is never parsed."""
    letters = "".join(f"({ord(c):02X}|{ord(c.lower()):02X})(00){{0,3}}" for c in "<!DOCTYPE")
    return F.hex(content.cast("binary")).rlike(letters)


def detect_format(name: Column, text: Column) -> Column:
    """json, xml, control (a control record leads), or flat."""
    first = F.substring_index(text, "\n", 1)
    return F.when(F.lower(name).endswith(".json"), "json").when(F.lower(name).endswith(".xml"), "xml").when(first.startswith("EDI_DC40"), "control").otherwise("flat")


def xml_records(files: DataFrame) -> DataFrame:
    """(file_id, text) of XML to file_id, line_no, record, fields: an element with
    elements inside is a record, in document order, and an element with text alone
    is a field of the record around it (the first of a name wins). XML with a
    document type gives no rows. Files that are dealt by file_id are not shuffled;
    of others, all elements are, which are many times their text."""
    clean = F.regexp_replace("text", r"(?s)<!--.*?-->|<\?.*?\?>", "")
    tags = files.where(~guard_xml(F.col("text"))).select("file_id", F.posexplode(F.regexp_extract_all(clean, F.lit(r"(?s)<[^>]+>[^<]*"), F.lit(0))).alias("at", "tag"))
    name = F.regexp_extract("tag", r"^</?([^\s/>]+)", 1)
    close, alone = F.col("tag").startswith("</"), F.col("tag").rlike(r"^<[^>]*/>")
    doc = Window.partitionBy("file_id").orderBy("at")
    rows = tags.select("file_id", "at", name.alias("name"), close.alias("close"), alone.alias("alone"), F.regexp_extract("tag", r"(?s)>(.*)$", 1).alias("inner"))
    leaf = ~F.col("close") & (F.col("alone") | (F.lead("close").over(doc) & (F.lead("name").over(doc) == F.col("name"))))
    rows = rows.withColumn("leaf", leaf)
    opens = ~F.col("close") & ~F.col("leaf")
    ends = F.col("close") & ~F.coalesce(F.lag("leaf").over(doc) & ~F.lag("alone").over(doc), F.lit(False))
    rows = rows.withColumn("opens", opens).withColumn("ends", ends).withColumn("depth", F.sum(F.when(opens, 1).when(F.lag(ends).over(doc), -1).otherwise(0)).over(doc))
    level = Window.partitionBy("file_id", "depth").orderBy("at")
    rows = rows.withColumn("owner", F.max(F.when(F.col("opens"), F.col("at"))).over(level))
    plain = F.col("inner")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    # a record and its fields meet in one grouping, so that files that are dealt stay so
    cell = F.when(F.col("leaf"), F.struct("name", "at", F.trim(plain).alias("value")))
    own = rows.where("opens or leaf").groupBy("file_id", F.when(F.col("opens"), F.col("at")).otherwise(F.col("owner")).alias("line_no"))
    own = own.agg(F.max(F.when(F.col("opens"), F.col("name"))).alias("record"), F.sort_array(F.collect_list(cell)).alias("cells")).where("record is not null")
    first = F.filter("cells", lambda x, i: (i == 0) | (F.get("cells", i - 1)["name"] != x["name"]))
    fields = F.when(F.size("cells") > 0, F.map_from_entries(F.transform(first, lambda x: F.struct(x["name"], x["value"]))))
    return own.select("file_id", "line_no", "record", fields.alias("fields"))


def flat_leaves(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, value) of keyed flat files to file_id, norm_path,
    line_ix, leaf_text. H and S sections merge, the later line winning; A lines
    are kept by role; each D line is an entry of the list."""
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    parts = rows.select("file_id", "line_no", F.upper(F.substring_index("value", "|", 1)).alias("code"), F.split("value", "\\|", -1).alias("all"))
    parts = parts.select("file_id", "line_no", "code", F.slice("all", 2, F.size("all") - 1).alias("pairs"))
    pairs = parts.select("*", F.explode(F.transform("pairs", lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("x")))).alias("p"))
    role = F.max(F.when(F.col("p.k") == "role", F.col("p.x"))).over(Window.partitionBy("file_id", "line_no"))
    nth = F.dense_rank().over(Window.partitionBy("file_id", "code").orderBy("line_no")) - 1
    pairs = pairs.withColumn("role", role).withColumn("nth", nth)
    path = F.when(F.col("code") == "H", F.concat(F.lit("header."), "p.k")).when(F.col("code") == "S", F.concat(F.lit("summary."), "p.k")).when(F.col("code") == "A", F.concat("role", F.lit("."), "p.k")).when(F.col("code") == "D", F.concat(F.lit("lines[]."), "p.k"))
    own = pairs.where(~((F.col("code") == "A") & (F.col("p.k") == "role"))).select("file_id", "line_no", path.alias("norm_path"), F.when(F.col("code") == "D", F.col("nth")).alias("line_ix"), F.col("p.x").alias("leaf_text"))
    return own.where(F.col("norm_path").isNotNull()).groupBy("file_id", "norm_path", "line_ix").agg(F.max_by("leaf_text", "line_no").alias("leaf_text"))


def flat_errors(lines: DataFrame) -> DataFrame:
    """file_id, line_no, error of keyed flat files: unknown_record (no H, S, A or D),
    no_role of an A line, and torn_pair for a field without '='."""
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    code = F.upper(F.substring_index("value", "|", 1))
    pairs = F.filter(F.slice(F.split("value", "\\|", -1), 2, F.greatest(F.size(F.split("value", "\\|", -1)) - 1, F.lit(0))), lambda p: F.trim(p) != "")
    role = F.exists(pairs, lambda p: F.startswith(p, F.lit("role=")) & (F.length(p) > 5))
    found = F.array_compact(F.array(F.when(~code.isin("H", "S", "A", "D"), "unknown_record"), F.when((code == "A") & ~role, "no_role"), F.when(F.exists(pairs, lambda p: ~F.contains(p, F.lit("="))), "torn_pair")))
    return rows.select("file_id", "line_no", F.explode(found).alias("error"))


@dataclass(frozen=True)
class Record:
    """One record type of a layout. kind: object, keyed, partner, line or
    line_child; fields are (name, offset, length), or (name, column) if delimited;
    qualifier names the field that keys a keyed or partner record."""

    name: str
    kind: str
    section: str
    fields: tuple[tuple, ...]
    qualifier: str | None = None
    value: str | None = None


def layout_leaves(lines: DataFrame, records: list[Record], delimiter: str | None = None, name_at: tuple[int, int] = (0, 30)) -> DataFrame:
    """(file_id, line_no, value) of fixed-width or delimited files, or rows of
    `xml_records`, whose fields are named by tag, to file_id, norm_path, line_ix,
    leaf_text. The first value of a place wins; children
    belong to the line before them, and without one are reported with line_ix -1."""
    cut = F.split("value", f"\\Q{delimiter}\\E", -1) if delimiter else None
    tagged = "fields" in lines.columns
    name = F.col("record") if tagged else F.get(cut, 0) if delimiter else F.trim(F.substring("value", name_at[0] + 1, name_at[1]))
    rows = lines.select("file_id", "line_no", F.col("fields" if tagged else "value"), name.alias("record"))
    starts = [r.name for r in records if r.kind == "line"]
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line", F.sum(F.col("record").isin(*starts).cast("int")).over(w) - 1)

    def read(f: tuple) -> Column:
        raw = F.try_element_at("fields", F.lit(f[1])) if tagged else F.get(cut, f[1]) if delimiter else F.substring("value", f[1] + 1, f[2])
        return F.nullif(F.trim(raw), F.lit(""))

    def one(r: Record) -> Column:
        by = {f[0]: read(f) for f in r.fields}
        q = by.get(r.qualifier)
        out = []
        for f, c in by.items():
            if f == r.qualifier:
                continue
            if r.kind == "object":
                path = F.lit(f"{r.section}.{f}")
            elif r.kind == "line":
                path = F.lit(f"{r.section}[].{f}")
            elif r.kind == "line_child":
                path = F.concat(F.lit(f"{r.section}[]."), q, F.lit(f".{f}")) if r.qualifier else F.lit(f"{r.section}[].{f}")
            elif r.value:
                path = F.concat(F.lit(f"{r.section}."), q)
            else:
                path = F.concat(F.lit(f"{r.section}."), F.lower(q) if r.kind == "partner" else q, F.lit(f".{f}"))
            out.append(F.struct(path.alias("norm_path"), c.alias("leaf_text")))
        return F.when(F.col("record") == r.name, F.array(*out))

    cells = rows.select("file_id", "line_no", "line", F.col("record").isin(*(r.name for r in records if r.kind in ("line", "line_child"))).alias("in_line"), F.explode(F.coalesce(*(one(r) for r in records))).alias("c"))
    found = cells.where(F.col("c.leaf_text").isNotNull() & F.col("c.norm_path").isNotNull())
    return found.select("file_id", "c.norm_path", F.when(F.col("in_line"), F.col("line")).cast("int").alias("line_ix"), "line_no", "c.leaf_text").groupBy("file_id", "norm_path", "line_ix").agg(F.min_by("leaf_text", "line_no").alias("leaf_text"))


def layout_errors(lines: DataFrame, records: list[Record], delimiter: str | None = None, name_at: tuple[int, int] = (0, 30), control: tuple[str, int, int, str] | None = None) -> DataFrame:
    """file_id, line_no, error of files that `layout_leaves` reads: unknown_record,
    and child_before_line. With control (record, offset, length, type), a file's first
    record has to be that one: no_control_record; and name the type there:
    other_type. The control record itself is known."""
    tagged = "fields" in lines.columns
    cut = F.split("value", f"\\Q{delimiter}\\E", -1) if delimiter else None
    name = F.col("record") if tagged else F.get(cut, 0) if delimiter else F.trim(F.substring("value", name_at[0] + 1, name_at[1]))
    known = [r.name for r in records]
    starts, children = [r.name for r in records if r.kind == "line"], [r.name for r in records if r.kind == "line_child"]
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("file_id", "line_no", *([] if tagged else ["value"]), name.alias("record")).where("record is not null and record != ''")
    rows = rows.withColumn("begun", F.max(F.col("record").isin(*starts)).over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no")))
    first = F.lit(False)
    error = F.when(F.col("record").isin(*children) & ~F.col("begun"), "child_before_line").when(~F.col("record").isin(*known), "unknown_record")
    if control:
        record, at, n, wanted = control
        first = F.startswith(F.col("value"), F.lit(record))
        error = F.when(F.col("nth") == 1, F.when(~first, "no_control_record").when(F.trim(F.substring("value", at + 1, n)) != wanted, "other_type")).otherwise(error)
    return rows.withColumn("error", error).where("error is not null").select("file_id", "line_no", "error")
