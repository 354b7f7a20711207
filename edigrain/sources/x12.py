"""X12 text to segments, and the envelope around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_files(spark, path: str) -> DataFrame:
    """(file_id, text), a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))


def quoted(c: Column) -> Column:
    """A literal for a regular expression."""
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def tokenize(files: DataFrame) -> DataFrame:
    """Segments of (file_id, text): file_id, seq, seg_id, elements. The element
    separator is the fourth character of ISA, the terminator the 106th; a byte
    order mark is dropped. Text that is no interchange gives no rows."""
    clean = files.select("file_id", F.regexp_replace("text", "^\\x{FEFF}", "").alias("text")).where(F.col("text").startswith("ISA") & (F.length("text") >= 106))
    parts = clean.select("file_id", F.substring("text", 4, 1).alias("sep"), F.posexplode_outer(F.split("text", quoted(F.substring("text", 106, 1)), -1)).alias("seq", "raw"))  # outer: never empty, and split once
    # the usual separator needs no pattern, which would be compiled for each segment
    raw = F.btrim("raw", F.lit(" \t\n\x0b\f\r"))
    elements = F.when(F.col("sep") == "*", F.split(raw, "\\*", -1)).otherwise(F.split(raw, quoted(F.col("sep")), -1))
    own = parts.select("file_id", F.col("seq").cast("long").alias("seq"), elements.alias("all"))
    own = own.where(F.get("all", 0) != "")
    return own.select("file_id", "seq", F.get("all", 0).alias("seg_id"), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("elements"))


def raw_tail(files: DataFrame) -> DataFrame:
    """(file_id, tail): text after the last terminator, up to 60 characters."""
    clean = files.select("file_id", F.regexp_replace("text", "^\\x{FEFF}", "").alias("text")).where(F.col("text").startswith("ISA") & (F.length("text") >= 106))
    tail = F.regexp_replace(F.element_at(F.split("text", quoted(F.substring("text", 106, 1)), -1), -1), "^\\s+|\\s+$", "")
    return clean.select("file_id", F.substring(tail, 1, 60).alias("tail")).where(F.col("tail") != "")


def element(i: int, of: str = "elements") -> Column:
    """1-based; out of range or empty is null."""
    return F.nullif(F.get(of, i - 1), F.lit(""))


def number_envelopes(segments: DataFrame) -> DataFrame:
    """Adds isa_ix, gs_ix and st_ix: how many of each were opened so far; in_st:
    inside ST ... SE; and misplaced: an ST inside a transaction, or an SE outside."""
    w = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    one = lambda s: F.sum((F.col("seg_id") == s).cast("int")).over(w).cast("int")
    last = lambda s, over: F.coalesce(F.max(F.when(F.col("seg_id") == s, F.col("seq"))).over(over), F.lit(-1))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = segments.withColumn("isa_ix", one("ISA")).withColumn("gs_ix", one("GS")).withColumn("st_ix", one("ST"))
    out = out.withColumn("opened", last("ST", w)).withColumn("open_before", last("ST", before)).withColumn("closed", last("SE", before))
    inside = F.col("open_before") > F.col("closed")
    misplaced = F.when(F.col("seg_id") == "ST", inside).when(F.col("seg_id") == "SE", ~inside).otherwise(F.lit(False))
    return out.withColumn("in_st", F.col("opened") > F.col("closed")).withColumn("misplaced", misplaced).drop("opened", "open_before", "closed")


def envelopes(segments: DataFrame) -> DataFrame:
    """file_id, sender, receiver, control, usage, group_code, version and first_set
    of each file; the last ISA and GS win."""
    last = lambda s, i: F.max_by(element(i), F.when(F.col("seg_id") == s, F.col("seq")))
    own = {"sender": F.trim(last("ISA", 6)), "receiver": F.trim(last("ISA", 8)), "control": last("ISA", 13), "usage": last("ISA", 15), "group_code": last("GS", 1), "version": last("GS", 8)}
    return segments.groupBy("file_id").agg(*(c.alias(n) for n, c in own.items()), F.min_by(element(1), F.when(F.col("seg_id") == "ST", F.col("seq"))).alias("first_set"))


def transactions(numbered: DataFrame) -> DataFrame:
    """Segments inside ST ... SE, with the set and control number of their ST."""
    w = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    st = F.last(F.when(F.col("seg_id") == "ST", F.struct("isa_ix", element(1).alias("e1"), element(2).alias("e2"))), True).over(w)
    rows = numbered.where("in_st").withColumn("st", st)
    head = lambda i: F.when(F.col("st.isa_ix") == F.col("isa_ix"), F.col(f"st.e{i}"))
    return rows.select("file_id", "isa_ix", "st_ix", head(1).alias("set_code"), head(2).alias("control"), "seq", "seg_id", "elements")


#: Separators of packed segments.
PACK, PACK_ELEMENT = "\u0002", "\u0001"


def packed(numbered: DataFrame) -> DataFrame:
    """file_id, isa_ix, st_ix, set_code, control, opened (it begins with ST), text and
    rows: `transactions`, a row for each, so that they move as little more than their
    text. Segments that hold a separator of packed text are kept as rows instead."""
    head = lambda c: F.min_by(c, "seq")
    line = F.array_join(F.concat(F.array(F.col("seq").cast("string"), "seg_id"), "elements"), PACK_ELEMENT)
    own = transactions(numbered).withColumn("plain", F.array_join(F.concat(F.array("seg_id"), "elements"), ""))
    own = own.withColumn("odd", F.contains("plain", F.lit(PACK_ELEMENT)) | F.contains("plain", F.lit(PACK))).drop("plain")
    return own.groupBy("file_id", "isa_ix", "st_ix").agg(
        head("set_code").alias("set_code"), head("control").alias("control"), (head("seg_id") == "ST").alias("opened"),
        F.array_join(F.collect_list(F.when(~F.col("odd"), line)), PACK).alias("text"), F.collect_list(F.when(F.col("odd"), F.struct("seq", "seg_id", "elements"))).alias("rows"),
    )


def unpacked(transactions: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, seq, seg_id and elements of `packed` transactions."""
    parts = transactions.select(*carried, F.explode(F.concat(F.transform(F.filter(F.split("text", PACK, -1), lambda s: s != ""), lambda s: F.struct(s.alias("raw"), F.lit(None).cast("struct<seq:bigint,seg_id:string,elements:array<string>>").alias("row"))),
                                                              F.transform("rows", lambda r: F.struct(F.lit(None).cast("string").alias("raw"), r.alias("row"))))).alias("p"))
    own = parts.select(*carried, F.split("p.raw", PACK_ELEMENT, -1).alias("e"), F.col("p.row").alias("row"))
    return own.select(
        *carried, F.coalesce(F.get("e", 0).cast("long"), "row.seq").alias("seq"), F.coalesce(F.get("e", 1), "row.seg_id").alias("seg_id"),
        F.coalesce(F.slice("e", 3, F.greatest(F.size("e") - 2, F.lit(0))), "row.elements").alias("elements"),
    )


def document_notes(numbered: DataFrame, definitions: dict) -> DataFrame:
    """file_id, control, note (group or version), expected, actual of transactions
    whose own group has another code, or another release, than their definition.
    Sets without a definition have no note: they are `split_issues`."""
    group = Window.partitionBy("file_id", "isa_ix", "gs_ix")
    head = lambda i: F.min_by(element(i), F.when(F.col("seg_id") == "GS", F.col("seq"))).over(group)
    known = F.create_map(*(F.lit(x) for d in definitions.values() for x in (d.set_code, f"{d.group}|{d.version}")))
    rows = numbered.where(F.col("seg_id").isin("GS", "ST")).withColumn("code", head(1)).withColumn("release", head(8)).where("seg_id = 'ST'")
    own = rows.withColumn("d", F.split(F.try_element_at(known, element(1)), "\\|"))
    note = lambda what, on, expected, actual: F.when(on, F.array(F.struct(F.lit(what).alias("note"), expected.alias("expected"), actual.alias("actual")))).otherwise(F.array().cast("array<struct<note:string,expected:string,actual:string>>"))
    group_, version = F.get("d", 0), F.get("d", 1)
    notes = F.concat(note("group", F.col("code") != group_, group_, F.col("code")), note("version", (version != "") & ~F.startswith(F.col("release"), version), version, F.col("release")))
    return own.select("file_id", element(2).alias("control"), F.explode(notes).alias("n")).select("file_id", "control", "n.*")


def first_transaction(numbered: DataFrame) -> DataFrame:
    """file_id, set_code, n_segments of the first transaction of each file, and
    further: how many more a reader of single transactions leaves unread."""
    w = F.max("st_ix").over(Window.partitionBy("file_id"))
    own = transactions(numbered).withColumn("further", w - 1).where("st_ix = 1")
    return own.groupBy("file_id", "set_code", "further").agg(F.count("*").alias("n_segments"))


def split_issues(numbered: DataFrame, known: list[str]) -> DataFrame:
    """file_id, issue, control: transactions opened inside another, trailers
    without a transaction, and sets that no definition is known for."""
    st = F.col("seg_id") == "ST"
    issue = F.when(F.col("misplaced"), F.when(st, "nested_st").otherwise("orphan_se")).when(st & ~F.coalesce(element(1).isin(*known), F.lit(False)), "unknown_set")
    return numbered.withColumn("issue", issue).where(F.col("issue").isNotNull()).select("file_id", "issue", element(2).alias("control"))


def mixed_sets(numbered: DataFrame, wanted: str) -> DataFrame:
    """file_id, others: set codes of a file other than the spec's."""
    own = numbered.where((F.col("seg_id") == "ST") & (element(1) != wanted))
    return own.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set(element(1))), ",").alias("others"))


def ids_match(a: Column, b: Column) -> Column:
    """Control numbers are equal, zero padding ignored when both are numbers."""
    digits = a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$")
    return F.when(digits, F.ltrim(a, F.lit("0")) == F.ltrim(b, F.lit("0"))).otherwise(a == b)


def control_issues(numbered: DataFrame) -> DataFrame:
    """file_id, opened, issue, expected, actual of every trailer that doesn't add
    up, and of envelopes that were never closed; opened is the control number of
    the transaction, group or interchange. All three levels are keys of one
    grouping, so the segments are read once, and files that are dealt stay so."""
    has = lambda s: F.max((F.col("seg_id") == s).cast("int"))
    at = lambda s, i: F.max(F.when(F.col("seg_id") == s, element(i)))
    level = lambda opener, trailer, head, found: F.struct(F.lit(trailer).alias("kind"), found.cast("bigint").alias("found"), at(opener, head).alias("opened"), at(trailer, 1).alias("claimed"), at(trailer, 2).alias("closed"), has(trailer).alias("has"), has(opener).alias("had"))
    n = lambda s: F.count_if(F.col("seg_id") == s)
    levels = [("st_ix", level("ST", "SE", 2, F.count_if("in_st"))), ("gs_ix", level("GS", "GE", 6, n("ST"))), (None, level("ISA", "IEA", 13, n("GS")))]
    at_level = F.inline(F.array(*(F.struct(F.lit(i), (F.col(ix) if ix else F.lit(None)).cast("int")) for i, (ix, _) in enumerate(levels)))).alias("level", "ix")
    own = numbered.select("file_id", "isa_ix", "in_st", "seg_id", "elements", at_level).groupBy("file_id", "isa_ix", "level", "ix").agg(*(c.alias(f"l{i}") for i, (_, c) in enumerate(levels)))
    own = own.select("file_id", F.when(F.col("level") == 0, F.col("l0")).when(F.col("level") == 1, F.col("l1")).otherwise(F.col("l2")).alias("t")).where("t.had = 1").select("file_id", "t.*")
    claimed = F.expr("try_cast(claimed AS BIGINT)")
    closed, name, text = F.col("has") == 1, F.lower("kind"), F.lit(None).cast("string")
    wrong = closed & ((claimed.isNull() & (F.col("kind") != "IEA")) | (claimed != F.col("found")))
    ids = closed & ~F.coalesce(ids_match(F.col("opened"), F.col("closed")), F.lit(False))
    one = lambda what, on, expected, actual: F.struct(F.concat(name, F.lit(f"_{what}")).alias("issue"), expected.alias("expected"), actual.alias("actual"), F.coalesce(on, F.lit(False)).alias("on"))
    all_ = F.array(one("count", wrong, F.col("found").cast("string"), F.col("claimed")), one("control", ids, F.col("opened"), F.col("closed")), one("missing", ~closed, F.col("kind"), text))
    return own.select("file_id", "opened", F.explode(all_).alias("i")).where("i.on").select("file_id", "opened", "i.issue", "i.expected", "i.actual")
