"""Interchanges derived from orders and lineitem.

One order is one purchase order (850); one line item is one PO1. Defects are
planted by remainders of the order key, so that SQL over the same tables can
recompute every answer:

    % 7   the output lacks the last line      % 19  BEG03 is empty
    % 11  the output's PO number is wrong      % 23  no output document
    % 13  SE01 is two too high                 % 31  CTT01 is one too high
    % 17  the output keeps the unit code       % 37  the output's date is MM/dd/yyyy
    % 41  the output has an unmapped field     % 43  an ITD segment that no rule reads
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_COLUMNS = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that one partition holds, so that their segments are sorted in some hundred
#: MB; tables below LARGE lines are left to Spark.
LINES_A_PART, LARGE = 60_000, 2_400_000
#: Lines that one task reads at most, where their files can be split so: what it deals
#: out is held in memory, in some 170 MB, or else spilled.
LINES_A_READ = 1_000_000
#: Customers that are too many to be sent to every executor.
MANY_CUSTOMERS = 500_000


def parts(spark, sf_dir: str) -> int | None:
    """Over how many partitions orders are dealt: a multiple of the session's own, in
    proportion to the lines, so that what a task holds doesn't grow with the tables.
    None if Spark is to say."""
    n, own = _table(spark, sf_dir, "lineitem").count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own * -(-n // (own * LINES_A_PART)) if n >= LARGE else None


def read_apart(spark, sf_dir: str) -> None:
    """From now on the session reads files in as many tasks, at least, as large tables
    of lines need, and not in fewer than Spark would by itself; a session that asks for
    more is left alone."""
    n, key = _table(spark, sf_dir, "lineitem").count(), "spark.sql.files.minPartitionNum"
    least = max(-(-n // LINES_A_READ), spark.sparkContext.defaultParallelism)
    if n >= LARGE and int(spark.conf.get(key, None) or 0) < least:
        spark.conf.set(key, str(least))


def dealt(df: DataFrame, spark, sf_dir: str, key: str) -> DataFrame:
    """df dealt by key over `parts`."""
    n = parts(spark, sf_dir)
    return df.repartition(n, key) if n else df


def lines(spark, sf_dir: str) -> DataFrame:
    """(doc, lines, total): the lines of each order, in order of all columns, as an
    array of line_ix (from 1), qty, unit, price, part and supplier."""
    read_apart(spark, sf_dir)
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    own = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.struct(*LINE_COLUMNS, price.alias("price")).alias("l"))
    own = dealt(own, spark, sf_dir, "doc").groupBy("doc").agg(F.sort_array(F.collect_list("l")).alias("lines"), F.sum("l.price").alias("total"))
    flag = lambda l: F.when(l["l_returnflag"] == "A", "EA").when(l["l_returnflag"] == "N", "CA").otherwise("DZ")  # noqa: E731, E741
    line = lambda l, i: F.struct(  # noqa: E731, E741
        (i + 1).alias("line_ix"), l["l_quantity"].cast("int").alias("qty"), flag(l).alias("unit"), l["price"].alias("price"), l["l_partkey"].alias("part"), l["l_suppkey"].alias("supplier"),
    )
    return own.select("doc", F.transform("lines", line).alias("lines"), "total")


def _every(n: int) -> Column:
    return F.col("o_orderkey") % n == 0


def orders(spark, sf_dir: str) -> DataFrame:
    """A row for each order with its lines, in order, as an array. Lines are met last,
    so that orders stay dealt by their key and their segments need no shuffle."""
    cust = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").join(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    o = _table(spark, sf_dir, "orders")
    if _table(spark, sf_dir, "customer").count() > MANY_CUSTOMERS:  # they meet in as many parts as lines do
        o, cust = dealt(o, spark, sf_dir, "o_custkey"), dealt(cust, spark, sf_dir, "c_custkey")
    return _with_lines(o.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left"), spark, sf_dir)


def ordered(spark, sf_dir: str) -> DataFrame:
    """`orders` without their customers, which then need not move."""
    return _with_lines(_table(spark, sf_dir, "orders"), spark, sf_dir)


def _with_lines(o: DataFrame, spark, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    o = o.join(own, F.col("o_orderkey") == F.col("doc"), "left").drop("doc")
    return o.withColumn("lines", F.coalesce("lines", F.array().cast(o.schema["lines"].dataType))).withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(28,2)")))


def po_type(c: Column) -> Column:
    return F.when(c == "1-URGENT", "DS").when(c == "2-HIGH", "NE").otherwise("SA")


def _seg(seg_id: str, *elements) -> Column:
    cells = [e if isinstance(e, Column) else F.lit(e) for e in elements]
    return F.struct(F.lit(seg_id).alias("seg_id"), F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in cells)).alias("elements"))


def _body() -> Column:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    flag = lambda n, s: F.when(_every(n), F.array(s)).otherwise(F.array().cast("array<struct<seg_id:string,elements:array<string>>>"))
    line = lambda x: F.array(
        _seg("PO1", x["line_ix"], x["qty"], x["unit"], x["price"], "", F.when(x["part"] % 5 == 0, "UP").otherwise("VP"), x["part"]),
        _seg("PID", "F", "", "", "", F.concat(F.lit("part "), x["part"])),
    )
    return F.flatten(F.array(
        F.array(
            _seg("BEG", "00", po_type(F.col("o_orderpriority")), F.when(_every(19), "").otherwise(F.concat(F.lit("PO"), "o_orderkey")), "", day),
            _seg("REF", "IA", F.col("o_custkey")), _seg("DTM", "002", day),
        ),
        flag(43, _seg("ITD", "01", "3")), flag(3, _seg("SAC", "A", "C310", "", "", "2500")),
        F.array(_seg("N1", "ST", F.col("c_name"), F.when(_every(5), "1").otherwise("92"), F.col("o_custkey")), _seg("N4", F.col("n_name")), _seg("N1", "BT", F.col("n_name"))),
        F.flatten(F.transform("lines", line)),
        F.array(_seg("CTT", F.size("lines") + F.when(_every(31), 1).otherwise(0)), _seg("AMT", "TT", F.col("total"))),
    ))


def _transactions(o: DataFrame) -> DataFrame:
    """(doc, whole): the segments of each order's transaction, in order."""
    number = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    claimed = F.size("body") + 2 + F.when(_every(13), 2).otherwise(0)
    whole = F.concat(F.array(_seg("ST", "850", number)), F.col("body"), F.array(_seg("SE", claimed, number)))
    return o.withColumn("body", _body()).select(F.col("o_orderkey").alias("doc"), whole.alias("whole"))


def transaction_segments(spark, sf_dir: str, o: DataFrame | None = None) -> DataFrame:
    """doc, seq, seg_id, elements, from ST to SE; o is `orders`, if at hand. No
    transaction is empty: exploded as outer rows, it isn't made once more to be counted."""
    own = _transactions(orders(spark, sf_dir) if o is None else o)
    return own.select("doc", F.posexplode_outer("whole").alias("seq", "s")).select("doc", F.col("seq").cast("long").alias("seq"), "s.seg_id", "s.elements")


def interchange_text(spark, sf_dir: str, per_file: int = 20, o: DataFrame | None = None) -> DataFrame:
    """(file_id, text): up to per_file orders, neighbours by key, in one
    interchange with one group. Files are dealt by file_id, so that their segments
    need no shuffle."""
    line = lambda s: F.array_join(F.concat(F.array(s["seg_id"]), s["elements"]), "*")
    flat = _transactions(orders(spark, sf_dir) if o is None else o).select("doc", F.expr(f"doc div {per_file}").alias("file"), F.array_join(F.transform("whole", line), "~\n").alias("text"))
    files = dealt(flat.withColumn("file_id", F.concat(F.lit("F"), "file")), spark, sf_dir, "file_id").groupBy("file_id").agg(F.first("file").alias("file"), F.sort_array(F.collect_list(F.struct("doc", "text"))).alias("docs"))
    control = F.lpad(F.col("file").cast("string"), 9, "0")
    isa = F.concat(F.lit("ISA*00*" + " " * 10 + "*00*" + " " * 10 + "*ZZ*SENDER" + " " * 9 + "*ZZ*RECEIVER" + " " * 7 + "*260101*1200*U*00401*"), control, F.lit("*0*P*>"))
    n, g = F.size("docs"), F.when(F.col("file") % 7 == 0, 1).otherwise(0)
    text = F.concat(isa, F.lit("~\nGS*PO*SENDER*RECEIVER*20260101*1200*"), "file", F.lit("*X*004010~\n"), F.array_join(F.transform("docs", lambda d: d["text"]), "~\n"),
                    F.lit("~\nGE*"), (n + g).cast("string"), F.lit("*"), "file", F.when(F.col("file") % 5 == 0, "~\n").otherwise(F.concat(F.lit("~\nIEA*1*"), control, F.lit("~\n"))))
    return files.select("file_id", text.alias("text"))


def output_documents(spark, sf_dir: str, o: DataFrame | None = None) -> DataFrame:
    """(doc, json): the translated documents."""
    day = F.col("o_orderdate")
    kept = F.when(_every(7), F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))
    unit = lambda u: F.when(_every(17), u).otherwise(F.when(u == "EA", "EACH").when(u == "CA", "CASE").otherwise("DOZEN"))
    line = lambda x: F.struct(
        x["line_ix"].alias("line_no"), x["qty"].alias("qty"), unit(x["unit"]).alias("uom"), x["price"].alias("price"),
        F.when(x["part"] % 5 != 0, x["part"].cast("string")).alias("part"), F.concat(F.lit("part "), x["part"]).alias("text"),
    )
    order = F.struct(
        F.lit("ORIGINAL").alias("purpose"), F.when(po_type(F.col("o_orderpriority")) == "DS", "DROP_SHIP").when(po_type(F.col("o_orderpriority")) == "NE", "NEW_ORDER").otherwise("STANDALONE").alias("type"),
        F.when(po_type(F.col("o_orderpriority")) == "DS", "Y").otherwise("N").alias("drop_ship"),
        F.when(~_every(19), F.when(_every(11), F.concat(F.lit("XX"), "o_orderkey")).otherwise(F.concat(F.lit("PO"), "o_orderkey"))).alias("po_number"),
        F.when(_every(37), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("po_date"), F.lit("PO_INBOUND").alias("record_type"),
        F.col("o_custkey").cast("string").alias("vendor"), F.date_format(F.date_add(day, 7), "yyyy-MM-dd").alias("due_date"), F.lit("NONE").alias("release"),
        F.when(_every(3), F.lit("25.00").cast("decimal(6,2)")).alias("allowance"), F.when(_every(41), "?").alias("extra"),
    )
    ship = F.struct(F.col("c_name").alias("name"), F.when(~_every(5), F.col("o_custkey").cast("string")).alias("id"), F.col("n_name").alias("city"))
    total = F.struct(F.size("lines").alias("line_count"), F.col("total").alias("total"))
    whole = F.struct(order.alias("order"), ship.alias("ship_to"), F.transform(kept, line).alias("lines"), total.alias("summary"))
    # a filter by the key alone would be pushed below the shuffles, which were then made
    # once for segments and once for documents; one that names lines too stays above
    kept_orders = ~_every(23) | (F.size("lines") < 0)
    return (orders(spark, sf_dir) if o is None else o).where(kept_orders).select(F.col("o_orderkey").alias("doc"), F.to_json(whole).alias("json"))
