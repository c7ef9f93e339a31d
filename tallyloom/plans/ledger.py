"""Ledgers, statements and queues made from the star-schema tables, as inputs of the registered queries.

An account is a customer; its rows are that customer's orders by date and key, credits where the key is a multiple of
three, debits elsewhere; balances run from 0. Everything else (templates of narrations, damage, faults, layout) follows
from keys by modulus, so that SQL can state the expected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, money
from ..functions.money import format_indian

#: Invented names of holders.
HOLDERS = ("ASHA BORA", "KIRAN DOLI", "MEENA SAHU", "TARUN GOGOI")
#: Narrations by template; # is a six-digit number, @ the holder's name.
TEMPLATES = (
    "UPI/CR/RAMU/AXL", "NEFT CR-HDFC0001-PHONEPE LIMITED", "IMPS-532116454511-KANU-UCBA0002520", "CASH DEP-SELF", "ATM WDL 4276 TOWN", "# TOWN", "GST 1820-GST", "INTEREST CHARGED", "WOBBLE FLUX", "UPI/DR/@/PUNB",
    "ELECTRCITY BILL PAYMENT", "RETURNED CHQ REVERSAL",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k (the order's key), page_no, source_row, date, amount, credit, debit, balance, opening, narration, holder."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("date"), money("o_totalprice").alias("amount"))
    w = Window.partitionBy("doc_id").orderBy("date", "k")
    zero = F.lit(0).cast(MONEY)
    o = o.withColumn("source_row", (F.row_number().over(w) - 1).cast("int")).withColumn("page_no", (F.lit(1) + F.floor(F.col("source_row") / 20)).cast("int"))
    o = o.withColumn("credit", F.when(F.col("k") % 3 == 0, F.col("amount")).otherwise(zero)).withColumn("debit", F.when(F.col("k") % 3 != 0, F.col("amount")).otherwise(zero))
    o = o.withColumn("balance", money(F.sum(F.col("credit") - F.col("debit")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).withColumn("opening", zero)
    holder = F.element_at(F.array(*[F.lit(h) for h in HOLDERS]), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("k") % 12 + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("#"), F.lpad((F.col("k") % 900000 + 100000).cast("string"), 6, "0")), F.lit("@"), holder)
    damaged = F.when(F.col("k") % 5 == 0, F.translate(text, "IOS", "105")).otherwise(text)
    return o.withColumn("holder", F.concat(F.lit("MR. "), holder)).withColumn("narration", damaged)


def accounts(rows: DataFrame) -> DataFrame:
    """doc_id, holder, opening, closing (the last balance) of each account."""
    return rows.groupBy("doc_id").agg(F.first("holder").alias("holder"), F.lit(0).cast(MONEY).alias("opening"), F.max_by("balance", "source_row").alias("closing"))


def chain_rows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "page_no", "source_row", "balance", F.col("amount").alias("printed_amount"))


def faulty(rows: DataFrame, kind: str) -> DataFrame:
    """Chain rows with one fault in every seven rows (place 3): a digit of the amount or the balance, either missing, both
    wrong, or the row gone (unless it is the last)."""
    r = rows.select("doc_id", "page_no", "source_row", "balance", F.col("amount").alias("printed_amount"), (F.count("*").over(Window.partitionBy("doc_id")) - 1 == F.col("source_row")).alias("last"))
    hit = F.col("source_row") % 7 == 3
    slip = lambda c: c + F.when(F.floor(F.abs(c) / 10) % 10 < 9, F.signum(c.cast("double"))).otherwise(-F.signum(c.cast("double"))).cast("int") * 10
    amount, balance = F.col("printed_amount"), F.col("balance")
    if kind == "amount":
        r = r.withColumn("printed_amount", money(F.when(hit, slip(amount)).otherwise(amount)))
    elif kind == "balance":
        r = r.withColumn("balance", money(F.when(hit, slip(balance)).otherwise(balance)))
    elif kind == "no_balance":
        r = r.withColumn("balance", F.when(~hit, balance))
    elif kind == "no_amount":
        r = r.withColumn("printed_amount", F.when(~hit, amount))
    elif kind == "both":
        r = r.withColumn("balance", money(F.when(hit, slip(balance)).otherwise(balance))).withColumn("printed_amount", money(F.when(hit, amount + F.lit("12345.67").cast(MONEY)).otherwise(amount)))
    elif kind == "row":
        r = r.filter(~hit | F.col("last"))
    else:
        raise ValueError(kind)
    return r.drop("last")


def printed(c: Column) -> Column:
    """A signed balance with its marker."""
    return F.concat(format_indian(F.abs(c)), F.when(c < 0, " Dr").otherwise(" Cr"))


def statement_lines(rows: DataFrame) -> DataFrame:
    """Statement pages: a header, a column header, the page's rows, a rule, page totals; on the last page the balance
    carried forward. doc_id, page_no, line_no, text, confidence."""
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    each = rows.withColumn("last_page", last)
    line = F.concat_ws("  ", F.date_format("date", "dd/MM/yyyy"), "narration", format_indian(F.col("amount")), printed(F.col("balance")))
    body = each.select("doc_id", "page_no", (F.col("source_row") % 20 + 10).alias("line_no"), line.alias("text"))
    pages = each.groupBy("doc_id", "page_no").agg(F.sum("credit").alias("credit"), F.sum("debit").alias("debit"), F.max("last_page").alias("last_page"), F.max_by("balance", "source_row").alias("balance"))
    extra = F.array_compact(F.array(
        F.struct(F.lit(1).alias("n"), F.concat(F.lit("Service Outlet : 0042   Page no. "), F.col("page_no").cast("string")).alias("t")),
        F.struct(F.lit(2).alias("n"), F.lit("Date  Particulars  Chq No  Withdrawal  Deposit  Balance").alias("t")),
        F.struct(F.lit(40).alias("n"), F.lit("------------------------").alias("t")),
        F.struct(F.lit(41).alias("n"), F.concat(F.lit("Page Total Credit : "), format_indian(F.col("credit"))).alias("t")),
        F.struct(F.lit(42).alias("n"), F.concat(F.lit("Page Total Debit : "), format_indian(F.col("debit"))).alias("t")),
        F.when(F.col("page_no") == F.col("last_page"), F.struct(F.lit(43).alias("n"), F.concat(F.lit("Carried Forward "), printed(F.col("balance"))).alias("t"))),
    ))
    rest = pages.select("doc_id", "page_no", F.explode(extra).alias("x")).select("doc_id", "page_no", F.col("x.n").alias("line_no"), F.col("x.t").alias("text"))
    return body.unionByName(rest).withColumn("confidence", F.lit(100.0) - F.col("line_no") % 7)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on pages: an order is a page, its lines are rows 40 apart, each of three words at 0, 200 and 400."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("p"))
    li = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").cast("int").alias("n"), money("p").alias("v"))
    w = F.array(*[F.struct(F.lit(200 * i).alias("left"), t.alias("text")) for i, t in enumerate((F.concat(F.lit("L"), F.col("n").cast("string")), F.lit("ITEM"), format_indian(F.col("v"))))])
    x = li.select("doc_id", "page_no", "n", F.explode(w).alias("w"))
    top = F.col("n") * 40 + F.col("doc_id") % 3 + F.floor(F.col("w.left") / 200) * 2
    return x.select("doc_id", "page_no", F.col("w.text").alias("text"), F.col("w.left").cast("int").alias("left"), top.cast("int").alias("top"), F.lit(150).alias("width"), F.lit(20).alias("height"), (F.lit(90.0) + F.col("n")).alias("confidence"))


def band_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled lines of those pages: a row rule above each line (every 40 from 30 on) and below the last, columns at 0, 180, 380, 600."""
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linenumber").cast("int").alias("n"))
    rows = n.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n") + 1)).alias("i")).select("doc_id", F.lit(1).alias("page_no"), F.lit("row").alias("axis"), (F.col("i") * 40 - 10).alias("pos"))
    cols = n.select("doc_id", F.lit(1).alias("page_no"), F.lit("col").alias("axis"), F.explode(F.array(*[F.lit(x) for x in (0, 180, 380, 600)])).alias("pos"))
    return rows.unionByName(cols)


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages: an order is a document, its lines are pages, with resolution, depth and colour by modulus."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    li = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_no"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("m"))
    dpi = F.element_at(F.array(*[F.lit(x) for x in (150, 200, 240, 300, 400)]), (F.col("m") % 5 + 1).cast("int"))
    turned = F.col("m") % 4 == 1
    w, h = (dpi * 8.5).cast("int"), dpi * 11
    return li.select(
        "doc_id", "page_no", F.when(F.col("m") % 6 == 0, "DIGITAL").otherwise("SCANNED").alias("page_class"), (F.col("m") % 11 != 0).alias("has_image"), F.when(F.col("m") % 13 != 0, F.when(turned, h).otherwise(w)).alias("src_w"),
        F.when(F.col("m") % 13 != 0, F.when(turned, w).otherwise(h)).alias("src_h"), F.lit(612.0).alias("width_pt"), F.lit(792.0).alias("height_pt"), F.when(F.col("m") % 7 == 0, 1).otherwise(8).alias("bits"),
        F.when(F.col("m") % 3 == 0, "DeviceRGB").otherwise("DeviceGray").alias("colorspace"), F.when(F.col("m") % 2 == 0, "DCTDecode").otherwise("FlateDecode").alias("codec"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue events: a user is a job, its events by id are the moves; what each sets follows from its type."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id"), F.col("ts").alias("at"), (F.col("event_id") % 7).cast("int").alias("m"), "value")
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("event_id")).cast("long")
    states = F.create_map(*[x for i, s in enumerate(("RUNNING", "NEEDS_HEADER", "QUEUED", "PARSED", "FAILED")) for x in (F.lit(i), F.lit(s))])
    e = e.withColumn("seq", seq)
    return e.select(
        "job_id", "seq", "at", F.when(F.col("seq") == 1, "QUEUED").otherwise(F.try_element_at(states, F.col("m"))).alias("state"), F.when(F.col("m") == 1, "PARSE").when(F.col("seq") == 1, "HEADER").alias("stage"),
        F.when(F.col("m") == 0, F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string"))).alias("claimed_by"), F.when(F.col("m") == 5, F.floor("value").cast("int")).alias("progress_done"),
    )
