"""Category summaries that must tie to the balance chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MONEY, money
from ..functions.money import format_indian
from .rules import TAXONOMY, UNCLASSIFIED, taxonomy_frame


def category_totals(rows: DataFrame) -> DataFrame:
    """Every category of every document, also those without rows, in the summary's order: n, credit, debit."""
    agg = rows.groupBy("doc_id", F.col("category").alias("code")).agg(F.count("*").alias("n"), money(F.sum("credit")).alias("credit"), money(F.sum("debit")).alias("debit"))
    spark = rows.sparkSession
    codes = F.array(*[F.lit(t[0]) for t in TAXONOMY])
    every = rows.select("doc_id").distinct().select("doc_id", F.explode(codes).alias("code"))
    zero = F.lit(0).cast(MONEY)
    full = every.join(agg, ["doc_id", "code"], "left").join(F.broadcast(taxonomy_frame(spark).select("ord", "code", "description", "contra")), "code")
    return full.select("doc_id", "ord", "code", "description", "contra", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("credit", zero).alias("credit"), F.coalesce("debit", zero).alias("debit"))


def summary(rows: DataFrame) -> DataFrame:
    """Per document: counts and totals over all categories, and the ledgers in the order of their first use."""
    uses = rows.groupBy("doc_id", "tally_ledger").agg(
        F.min(F.struct("page_no", "source_row")).alias("first"), F.count("*").alias("n"), F.sum("credit").alias("c"), F.sum("debit").alias("d"), F.count_if((F.col("credit") > 0) | (F.col("debit") > 0)).alias("moved"),
        F.count_if("needs_review").alias("review"), F.count_if("contra").alias("contra"), F.count_if(F.col("category") == UNCLASSIFIED).alias("uncl"),
    )
    total = lambda c: F.sum(c)
    out = uses.groupBy("doc_id").agg(
        total("n").alias("n_rows"), money(total("c")).alias("total_credit"), money(total("d")).alias("total_debit"), total("moved").alias("movement_count"), total("review").alias("review_count"), total("contra").alias("contra_count"),
        total("uncl").alias("unclassified"), F.transform(F.sort_array(F.collect_list(F.struct("first", "tally_ledger"))), lambda x: x["tally_ledger"]).alias("ledgers"),
    )
    return out.withColumn("settled_count", F.col("n_rows") - F.col("movement_count"))


def tie(summaries: DataFrame, reports: DataFrame) -> DataFrame:
    """Per document: credit, debit and movements of the summary less those of the chain, and whether all are nothing."""
    joined = summaries.alias("s").join(reports.alias("r"), "doc_id")
    credit, debit = money(F.col("s.total_credit") - F.col("r.total_credit")), money(F.col("s.total_debit") - F.col("r.total_debit"))
    moved = F.col("s.movement_count") - F.col("r.credit_count") - F.col("r.debit_count")
    return joined.select("doc_id", credit.alias("credit_variance"), debit.alias("debit_variance"), moved.alias("movement_variance"), ((credit == 0) & (debit == 0) & (moved == 0)).alias("ties"))


def as_json(rows: DataFrame) -> DataFrame:
    """Per document, the summary as JSON with money as text."""
    lines = category_totals(rows).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.struct("code", "description", "contra", F.col("n").alias("count"), F.col("credit").cast("string").alias("credit"), F.col("debit").cast("string").alias("debit")).alias("x")))).alias("x"))
    s = summary(rows)
    body = F.to_json(F.struct(F.transform("x", lambda v: v["x"]).alias("categories"), F.col("n_rows").alias("count"), "movement_count", F.col("total_credit").cast("string").alias("total_credit"), F.col("total_debit").cast("string").alias("total_debit"), "unclassified", "review_count", "contra_count", "ledgers"))
    return lines.join(s, "doc_id").select("doc_id", body.alias("summary"))


def render(rows: DataFrame) -> DataFrame:
    """Per document, the summary as printed lines with a total."""
    totals = category_totals(rows)
    line = lambda code, text, n, c, d: F.concat(F.rpad(code, 9, " "), F.rpad(text, 30, " "), F.lpad(n.cast("string"), 7, " "), F.lpad(c, 18, " "), F.lpad(d, 18, " "))
    each = totals.withColumn("line", line(F.col("code"), F.col("description"), F.col("n"), format_indian(F.col("credit"), True), format_indian(F.col("debit"), True)))
    out = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("x"), F.sum("n").alias("n"), money(F.sum("credit")).alias("c"), money(F.sum("debit")).alias("d"))
    rule = F.lit("-" * 82)
    head = F.concat(F.rpad(F.lit("Cat"), 9, " "), F.rpad(F.lit("Description"), 30, " "), F.lpad(F.lit("Count"), 7, " "), F.lpad(F.lit("Credit"), 18, " "), F.lpad(F.lit("Debit"), 18, " "))
    foot = line(F.lit(""), F.lit("TOTAL"), F.col("n"), format_indian(F.col("c")), format_indian(F.col("d")))
    return out.select("doc_id", F.array_join(F.concat(F.array(head, rule), F.transform("x", lambda v: v["line"]), F.array(rule, foot)), "\n").alias("report"))
