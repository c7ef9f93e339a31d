"""Evidence about a parse: what the pages, rows and check figures say, and how engines compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, money
from ..functions.money import format_drcr, format_indian
from . import lines as L
from .chain import is_consistent

#: Notes that a report shows before it only counts them.
SHOWN = 25


def evidence(rows: DataFrame, anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: printed pages, rows, unparsed lines, mean confidence, page totals, brought-forward figures, dates."""
    zero = F.lit(0).cast(MONEY)
    p = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("printed_pages")))).alias("printed_pages"), F.sum("unparsed_lines").alias("unparsed_lines"), F.coalesce(F.avg(F.nullif("mean_confidence", F.lit(0.0))), F.lit(0.0)).alias("mean_confidence"))
    r = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    of = lambda kind: F.col("kind") == kind
    a = anchors.groupBy("doc_id").agg(
        money(F.sum(F.when(of("PAGE_TOTAL_CREDIT"), F.col("value")))).alias("page_total_credit"), money(F.sum(F.when(of("PAGE_TOTAL_DEBIT"), F.col("value")))).alias("page_total_debit"),
        F.count_if(of("PAGE_TOTAL_CREDIT") | of("PAGE_TOTAL_DEBIT")).alias("page_total_count"),
        F.transform(F.sort_array(F.collect_list(F.when(of("BF_BALANCE") & (F.col("value") != 0), F.struct("page_no", "source_row", "value")))), lambda x: x["value"]).alias("bf_balances"),
    )
    out = p.join(r, "doc_id", "left").join(a, "doc_id", "left")
    return out.withColumns({"page_total_credit": F.coalesce("page_total_credit", zero), "page_total_debit": F.coalesce("page_total_debit", zero), "bf_balances": F.coalesce("bf_balances", F.array().cast("array<decimal(18,2)>"))}).fillna(0, ["n_rows", "page_total_count"])


def page_totals(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Printed page totals against the sums of the page's rows, per page that prints one."""
    sums = rows.groupBy("doc_id", "page_no").agg(money(F.sum("credit")).alias("credit"), money(F.sum("debit")).alias("debit"))
    printed = anchors.filter(F.col("kind").isin("PAGE_TOTAL_CREDIT", "PAGE_TOTAL_DEBIT")).groupBy("doc_id", "page_no", "kind").agg(money(F.sum("value")).alias("printed"))
    joined = printed.join(sums, ["doc_id", "page_no"], "left")
    own = F.coalesce(F.when(F.col("kind") == "PAGE_TOTAL_CREDIT", F.col("credit")).otherwise(F.col("debit")), F.lit(0).cast(MONEY))
    return joined.select("doc_id", "page_no", "kind", "printed", own.alias("summed"), money(own - F.col("printed")).alias("difference"))


def against_expected(reports: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected figures (doc_id, label, want) against the chain's: got, difference and whether it is nothing."""
    figures = F.create_map(F.lit("opening"), F.col("opening"), F.lit("closing"), F.col("closing_computed"), F.lit("total_credit"), F.col("total_credit"), F.lit("total_debit"), F.col("total_debit"))
    got = reports.select("doc_id", F.explode(figures).alias("label", "got"))
    out = expected.select("doc_id", "label", money("want").alias("want")).join(got, ["doc_id", "label"])
    return out.select("doc_id", "label", "want", "got", money(F.col("got") - F.col("want")).alias("difference"), (F.col("got") == F.col("want")).alias("ok"))


def bake_off(lines: DataFrame, layout: L.Profile | None = None) -> DataFrame:
    """Per engine, over pages of lines (engine, doc_id, page_no, line_no, text): rows, figures, and the agreement of
    consecutive rows of a page. A text that several engines have at one place is read once,
    its kind only if its figures make a row; the shuffle by pages serves that, the window and nothing else."""
    place = ["doc_id", "page_no", "line_no"]
    texts = lines.repartition("doc_id", "page_no").groupBy(*place, "text").agg(F.collect_list(F.struct("engine")).alias("__engines"))
    seen = texts.select("__engines", *place, L.row_figures(F.col("text"), layout).alias("__f")).select(F.inline("__engines"), *place, "__f.*")
    w = Window.partitionBy("engine", "doc_id", "page_no").orderBy("line_no", "balance", "printed_amount")
    before = F.last("balance", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    pairs = seen.withColumn("__second", F.col("balance").isNotNull() & before.isNotNull()).withColumn("__fits", is_consistent(F.col("balance") - before, F.col("printed_amount")))
    out = pairs.groupBy("engine").agg(F.sum("money_tokens").alias("money_tokens"), F.count("balance").alias("n_rows"), F.count_if("__second").alias("comparisons"), F.count_if(F.col("__second") & F.col("__fits")).alias("agreeing"))
    return out.withColumn("agreement", F.when(F.col("comparisons") > 0, F.round(100.0 * F.col("agreeing") / F.col("comparisons"), 4)).otherwise(0.0))


def render(found: DataFrame, reports: DataFrame, notes: DataFrame) -> DataFrame:
    """Per document, the evidence as printed lines."""
    e = found.join(reports.select("doc_id", "opening", "closing_computed", "variance", "reconciled"), "doc_id", "left").join(notes, "doc_id", "left")
    n = F.coalesce(F.size("notes"), F.lit(0))
    span = F.when(F.size("printed_pages") > 0, F.concat_ws("-", F.array_min("printed_pages").cast("string"), F.array_max("printed_pages").cast("string"))).otherwise("none legible")
    line = lambda label, value: F.concat(F.lit(f"  {label:<20}"), value.cast("string"))
    shown = F.concat(F.transform(F.slice(F.coalesce("notes", F.array().cast("array<string>")), 1, SHOWN), lambda x: F.concat(F.lit("  "), x)), F.when(n > SHOWN, F.array(F.format_string("  ... and %d more", n - SHOWN))).otherwise(F.array().cast("array<string>")))
    body = F.concat(
        F.array(
            F.lit("PAGES"), line("pages", F.col("pages")), line("printed page nos.", span), F.lit("EXTRACTION"), line("transaction rows", F.col("n_rows")), line("unparsed lines", F.col("unparsed_lines")), line("mean confidence", F.format_number("mean_confidence", 1)),
            line("date range", F.concat_ws(" to ", F.coalesce(F.col("first_date").cast("string"), F.lit("?")), F.coalesce(F.col("last_date").cast("string"), F.lit("?")))), F.lit("PRINTED ANCHORS"), line("page-total lines", F.col("page_total_count")),
            line("sum of page credits", format_indian(F.col("page_total_credit"))), line("sum of page debits", format_indian(F.col("page_total_debit"))), line("B/F balances seen", F.size("bf_balances")), F.lit("RECONCILIATION"),
            line("opening", format_drcr(F.col("opening"))), line("closing", format_drcr(F.col("closing_computed"))), line("variance", format_indian(F.col("variance"))), line("reconciled", F.col("reconciled")), F.concat(F.lit("UNRESOLVED "), n.cast("string")),
        ),
        shown,
    )
    return e.select("doc_id", F.array_join(body, "\n", "").alias("report"))
