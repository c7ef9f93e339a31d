"""The running balance of a document's rows: movements, directions, verification, report.

Rows have doc_id, page_no, source_row, balance and, where named, printed_amount and opening; the order of a document's
rows is (page_no, source_row). Windows are partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, money
from ..functions.money import format_drcr, format_indian
from ..schema import REPAIRED, UNRESOLVED

ORDER = ("page_no", "source_row")


def in_order(*more: str):
    return Window.partitionBy("doc_id").orderBy(*ORDER, *more)


def signed_amount(credit: str = "credit", debit: str = "debit") -> Column:
    return money(F.col(credit) - F.col(debit))


def is_consistent(delta: Column, amount: Column) -> Column:
    """Both known, and equal in size."""
    return F.coalesce(F.abs(delta) == F.abs(amount), F.lit(False))


def with_opening(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows with their account's opening (0 if not given) and closing."""
    known = accounts.select("doc_id", money("opening").alias("opening"), money("closing").alias("closing"))
    return rows.join(known, "doc_id", "left").withColumn("opening", F.coalesce("opening", F.lit(0).cast(MONEY)))


def deltas(rows: DataFrame) -> DataFrame:
    """delta: the balance less the last known one before it (the opening at first); null where the balance is."""
    before = F.last("balance", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("delta", money(F.col("balance") - F.coalesce(before, F.col("opening"))))


def strict_deltas(rows: DataFrame) -> DataFrame:
    """strict_delta: the balance less that of the very row before; null if either is."""
    first = F.row_number().over(in_order()) == 1
    before = F.when(first, F.col("opening")).otherwise(F.lag("balance").over(in_order()))
    return rows.withColumn("strict_delta", money(F.col("balance") - before))


def set_direction(rows: DataFrame, delta: str = "delta") -> DataFrame:
    """credit and debit from the movement; rows without a movement carry none."""
    d = F.coalesce(F.col(delta), F.lit(0).cast(MONEY))
    return rows.withColumn("credit", money(F.greatest(d, F.lit(0).cast(MONEY)))).withColumn("debit", money(F.greatest(-d, F.lit(0).cast(MONEY))))


def apply_directions(rows: DataFrame) -> DataFrame:
    return set_direction(deltas(rows))


def recompute_forward(rows: DataFrame) -> DataFrame:
    """balance: the opening and all signed amounts so far."""
    so_far = F.sum(signed_amount()).over(in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("balance", money(F.col("opening") + so_far))


def totals(rows: DataFrame) -> DataFrame:
    """Per document: total_debit, total_credit and the count of rows, twice as readers expect it."""
    return rows.groupBy("doc_id").agg(money(F.sum("debit")).alias("total_debit"), money(F.sum("credit")).alias("total_credit"), F.count("*").alias("n_rows"), F.count("*").alias("n_settled"))


def report(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row for each account: opening, totals, counts, computed and printed closing, variance, and whether it ties."""
    zero = F.lit(0).cast(MONEY)
    agg = rows.groupBy("doc_id").agg(
        money(F.sum("debit")).alias("total_debit"), money(F.sum("credit")).alias("total_credit"), F.count_if(F.col("debit") > 0).alias("debit_count"), F.count_if(F.col("credit") > 0).alias("credit_count"),
        F.count_if(F.col("row_state") == REPAIRED).alias("repaired"), F.count_if(F.col("row_state") == UNRESOLVED).alias("unresolved"),
    )
    out = accounts.select("doc_id", F.coalesce(money("opening"), zero).alias("opening"), money("closing").alias("closing_printed")).join(agg, "doc_id", "left")
    out = out.fillna(0, ["debit_count", "credit_count", "repaired", "unresolved"]).withColumns({c: F.coalesce(c, zero) for c in ("total_debit", "total_credit")})
    out = out.withColumn("closing_computed", money(F.col("opening") + F.col("total_credit") - F.col("total_debit")))
    out = out.withColumn("variance", F.coalesce(money(F.col("closing_computed") - F.col("closing_printed")), zero))
    out = out.withColumn("balances_tie", F.col("closing_printed").isNotNull() & (F.col("variance") == 0))
    return out.withColumn("reconciled", F.col("balances_tie") & (F.col("unresolved") == 0)).withColumn("blocks_export", F.col("unresolved") > 0)


def row_agreement(rows: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """Per document: consecutive pairs, those whose movement is the printed amount, and the share. Pairs with an unknown
    balance are compared (and disagree) if ``keep_nulls``."""
    before = F.lag("balance").over(in_order())
    first = F.row_number().over(in_order()) == 1
    pairs = rows.select("doc_id", first.alias("first"), before.alias("before"), "balance", "printed_amount").filter("NOT first")
    if not keep_nulls:
        pairs = pairs.filter("before IS NOT NULL AND balance IS NOT NULL")
    agg = pairs.groupBy("doc_id").agg(F.count("*").alias("comparisons"), F.count_if(is_consistent(F.col("balance") - F.col("before"), F.col("printed_amount"))).alias("agreeing"))
    return agg.withColumn("agreement", F.round(100.0 * F.col("agreeing") / F.col("comparisons"), 4))


def render(reports: DataFrame) -> DataFrame:
    """Per document, the chain's report as printed lines."""
    counted = lambda amount, n: F.concat(format_indian(F.col(amount)), F.format_string("  (%d)", n))
    printed = F.col("closing_printed").isNotNull()
    body = F.array_compact(F.array(
        F.concat(F.lit("opening        "), format_drcr(F.col("opening"))), F.concat(F.lit("total credits  "), counted("total_credit", "credit_count")), F.concat(F.lit("total debits   "), counted("total_debit", "debit_count")),
        F.concat(F.lit("closing (calc) "), format_drcr(F.col("closing_computed"))), F.when(printed, F.concat(F.lit("closing (print)"), format_drcr(F.col("closing_printed")))),
        F.when(printed, F.concat(F.lit("variance       "), format_indian(F.col("variance")))), F.format_string("repaired %d   unresolved %d", "repaired", "unresolved"),
    ))
    return reports.select("doc_id", F.array_join(body, "\n").alias("report"))
