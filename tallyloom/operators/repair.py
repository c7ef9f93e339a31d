"""Repair of single-field errors in balance chains.

A row is consistent if its balance moves by its printed amount. Repairs never reach past a consistent row: a row's
balance is only rewritten where the next row is inconsistent as well (or there is none). So the inconsistent rows of a
document fall into islands that can be folded one by one, in parallel, whatever the document's length; consistent rows
take no part. The fold carries the balance before, whether the row before stays unresolved, and whether it had its
balance corrected; it is a JVM ``aggregate`` over the island's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, let, money, record
from ..functions.similarity import plausible
from ..schema import CLEAN, REPAIRED, UNRESOLVED
from . import chain

# What the diagnoses say.
UPSTREAM = "delta unreliable: the preceding row is unresolved"
NO_INTERPOLATION = "balance illegible and cannot be interpolated"
NOT_UNIQUE = "balance illegible; neighbours do not determine it uniquely"
RECOVERED = "amount recovered from balance delta"
NO_REFEREE = "final row disagrees and no printed closing resolves it"
NO_BALANCE = "no balance value satisfies both neighbouring rows"
CORRECTED = "balance of preceding row corrected"



def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def _finding(kind: str, detail: Column | str, applied: bool, balance: Column, amount: Column) -> Column:
    return record(kind=F.lit(kind), detail=F.lit(detail) if isinstance(detail, str) else detail, applied=F.lit(applied), balance=balance.cast(MONEY), amount=amount.cast(MONEY))


def _both(before: Column, amount: Column) -> Column:
    """The balances that an amount of either sign leads to."""
    return F.array(money(before + F.abs(amount)), money(before - F.abs(amount)))


def _missing_balance(e: Column, before: Column) -> Column:
    after, then = F.when(e["last"], e["closing"]).otherwise(e["next_balance"]), F.when(e["last"], F.lit(None).cast(MONEY)).otherwise(e["next_amount"])
    fits = lambda c: F.when(after.isNull(), True).when(then.isNotNull(), F.abs(money(after - c)) == F.abs(then)).otherwise(c == after)
    unread = lambda why: _finding("BALANCE_MISSING", why, False, e["balance"], e["amount"])
    found = let(F.filter(_both(before, e["amount"]), fits), lambda cs: F.when(F.size(cs) == 1, _finding("BALANCE_MISSING", _say("balance interpolated as ", cs[0]), True, cs[0], e["amount"])).otherwise(unread(NOT_UNIQUE)))
    return F.when(e["amount"].isNull(), unread(NO_INTERPOLATION)).otherwise(found)


def _last(e: Column, before: Column, delta: Column) -> Column:
    known = e["closing"].isNotNull()
    amount = _finding("AMOUNT_CORRUPT", _say("amount ", e["amount"], " -> ", F.abs(delta), "; balance matches printed closing"), True, e["balance"], F.abs(delta))
    balance = _finding("BALANCE_CORRUPT", _say("balance ", e["balance"], " -> ", e["closing"], " from printed closing"), True, e["closing"], e["amount"])
    none = _finding("AMBIGUOUS", NO_REFEREE, False, e["balance"], e["amount"])
    return F.when(known & (e["balance"] == e["closing"]), amount).when(known & F.exists(_both(before, e["amount"]), lambda c: c == e["closing"]), balance).otherwise(none)


def _amount(e: Column, delta: Column) -> Column:
    wanted = F.abs(delta)
    fixed = _finding("AMOUNT_CORRUPT", _say("amount ", e["amount"], " -> ", wanted, " from balance delta"), True, e["balance"], wanted)
    gaps = F.array_sort(F.filter(F.array_distinct(F.transform(_both(delta, e["amount"]), lambda c: F.abs(c))), lambda c: c != 0))
    lost = _say("balance moves ", delta, " but this row shows ", e["amount"], "; a transaction of ", F.array_join(F.transform(gaps, lambda c: c.cast("string")), " or "), " appears to be missing before this row")
    missing = F.when(F.size(gaps) > 0, _finding("MISSING_ROW", lost, False, e["balance"], e["amount"])).otherwise(_finding("AMBIGUOUS", "amount and delta irreconcilable", False, e["balance"], e["amount"]))
    return F.when(plausible(e["amount"], wanted), fixed).otherwise(missing)


def _balance(e: Column, before: Column) -> Column:
    confirmed = lambda c: F.when(e["next_amount"].isNotNull() & e["next_balance"].isNotNull(), F.abs(money(e["next_balance"] - c)) == F.abs(e["next_amount"])).otherwise(True)
    chosen = lambda c: _finding("BALANCE_CORRUPT", _say("balance ", e["balance"], " -> ", c, ", confirmed by the following row"), True, c, e["amount"])
    open_ = lambda why: _finding("AMBIGUOUS", why, False, e["balance"], e["amount"])

    def pick(cs: Column) -> Column:
        likely = F.filter(cs, lambda c: plausible(e["balance"], c))
        several = let(likely, lambda ps: F.when(F.size(ps) == 1, chosen(ps[0])).otherwise(open_(_say("balance could be either ", F.array_join(F.transform(cs, lambda c: c.cast("string")), " or ")))))
        return F.when(F.size(cs) == 0, open_(NO_BALANCE)).when(F.size(cs) == 1, chosen(cs[0])).otherwise(several)

    return let(F.array_distinct(F.filter(_both(before, e["amount"]), confirmed)), pick)


def _diagnose(e: Column, before: Column, broken: Column) -> Column:
    """What is wrong with an inconsistent row, first case that fits."""
    delta = money(e["balance"] - before)
    next_fits = chain.is_consistent(money(e["next_balance"] - e["balance"]), e["next_amount"])
    return (
        F.when(broken | before.isNull(), _finding("UPSTREAM_BREAK", UPSTREAM, False, e["balance"], e["amount"]))
        .when(e["balance"].isNull(), _missing_balance(e, before))
        .when(e["amount"].isNull(), _finding("AMOUNT_MISSING", RECOVERED, True, e["balance"], F.abs(delta)))
        .when(e["last"], _last(e, before, delta))
        .when(next_fits, _amount(e, delta))
        .otherwise(_balance(e, before))
    )


_OUT = "array<struct<row:int,balance:decimal(18,2),amount:decimal(18,2),state:string,note:string,kind:string,detail:string,applied:boolean>>"


def _fold(island: Column) -> Column:
    """The island's rows after repair."""
    none = F.lit(None).cast("string")
    start = record(before=island[0]["before"], broken=F.lit(False), corrected=F.lit(False), out=F.array().cast(_OUT))

    def step(s: Column, e: Column) -> Column:
        carried = F.when(s["corrected"], CORRECTED)
        fits = chain.is_consistent(money(e["balance"] - s["before"]), e["amount"])
        kept = record(row=e["row"], balance=e["balance"], amount=e["amount"], state=F.when(s["corrected"], REPAIRED).otherwise(CLEAN), note=F.coalesce(carried, F.lit("")), kind=none, detail=none, applied=F.lit(None).cast("boolean"))
        settled = record(before=e["balance"], broken=F.lit(False), corrected=F.lit(False), out=F.concat(s["out"], F.array(kept)))

        def faulty(d: Column) -> Column:
            row = record(row=e["row"], balance=d["balance"], amount=d["amount"], state=F.when(d["applied"], REPAIRED).otherwise(UNRESOLVED), note=F.concat_ws("; ", carried, d["detail"]), kind=d["kind"], detail=d["detail"], applied=d["applied"])
            return record(before=d["balance"], broken=~d["applied"], corrected=(d["kind"] == "BALANCE_CORRUPT") & ~e["last"], out=F.concat(s["out"], F.array(row)))

        return F.when(fits, settled).otherwise(let(_diagnose(e, s["before"], s["broken"]), faulty))

    return F.aggregate(island, start, step, lambda s: s["out"])


def resolve(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, source_row, balance, printed_amount, opening, closing) with repaired balance and amount,
    row_state, repair_note and the diagnosis: diagnosis_kind, diagnosis_detail, diagnosis_applied (null: none) and
    row_index (from 0 in the document)."""
    w = chain.in_order()
    index = F.row_number().over(w) - 1
    seen = rows.withColumn("row_index", index).withColumn("__before", F.when(F.col("row_index") == 0, F.col("opening")).otherwise(F.lag("balance").over(w)))
    seen = seen.withColumn("__next_balance", F.lead("balance").over(w)).withColumn("__next_amount", F.lead("printed_amount").over(w)).withColumn("__last", F.lead("row_index").over(w).isNull())
    seen = seen.withColumn("__fits", chain.is_consistent(F.col("balance") - F.col("__before"), F.col("printed_amount")))
    seen = seen.withColumn("__island", F.count_if("__fits").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fine = seen.filter("__fits").select(*rows.columns, "row_index", F.lit(CLEAN).alias("row_state"), F.lit("").alias("repair_note"), *[F.lit(None).cast(t).alias(f"diagnosis_{k}") for k, t in (("kind", "string"), ("detail", "string"), ("applied", "boolean"))])
    entry = record(row=F.col("row_index"), balance=money("balance"), amount=money("printed_amount"), before=money("__before"), next_balance=money("__next_balance"), next_amount=money("__next_amount"), last=F.col("__last"), closing=money("closing"))
    packed = seen.filter("NOT __fits").groupBy("doc_id", "__island").agg(F.sort_array(F.collect_list(F.struct(F.col("row_index").alias("k"), entry.alias("e"), F.struct(*rows.columns).alias("r")))).alias("rows"))
    folded = packed.select("rows", _fold(F.transform("rows", lambda x: x["e"])).alias("after")).select(F.explode(F.arrays_zip("rows", "after")).alias("x"))
    changed = {"balance": F.col("x.after.balance"), "printed_amount": F.col("x.after.amount")}
    mended = folded.select(
        *[changed.get(c, F.col(f"x.rows.r.`{c}`")).alias(c) for c in rows.columns], F.col("x.after.row").alias("row_index"), F.col("x.after.state").alias("row_state"), F.col("x.after.note").alias("repair_note"),
        F.col("x.after.kind").alias("diagnosis_kind"), F.col("x.after.detail").alias("diagnosis_detail"), F.col("x.after.applied").alias("diagnosis_applied"),
    )
    return fine.unionByName(mended)


def settle(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows after repair, with credit and debit from the balances. An unresolved row without a balance carries none."""
    return chain.apply_directions(resolve(chain.with_opening(rows, accounts)))


def diagnoses(settled: DataFrame) -> DataFrame:
    """The findings: doc_id, row_index, page_no, kind, detail, applied."""
    return settled.filter("diagnosis_kind IS NOT NULL").select("doc_id", "row_index", "page_no", F.col("diagnosis_kind").alias("kind"), F.col("diagnosis_detail").alias("detail"), F.col("diagnosis_applied").alias("applied"))


def notes(settled: DataFrame) -> DataFrame:
    """Per document, a line for each finding that was not applied, in order."""
    line = F.format_string("row %d (page %d): %s - %s", "row_index", "page_no", "kind", "detail")
    found = diagnoses(settled).filter("NOT applied").select("doc_id", F.struct("row_index", line.alias("line")).alias("x"))
    return found.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]).alias("notes"))
