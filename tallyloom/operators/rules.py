"""Categories of narrations by ordered rules: the first rule that matches wins.

Rules are constants of the plan: a row's words are compared with the distinct words of all rules once, and the rules
are then filtered by set operations. Nothing is shuffled and no Python runs per row; a fuzzy comparison is made only
where the lengths and the edit distance allow it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import texts
from ..functions.similarity import ratio
from ..functions.text import canon_of, display_name, name_words, narration
from ..schema import CREDIT, DEBIT, EITHER

# Categories in the order of the summary: code, description, ledger, direction, and whether it is a contra.
TAXONOMY = [
    ("A", "Opening Balance Adjustment", "Opening Balance Adjustment (Suspense - verify)", EITHER, False),
    ("B", "Closing Balance Adjustment", "Closing Balance Adjustment (Suspense - verify)", EITHER, False),
    ("C", "Bank Charges", "Bank Charges A/c", DEBIT, False),
    ("D", "Interest Credited", "Interest Received A/c", CREDIT, False),
    ("E", "Interest Debited", "Interest Paid A/c", DEBIT, False),
    ("F", "Self Transfers (name match)", "{holder} - Own Accounts (Contra)", EITHER, True),
    ("G", "Subsidies", "Subsidy Received A/c", CREDIT, False),
    ("H", "Pension Scheme", "Pension Receipts A/c", CREDIT, False),
    ("I", "Insurance Received", "Insurance Claims Received A/c", CREDIT, False),
    ("J", "Insurance Paid", "Insurance Premium A/c", DEBIT, False),
    ("K", "Mutual Funds Received", "Mutual Fund Redemptions A/c", CREDIT, False),
    ("L", "Mutual Funds Paid", "Mutual Fund Investments A/c", DEBIT, False),
    ("M", "Salary / Primary Income", "Salary Received A/c", CREDIT, False),
    ("N", "Rent", "Rent A/c", EITHER, False),
    ("O", "Loan EMIs", "Loan Repayment A/c", DEBIT, False),
    ("P", "Tax Payments", "Taxes Paid A/c", DEBIT, False),
    ("Q", "Tax Refunds", "Tax Refund Received A/c", CREDIT, False),
    ("R", "ATM Cash Withdrawals", "Cash A/c (Contra)", DEBIT, True),
    ("S", "Cash Deposits", "Cash A/c (Contra)", CREDIT, True),
    ("T1", "UPI Received (3rd party)", "Sundry Receipts / Debtors", CREDIT, False),
    ("T2", "UPI Sent (3rd party)", "Sundry Payments / Creditors", DEBIT, False),
    ("U1", "Cheque / Branch Deposit", "Cheque/Cash Deposit (Suspense - verify)", CREDIT, False),
    ("U2", "Cheque Paid", "Cheque Payments (Suspense - verify)", DEBIT, False),
    ("V", "Utility Bills", "Utility Expenses A/c", DEBIT, False),
    ("W", "Credit Card Bill Payments", "Credit Card Payable A/c", DEBIT, False),
    ("X", "Investment Income", "Investment Income A/c", CREDIT, False),
    ("Y", "Reversals / Refunds", "Reversals / Refunds A/c", EITHER, False),
    ("Z", "RD / FD", "Term Deposits A/c", EITHER, False),
    ("NEFT_IN", "NEFT Inward (3rd party)", "Sundry Receipts - NEFT", CREDIT, False),
    ("NEFT_OUT", "NEFT Outward (3rd party)", "Sundry Payments - NEFT", DEBIT, False),
    ("RTGS_IN", "RTGS Inward (3rd party)", "Sundry Receipts - RTGS", CREDIT, False),
    ("RTGS_OUT", "RTGS Outward (3rd party)", "Sundry Payments - RTGS", DEBIT, False),
    ("IMPS_IN", "IMPS Inward (3rd party)", "Sundry Receipts - IMPS", CREDIT, False),
    ("IMPS_OUT", "IMPS Outward (3rd party)", "Sundry Payments - IMPS", DEBIT, False),
    ("UNCL", "UNCLASSIFIED", "Suspense A/c (Unclassified)", EITHER, False),
]
UNCLASSIFIED = "UNCL"
#: The ledger is named after nobody where the holder is unknown.
NO_HOLDER = "Account Holder"
# Rails that a bare cheque number does not come by, and the digits of such a number.
RAILS = ("upi", "neft", "imps", "rtgs", "cash", "atm", "chq", "cheque", "int")
CHEQUE_DIGITS = (4, 8)
#: The shortest rule words that match fuzzily and by prefix, and the ratio needed.
FUZZY_LENGTH, PREFIX_LENGTH, FUZZY = 5, 6, 85


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    words: tuple[str, ...] = ()
    direction: str = EITHER
    ledger: str | None = None
    review: bool = False
    predicate: str | None = None


#: Structural tests by name: (words, numbers, holder words) to a condition.
PREDICATES: dict[str, Callable[[Column, Column, Column], Column]] = {}


def structural(name: str):
    """Registers a structural test that rules can name."""

    def add(f):
        PREDICATES[name] = f
        return f

    return add


@structural("holder_name")
def _holder(words: Column, numbers: Column, holder: Column) -> Column:
    return (F.size(holder) > 0) & (F.size(F.array_except(holder, words)) == 0)


@structural("bare_cheque_number")
def _cheque(words: Column, numbers: Column, holder: Column) -> Column:
    rails = texts(*sorted({canon_of(r) for r in RAILS}))
    return (F.size(words) <= 2) & ~F.arrays_overlap(words, rails) & F.exists(numbers, lambda n: F.length(n).between(*CHEQUE_DIGITS))


PHONEPE = "Sundry Receipts - PhonePe Aggregator"
# The rules of the default pack, in order of priority: id, category, words, direction, ledger, review, predicate.
DEFAULT_PACK = [
    Rule("self.holder-name", "F", (), EITHER, None, True, "holder_name"),
    Rule("reversal.rev", "Y", ("rev",), EITHER, None, False, None),
    Rule("reversal.reversal", "Y", ("reversal",), EITHER, None, False, None),
    Rule("reversal.reversed", "Y", ("reversed",), EITHER, None, False, None),
    Rule("reversal.refund", "Y", ("refund",), EITHER, None, False, None),
    Rule("reversal.returned", "Y", ("returned",), EITHER, None, False, None),
    Rule("tax.cbdt", "P", ("cbdt",), DEBIT, None, False, None),
    Rule("tax.itns", "P", ("itns",), DEBIT, None, False, None),
    Rule("tax.gstn", "P", ("gstn",), DEBIT, None, False, None),
    Rule("tax.tds", "P", ("tds",), DEBIT, None, False, None),
    Rule("tax.advance", "P", ("advance", "tax"), DEBIT, None, False, None),
    Rule("tax.refund", "Q", ("refund", "tax"), CREDIT, None, False, None),
    Rule("interest.credited", "D", ("interest",), CREDIT, None, False, None),
    Rule("interest.debited", "E", ("interest",), DEBIT, None, False, None),
    Rule("interest.collected", "E", ("int", "coll"), DEBIT, None, False, None),
    Rule("charges.gst", "C", ("gst",), DEBIT, None, False, None),
    Rule("charges.charges", "C", ("charges",), DEBIT, None, False, None),
    Rule("charges.charge", "C", ("charge",), DEBIT, None, False, None),
    Rule("charges.chrg", "C", ("chrg",), DEBIT, None, False, None),
    Rule("charges.fees", "C", ("fees",), DEBIT, None, False, None),
    Rule("charges.fee", "C", ("fee",), DEBIT, None, False, None),
    Rule("charges.commission", "C", ("commission",), DEBIT, None, False, None),
    Rule("charges.penalty", "C", ("penalty",), DEBIT, None, False, None),
    Rule("charges.sms", "C", ("sms", "alert"), DEBIT, None, False, None),
    Rule("charges.min-balance", "C", ("min", "bal"), DEBIT, None, False, None),
    Rule("charges.amb", "C", ("amb",), DEBIT, None, False, None),
    Rule("cash.deposit", "S", ("cash", "dep"), CREDIT, None, False, None),
    Rule("cash.deposit-long", "S", ("cash", "deposit"), CREDIT, None, False, None),
    Rule("cash.cdm", "S", ("cdm",), CREDIT, None, False, None),
    Rule("atm.atm", "R", ("atm",), DEBIT, None, False, None),
    Rule("atm.nwd", "R", ("nwd",), DEBIT, None, False, None),
    Rule("atm.cash-withdrawal", "R", ("cash", "wdl"), DEBIT, None, False, None),
    Rule("atm.cash-withdrawal-long", "R", ("cash", "withdrawal"), DEBIT, None, False, None),
    Rule("salary.salary", "M", ("salary",), CREDIT, None, False, None),
    Rule("salary.sal", "M", ("sal",), CREDIT, None, False, None),
    Rule("rent.rent", "N", ("rent",), EITHER, None, False, None),
    Rule("loan.emi", "O", ("emi",), DEBIT, None, False, None),
    Rule("loan.repayment", "O", ("loan", "repay"), DEBIT, None, False, None),
    Rule("loan.instalment", "O", ("loan", "instalment"), DEBIT, None, False, None),
    Rule("utility.electricity", "V", ("electricity",), DEBIT, None, False, None),
    Rule("utility.bill", "V", ("bill", "pay"), DEBIT, None, False, None),
    Rule("utility.broadband", "V", ("broadband",), DEBIT, None, False, None),
    Rule("utility.recharge", "V", ("recharge",), DEBIT, None, False, None),
    Rule("insurance.claim", "I", ("insurance", "claim"), CREDIT, None, False, None),
    Rule("insurance.premium", "J", ("premium",), DEBIT, None, False, None),
    Rule("insurance.insurance", "J", ("insurance",), DEBIT, None, False, None),
    Rule("insurance.lic", "J", ("lic",), DEBIT, None, False, None),
    Rule("mf.redemption", "K", ("redemption",), CREDIT, None, False, None),
    Rule("mf.sip", "L", ("sip",), DEBIT, None, False, None),
    Rule("mf.mutual-fund", "L", ("mutual", "fund"), DEBIT, None, False, None),
    Rule("card.credit-card", "W", ("credit", "card"), DEBIT, None, False, None),
    Rule("card.cc-payment", "W", ("cc", "pmt"), DEBIT, None, False, None),
    Rule("subsidy.subsidy", "G", ("subsidy",), CREDIT, None, False, None),
    Rule("subsidy.dbt", "G", ("dbt",), CREDIT, None, False, None),
    Rule("pension.pension", "H", ("pension",), CREDIT, None, False, None),
    Rule("income.dividend", "X", ("dividend",), CREDIT, None, False, None),
    Rule("deposit.term", "Z", ("term", "deposit"), EITHER, None, False, None),
    Rule("deposit.recurring", "Z", ("recurring", "deposit"), EITHER, None, False, None),
    Rule("deposit.fixed", "Z", ("fixed", "deposit"), EITHER, None, False, None),
    Rule("cheque.in", "U1", ("chq",), CREDIT, None, False, None),
    Rule("cheque.in-long", "U1", ("cheque",), CREDIT, None, False, None),
    Rule("cheque.clearing-in", "U1", ("clg",), CREDIT, None, False, None),
    Rule("cheque.out", "U2", ("chq",), DEBIT, None, False, None),
    Rule("cheque.out-long", "U2", ("cheque",), DEBIT, None, False, None),
    Rule("cheque.clearing-out", "U2", ("clg",), DEBIT, None, False, None),
    Rule("cheque.bare-number", "U1", (), CREDIT, None, True, "bare_cheque_number"),
    Rule("neft.phonepe", "NEFT_IN", ("neft", "phonepe"), CREDIT, PHONEPE, False, None),
    Rule("imps.phonepe", "IMPS_IN", ("imps", "phonepe"), CREDIT, PHONEPE, False, None),
    Rule("upi.in", "T1", ("upi",), CREDIT, None, False, None),
    Rule("upi.out", "T2", ("upi",), DEBIT, None, False, None),
    Rule("neft.in", "NEFT_IN", ("neft",), CREDIT, None, False, None),
    Rule("neft.out", "NEFT_OUT", ("neft",), DEBIT, None, False, None),
    Rule("rtgs.in", "RTGS_IN", ("rtgs",), CREDIT, None, False, None),
    Rule("rtgs.out", "RTGS_OUT", ("rtgs",), DEBIT, None, False, None),
    Rule("imps.in", "IMPS_IN", ("imps",), CREDIT, None, False, None),
    Rule("imps.out", "IMPS_OUT", ("imps",), DEBIT, None, False, None),
]


def default_pack() -> list[Rule]:
    return list(DEFAULT_PACK)


PACK = "priority int, id string, category string, words array<string>, direction string, ledger string, review boolean, predicate string"


def pack_frame(spark, pack: list[Rule] | None = None) -> DataFrame:
    """A pack as a table, in order of priority."""
    rows = [(i, r.id, r.category, list(r.words), r.direction, r.ledger, r.review, r.predicate) for i, r in enumerate(DEFAULT_PACK if pack is None else pack)]
    return spark.createDataFrame(rows, PACK)


def pack_from(table: DataFrame, most: int = 10_000) -> list[Rule]:
    """The checked pack of a table with the columns of PACK; a pack is a constant of the plan, so its size is bounded."""
    rows = table.select(*[c.split()[0] for c in PACK.split(", ")]).orderBy("priority", "id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return checked([Rule(r.id, r.category, tuple(r.words or ()), r.direction or EITHER, r.ledger, bool(r.review), r.predicate) for r in rows])


def admits(constraint: str, actual: str) -> bool:
    return constraint == EITHER or constraint == actual


def checked(pack: list[Rule], taxonomy: list[tuple] = TAXONOMY) -> list[Rule]:
    """The pack with canonical words; rules that match nothing, contradict their category or repeat an id raise."""
    directions = {code: d for code, _, _, d, _ in taxonomy}
    out, seen = [], set()
    for r in pack:
        if not r.words and not r.predicate:
            raise ValueError(f"rule {r.id!r} matches nothing")
        if r.category not in directions:
            raise KeyError(f"rule {r.id!r} has an unknown category {r.category!r}")
        if not admits(directions[r.category], r.direction):
            raise ValueError(f"rule {r.id!r} contradicts the direction of category {r.category}")
        if r.predicate and r.predicate not in PREDICATES:
            raise KeyError(f"unknown structural predicate {r.predicate!r}; known: {sorted(PREDICATES)}")
        if r.id in seen:
            raise ValueError(f"duplicate rule id {r.id!r}")
        seen.add(r.id)
        out.append(Rule(r.id, r.category, tuple(w for w in map(canon_of, r.words) if w), r.direction, r.ledger, r.review, r.predicate))
    return out


def direction_of(signed: Column) -> Column:
    return F.when(signed > 0, CREDIT).when(signed < 0, DEBIT).otherwise(EITHER)


def word_hits(words: Column, vocabulary: list[str]) -> Column:
    """The rule words that a narration's words match: exactly; from five letters on by ratio; from six on also as a prefix.
    A word is compared fuzzily only with the rule words that its length allows."""
    long = [w for w in vocabulary if len(w) >= FUZZY_LENGTH]
    edits = lambda n, m: int((100 - FUZZY) / 100 * (n + m) + 1e-9)
    widest = max([len(w) for w in long], default=0)
    lengths = range(1, 2 * widest + 1)
    near = {m: [w for w in long if abs(len(w) - m) <= edits(len(w), m)] for m in lengths}
    begun = {m: [w for w in long if PREFIX_LENGTH <= len(w) <= m and w not in near.get(m, [])] for m in [*lengths, lengths.stop]}
    if not long:
        return F.array_intersect(texts(*vocabulary), words)
    table = lambda of: F.array(*[texts(*of.get(m, [])) for m in range(lengths.stop + 1)])
    close, longer = table(near), table(begun)
    most = edits(widest, 2 * widest)

    def alike(w: Column) -> Column:
        m = F.length(w)
        some, rest = (F.element_at(t, F.least(m, F.lit(lengths.stop)) + 1) for t in (close, longer))
        close_by = lambda r: F.levenshtein(r, w, most).between(0, F.floor(F.lit((100 - FUZZY) / 100) * (F.length(r) + m) + F.lit(1e-9)))
        hit = F.filter(some, lambda r: ((F.length(r) >= PREFIX_LENGTH) & w.startswith(r)) | (close_by(r) & (ratio(r, w) >= FUZZY)))
        return F.concat(hit, F.filter(rest, lambda r: w.startswith(r)))

    exact = F.array_intersect(texts(*vocabulary), words)
    # the shortest word that is alike to one of five letters has four
    return F.concat(exact, F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= FUZZY_LENGTH - 1), alike)))


def first_match(hits: Column, n: Column, direction: Column, holder: Column, pack: list[Rule]) -> Column:
    """The place in the pack of the first rule that matches a narration with these hits; null if none does. Rules are a chain of
    conditions, so those behind the first match are not looked at."""
    out = None
    for i, r in enumerate(pack):
        cond = F.lit(True) if r.direction == EITHER else direction == r.direction
        for w in r.words:
            cond = cond & F.array_contains(hits, w)
        if r.predicate:
            cond = cond & PREDICATES[r.predicate](n["words"], n["numbers"], holder)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def classify(rows: DataFrame, pack: list[Rule] | None = None, taxonomy: list[tuple] = TAXONOMY, holder: str = "holder") -> DataFrame:
    """Rows (narration, credit, debit and the account's holder, if there is such a column) with category, tally_ledger,
    contra, rule_id and needs_review."""
    rules = checked(pack if pack is not None else default_pack(), taxonomy)
    name = F.col(holder) if holder in rows.columns else F.lit(None).cast("string")
    vocabulary = sorted({w for r in rules for w in r.words})
    fact = lambda values: F.try_element_at(texts(*values), F.col("__i") + 1)
    ledgers = F.map_from_arrays(texts(*[t[0] for t in taxonomy]), texts(*[t[2] for t in taxonomy]))
    out = rows.withColumns({"__n": narration(F.col("narration")), "__h": name_words(name)})
    out = out.withColumn("__w", word_hits(F.col("__n.words"), vocabulary))
    out = out.withColumn("__i", first_match(F.col("__w"), F.col("__n"), direction_of(F.col("credit") - F.col("debit")), F.col("__h"), rules))
    out = out.withColumn("category", F.coalesce(fact([r.category for r in rules]), F.lit(UNCLASSIFIED)))
    shown = F.coalesce(F.nullif(display_name(name), F.lit("")), F.lit(NO_HOLDER))
    own = F.nullif(fact([r.ledger or "" for r in rules]), F.lit(""))
    ledger = F.coalesce(own, F.replace(F.element_at(ledgers, F.col("category")), F.lit("{holder}"), shown))
    contra = F.col("category").isin([t[0] for t in taxonomy if t[4]])
    review = F.col("__i").isNull() | F.col("__i").isin([i for i, r in enumerate(rules) if r.review])
    return out.select(*rows.columns, "category", ledger.alias("tally_ledger"), contra.alias("contra"), fact([r.id for r in rules]).alias("rule_id"), review.alias("needs_review"))


def taxonomy_frame(spark, taxonomy: list[tuple] = TAXONOMY) -> DataFrame:
    """The categories as rows: ord, code, description, ledger, direction, contra."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(taxonomy)], "ord int, code string, description string, ledger string, direction string, contra boolean")


def movements(rows: DataFrame, classified: DataFrame, keys: tuple[str, ...] = ("doc_id", "source_row")) -> DataFrame:
    """Rows and their classifications one to one by place. A row without a classification, or the reverse, is an error."""
    left = rows.withColumn("__row", F.lit(True))
    both = left.join(classified.withColumn("__class", F.lit(True)), list(keys), "full")
    whole = F.col("__row").isNotNull() & F.col("__class").isNotNull()
    checked_ = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("rows and classifications differ in number")).cast("boolean"))
    return both.filter(checked_).drop("__row", "__class")
