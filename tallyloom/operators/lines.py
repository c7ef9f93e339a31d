"""Printed lines to rows: line kinds, fields, transaction rows, printed check figures, page diagnostics.

Everything about a line is a projection of that line. Only the closing limits table needs its page (a window), and row
numbers need the pages before (counts by page, not a window over lines)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, first_or_null, let, money, record, strip
from ..functions.money import D, amount_value, money_tokens, parse_amount
from ..functions.similarity import letter_bits, pieces, resembles
from ..functions.text import canon, canon_of

TRANSACTION, PAGE_TOTAL, HEADER, SEPARATOR, LIMITS, OPENING, FILLER, CARRY = "TRANSACTION", "PAGE_TOTAL", "HEADER_REPEAT", "SEPARATOR", "LIMITS_TABLE", "OPENING", "BLANK_FILLER", "CARRY_FORWARD"

# Fixed values: (kind, phrase, label) of lines that are no transactions; the first that a line contains wins.
TRAPS = [
    (PAGE_TOTAL, "page total credit", "PAGE_TOTAL_CREDIT"), (PAGE_TOTAL, "page total debit", "PAGE_TOTAL_DEBIT"),
    (PAGE_TOTAL, "total credit for the page", "PAGE_TOTAL_CREDIT"), (PAGE_TOTAL, "total debit for the page", "PAGE_TOTAL_DEBIT"),
    (OPENING, "brought forward", "BF_BALANCE"), (OPENING, "bf balance", "BF_BALANCE"), (OPENING, "b f balance", "BF_BALANCE"), (OPENING, "opening balance", "OPENING_BALANCE"),
    (CARRY, "carried forward", "CF_BALANCE"), (CARRY, "carry forward", "CF_BALANCE"), (CARRY, "cf balance", "CF_BALANCE"), (CARRY, "closing balance", "CLOSING_BALANCE"),
    (LIMITS, "draw power", "LIMITS"), (LIMITS, "drawing power", "LIMITS"), (LIMITS, "int rate", "LIMITS"), (LIMITS, "interest rate", "LIMITS"), (LIMITS, "sanction limit", "LIMITS"),
    (SEPARATOR, "order by gl date", "SORT_NOTE"), (SEPARATOR, "order by gl", "SORT_NOTE"), (SEPARATOR, "continued", "CONTINUATION_NOTE"),
    (HEADER, "service outlet", "HEADER"), (HEADER, "peg review date", "HEADER"), (HEADER, "account number", "HEADER"), (HEADER, "statement of account", "HEADER"), (HEADER, "printed on", "HEADER"),
]
# Names of columns; a line with three of them and no figure is a column header.
COLUMN_NAMES = ["date", "value date", "particulars", "description", "narration", "instrument", "chq no", "cheque", "ref no", "withdrawal", "deposit", "debit", "credit", "balance", "branch", "account no", "sl no"]
COLUMNS_NEEDED, FUZZY, FUZZY_LENGTH, LIMITS_FROM = 3, 88, 8, 0.6
# Patterns of dates, instrument numbers, printed page numbers and trailing figures.
DATE = rf"\b({D}{{2}})\s*[-/+.\s]\s*({D}{{2}})\s*[-/+.\s]\s*({D}{{4}})\b"
DATE_GLYPHS, DATE_DIGITS = "OoQlIiSsBZzGbgq", "000111558226699"
INSTRUMENT = r"\b\d{5,10}\b"
PRINTED_PAGE = r"(?i)\bPage\s*(?:no\.?)?\s*(\d{1,3})\b"
TRAILING = rf"(?i)({D}[{D[1:-1]}.,]{{2,}})\s*(DR|CR)?\.?\s*$"


@dataclass(frozen=True)
class Profile:
    """A bank's layout: traps of its own, tried before the shared ones, and where its header names the account."""

    key: str
    overdraft: bool = False
    ruled: bool = False
    traps: list[tuple[str, str, str]] = field(default_factory=list)
    account_no: str | None = None
    holder: str | None = None


# The known layouts.
PROFILES = [
    Profile(
        "gramin_cc", overdraft=True,
        traps=[
            (HEADER, "tripura gramin bank", "HEADER"), (HEADER, "customer account ledger report", "HEADER"), (HEADER, "gl sub head code", "HEADER"), (HEADER, "service outlet", "HEADER"),
            (HEADER, "peg review date", "HEADER"), (HEADER, "account no", "HEADER"), (HEADER, "entry user id", "COLUMN_HEADER"), (HEADER, "verified user id", "COLUMN_HEADER"),
            (HEADER, "transaction debit amount", "COLUMN_HEADER"), (HEADER, "transaction credit amount", "COLUMN_HEADER"), (SEPARATOR, "order by gl date", "SORT_NOTE"),
        ],
        account_no=r"Account\s*No\s*[:;]\s*(\d{10,20})", holder=r"Account\s*No\s*[:;]\s*\d{10,20}\s+(?:M\W*S|IKR|MR)?\s*([A-Z][A-Z\s&.]{4,40})",
    ),
    Profile(
        "sbi_current", ruled=True,
        traps=[
            (HEADER, "state bank of india", "HEADER"), (HEADER, "account statement", "HEADER"), (HEADER, "txn date", "COLUMN_HEADER"), (HEADER, "value date", "COLUMN_HEADER"),
            (HEADER, "cheque no", "COLUMN_HEADER"), (HEADER, "page no", "HEADER"), (OPENING, "brought forward", "BF_BALANCE"),
        ],
        account_no=r"Account\s*(?:Number|No)\s*[:;]?\s*(\d{10,20})", holder=r"(?:M/S|MR|MRS|MS)[.\s]+([A-Z][A-Z\s&.]{4,40})",
    ),
]


def register(layout: Profile) -> None:
    """Adds a layout to those that ``profile``, detection and headers know; a known key is an error."""
    if layout.key in {p.key for p in PROFILES}:
        raise ValueError(f"profile {layout.key!r} is known already")
    PROFILES.append(layout)


def profile(key: str | None) -> Profile:
    """The layout of this key; none: shared traps only. Unknown keys raise KeyError."""
    known = {p.key: p for p in PROFILES} | {None: Profile("none")}
    if key not in known:
        raise KeyError(f"unknown profile {key!r}; known: {sorted(k for k in known if k)}")
    return known[key]


def is_column_header(text: Column, c: Column) -> Column:
    """No figure, and at least three column names."""
    names = F.array(*[F.lit(canon_of(n)) for n in COLUMN_NAMES])
    return ~text.rlike(r"\d[\d,]*\.\d{2}") & (F.size(F.filter(names, lambda n: c.contains(n))) >= COLUMNS_NEEDED)


def _parts(phrase: str) -> Column:
    """The parts of a phrase that is long enough to be compared fuzzily, with their places."""
    parts, at = [], 0
    for x in pieces(phrase, FUZZY) if len(phrase) >= FUZZY_LENGTH else []:
        parts.append(record(text=F.lit(x), at=F.lit(at)))
        at += len(x)
    return F.array(*parts) if parts else F.array().cast("array<struct<text:string,at:int>>")


def _any_of(words: set[str]) -> str:
    """A pattern of these words (a to z only), by first letter."""
    by: dict[str, set[str]] = {}
    for w in words:
        by.setdefault(w[0], set()).add(w[1:])
    return "|".join(f"{k}(?:{'|'.join(sorted(v))})" for k, v in sorted(by.items()))


def classify_line(text: Column, layout: Profile | None = None) -> Column:
    """kind, label, reason of a line. Only lines that hold a part of a phrase unchanged are compared fuzzily with it, and
    only lines that hold a part of any, or are shorter than one, are compared at all."""
    traps = dict.fromkeys((k, canon_of(p), label) for k, p, label in [*(layout.traps if layout else []), *TRAPS])
    row = lambda k, p, label: record(kind=F.lit(k), label=F.lit(label), phrase=F.lit(p), parts=_parts(p), bits=letter_bits(p))
    phrases = F.array(*[row(*t) for t in traps])
    sought = {p for _, p, _ in traps}
    some_part = _any_of({x for p in sought for x in (pieces(p, FUZZY) if len(p) >= FUZZY_LENGTH else [p])})

    def by_text(t: Column, c: Column) -> Column:
        out = lambda kind, label, why: record(kind=F.lit(kind), label=F.lit(label), reason=F.lit(why))
        hit = lambda found, why: F.when(F.size(found) > 0, record(kind=found[0]["kind"], label=found[0]["label"], reason=F.lit(why)))
        blank = F.regexp_replace(t, r"(?U)[.\-_=*~+·:\s]", "") == ""
        near = lambda p: (F.size(p["parts"]) > 0) & resembles(p["phrase"], p["parts"], p["bits"], c, FUZZY)
        header = F.when(is_column_header(t, c), out(HEADER, "COLUMN_HEADER", "header tokens, no money"))
        case = F.when(t == "", out(FILLER, "EMPTY", "blank")).when((F.length(c) < 3) & blank, out(SEPARATOR, "RULE", "separator glyphs only")).when(c == "", out(FILLER, "NO_TEXT", "no alphabetic content"))
        exact = let(F.filter(phrases, lambda p: c.contains(p["phrase"])), lambda f: hit(f, "canonical match"))
        fuzzy = let(F.filter(phrases, near), lambda f: hit(f, "fuzzy match"))
        near_any = c.rlike(some_part) | (F.length(c) < max(map(len, sought)))
        return let(near_any, lambda some: F.coalesce(case, F.when(some, exact), header, F.when(some, fuzzy), out(TRANSACTION, "TXN", "")))

    return let(strip(F.coalesce(text, F.lit(""))), lambda t: let(canon(t), lambda c: by_text(t, c)))


def anchor(text: Column, kind: Column) -> Column:
    """value and marker of a check figure at the end of the line; null for other kinds."""
    t = strip(text)
    figure = F.regexp_extract(t, TRAILING, 1)
    marker = F.upper(F.regexp_extract(t, TRAILING, 2))
    read = let(parse_amount(figure), lambda p: record(value=p["value"], marker=F.coalesce(F.nullif(marker, F.lit("")), p["sign_hint"]), raw=t))
    return F.when(kind.isin(PAGE_TOTAL, OPENING, CARRY), read)


def to_date(day: Column, month: Column, year: Column) -> Column:
    """A date of 1990 to 2099 from digits as they were read; else null."""
    d, m, y = (F.translate(x, DATE_GLYPHS, DATE_DIGITS) for x in (day, month, year))
    value = F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    return F.when(F.year(value).between(1990, 2099), value)


def _amounts(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, lambda x: amount_value(x["token"])), lambda v: v.isNotNull())


def _marker(tokens: Column) -> Column:
    marker = F.upper(F.regexp_extract(F.element_at(tokens, -1)["tail"], r"(?i)^\s*(DR|CR)\b", 1))
    return F.when(F.size(tokens) > 0, F.nullif(marker, F.lit("")))


def extract_fields(text: Column) -> Column:
    """dates, amounts, raw_money, instrument, narration and balance_marker (Dr or Cr behind the last figure)."""
    t = F.coalesce(text, F.lit(""))
    found = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(DATE), F.lit(i)).alias(n) for i, n in ((1, "d"), (2, "m"), (3, "y"))])
    dates = F.filter(F.transform(found, lambda x: to_date(x["d"], x["m"], x["y"])), lambda d: d.isNotNull())

    def fields(tokens: Column) -> Column:
        head = F.when(F.size(tokens) > 0, tokens[0]["head"]).otherwise(t)

        def rest(r: Column) -> Column:
            instrument = F.regexp_extract(r, INSTRUMENT, 0)
            left = F.when(instrument != "", F.regexp_replace(r, rf"(?s)^(.*?){INSTRUMENT}", "$1 ")).otherwise(r)
            narration = F.btrim(F.regexp_replace(left, r"(?U)\s{2,}", " "), F.lit(" :;.-"))
            return record(dates=dates, amounts=_amounts(tokens), raw_money=F.transform(tokens, lambda x: x["token"]), instrument=instrument, narration=narration, balance_marker=_marker(tokens))

        return let(F.regexp_replace(head, DATE, " "), rest)

    return let(money_tokens(t), fields)


def build_rows(lines: DataFrame, overdraft: Column, text: str = "text") -> DataFrame:
    """A row for each line with at least two figures, the last two being amount and balance. A printed marker gives the
    balance's sign, else the account's kind does."""
    f = lines.withColumn("__f", extract_fields(F.col(text))).filter(F.size("__f.amounts") >= 2)
    balance = F.element_at("__f.amounts", -1)
    negative = F.coalesce(F.col("__f.balance_marker") == "DR", overdraft)
    return f.select(
        *lines.columns, first_or_null(F.col("__f.dates")).alias("date"), F.try_element_at("__f.dates", F.lit(2)).alias("value_date"), F.col("__f.instrument").alias("instrument_no"), F.col("__f.narration").alias("narration"),
        money(F.when(negative, -balance).otherwise(balance)).alias("balance"), money(F.element_at("__f.amounts", -2)).alias("printed_amount"), F.col("__f.balance_marker").alias("printed_marker"),
        F.element_at("__f.raw_money", -2).alias("raw_amount_text"), F.element_at("__f.raw_money", -1).alias("raw_balance_text"),
    )


def row_figures(text: Column, layout: Profile | None = None) -> Column:
    """money_tokens of a line and, if it makes a row (``build_rows``) and is a transaction, that row's balance and
    printed_amount; else null. Lines without two figures need no kind."""
    overdraft = F.lit(bool(layout and layout.overdraft))

    def row(amounts: Column, tokens: Column) -> Column:
        negative = F.coalesce(_marker(tokens) == "DR", overdraft)
        balance, amount = F.try_element_at(amounts, F.lit(-1)), F.try_element_at(amounts, F.lit(-2))
        is_row = F.when(F.size(amounts) >= 2, classify_line(text, layout)["kind"] == TRANSACTION)
        figures = F.when(is_row, record(balance=money(F.when(negative, -balance).otherwise(balance)), printed_amount=money(amount)))
        return let(figures, lambda f: record(money_tokens=F.when(text.isNotNull(), F.size(tokens)), balance=f["balance"], printed_amount=f["printed_amount"]))

    return let(money_tokens(F.coalesce(text, F.lit(""))), lambda tokens: let(_amounts(tokens), lambda amounts: row(amounts, tokens)))


def number_lines(lines: DataFrame) -> DataFrame:
    """source_row: the line's place in its document, from 0. Pages start where the lines of the pages before end."""
    pages = lines.groupBy("doc_id", "page_no").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select("doc_id", "page_no", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.col("__n").alias("page_lines"))
    on_page = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("line_no")) - 1
    out = lines.withColumn("line_offset", on_page).join(starts, ["doc_id", "page_no"])
    return out.withColumn("source_row", (F.col("__start") + F.col("line_offset")).cast("int")).drop("__start")


def read_lines(lines: DataFrame, layout: Profile | None = None) -> DataFrame:
    """Lines (doc_id, page_no, line_no, text, confidence) with source_row, kind, label, anchor and printed_page; past_limits
    is whether the page's closing limits table, in its last two fifths, came before."""
    seen = number_lines(lines).withColumn("__c", classify_line(F.col("text"), layout))
    seen = seen.select("*", F.col("__c.kind").alias("kind"), F.col("__c.label").alias("label"), F.col("__c.reason").alias("reason")).drop("__c")
    low = F.when((F.col("kind") == LIMITS) & (F.col("line_offset") > F.col("page_lines") * LIMITS_FROM), F.col("line_offset"))
    cut = F.min(low).over(Window.partitionBy("doc_id", "page_no"))
    page = F.nullif(F.regexp_extract("text", PRINTED_PAGE, 1), F.lit("")).cast("int")
    return seen.withColumn("past_limits", F.coalesce(F.col("line_offset") > cut, F.lit(False))).withColumn("anchor", anchor(F.col("text"), F.col("kind"))).withColumn("printed_page", page)


def transactions(read: DataFrame, layout: Profile | None = None) -> DataFrame:
    """The rows of classified lines."""
    rows = build_rows(read.filter((F.col("kind") == TRANSACTION) & ~F.col("past_limits")).select("doc_id", "page_no", "source_row", "text", F.col("confidence").alias("ocr_confidence")), F.lit(bool(layout and layout.overdraft)))
    return rows.drop("text")


def anchors(read: DataFrame) -> DataFrame:
    """Check figures, from every line of every page."""
    return read.filter("anchor IS NOT NULL").select("doc_id", F.col("label").alias("kind"), "page_no", "source_row", "anchor.value", "anchor.marker", "anchor.raw")


def page_diagnostics(read: DataFrame) -> DataFrame:
    """Per page: printed_pages, lines, rows, unparsed_lines, mean_confidence."""
    live = (F.col("kind") == TRANSACTION) & ~F.col("past_limits")
    settled = live & (F.size(extract_fields(F.col("text"))["amounts"]) >= 2)
    marked = read.withColumn("__live", live).withColumn("__row", settled)
    return marked.groupBy("doc_id", "page_no").agg(
        F.array_sort(F.collect_set("printed_page")).alias("printed_pages"), F.count("*").alias("lines"), F.count_if("__row").alias("rows"), F.count_if(F.col("__live") & ~F.col("__row")).alias("unparsed_lines"), F.round(F.avg("confidence"), 1).alias("mean_confidence")
    )


def page_class(pages: DataFrame) -> DataFrame:
    """page_class of pages (doc_id, page_no, text): DIGITAL from 50 characters of text on."""
    return pages.withColumn("page_class", F.when(F.length(strip(F.coalesce("text", F.lit("")))) >= 50, "DIGITAL").otherwise("SCANNED"))


def document_class(pages: DataFrame) -> DataFrame:
    """Per document: the dominant class, whether it is mixed, and the median characters of a page."""
    agg = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("page_class") == "SCANNED").alias("scanned"), F.median(F.length(strip(F.coalesce("text", F.lit(""))))).alias("median_chars"))
    return agg.withColumn("dominant", F.when(F.col("scanned") * 2 >= F.col("pages"), "SCANNED").otherwise("DIGITAL")).withColumn("mixed", (F.col("scanned") > 0) & (F.col("scanned") < F.col("pages")))


def page_runs(pages: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Runs of pages of one class within a range: doc_id, page_class, first_page, last_page."""
    inside = pages.filter(F.col("page_no").between(first or 1, last or 2**31 - 1))
    w = Window.partitionBy("doc_id").orderBy("page_no")
    changed = F.coalesce((F.lag("page_class").over(w) != F.col("page_class")).cast("int"), F.lit(1))
    runs = inside.withColumn("__new", changed).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy("doc_id", "__run").agg(F.first("page_class").alias("page_class"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")).drop("__run")


def detect_profile(first_pages: DataFrame) -> DataFrame:
    """profile_key of each document by the phrases that its first page's text contains; ties go to the first layout."""
    c = canon(F.col("text"))
    counts = F.array(*[record(score=sum((c.contains(canon_of(p)).cast("int") for _, p, _ in x.traps), F.lit(0)), order=F.lit(-i), key=F.lit(x.key)) for i, x in enumerate(PROFILES)])
    best = let(F.array_max(counts), lambda b: F.when(b["score"] > 0, b["key"]))
    return first_pages.withColumn("profile_key", best)


def _named(pattern: str | None, text: Column) -> Column:
    if not pattern:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_replace(strip(F.regexp_extract(text, "(?i)" + pattern, 1)), r"(?U)\s{2,}", " "), F.lit(""))


def header(first_pages: DataFrame) -> DataFrame:
    """account_no and holder of each document, by the patterns of its layout (profile_key, detected where null)."""
    seen = detect_profile(first_pages.withColumnRenamed("profile_key", "__given")) if "profile_key" in first_pages.columns else detect_profile(first_pages)
    if "__given" in seen.columns:
        known = F.col("__given").isin([p.key for p in PROFILES])
        seen = seen.withColumn("profile_key", F.when(known, F.col("__given")).otherwise(F.col("profile_key"))).drop("__given")
    pick = lambda attr: F.coalesce(*[F.when(F.col("profile_key") == p.key, _named(getattr(p, attr), F.col("text"))) for p in PROFILES])
    return seen.withColumn("account_no", pick("account_no")).withColumn("holder", pick("holder"))


def first_page_text(lines: DataFrame) -> DataFrame:
    """The text of page one of each document, line by line."""
    one = lines.filter("page_no = 1").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    return one.select("doc_id", F.array_join("x.text", "\n").alias("text"))


def header_total(raw: Column, overdraft: Column) -> Column:
    """A typed total, signed by its own marker or else by the account's kind."""
    p = parse_amount(raw)
    return let(p, lambda x: F.when(F.coalesce(x["sign_hint"], F.when(overdraft, "DR")) == "DR", -F.abs(x["value"])).otherwise(F.abs(x["value"])).cast(MONEY))


def opening_balance(accounts: DataFrame, found: DataFrame, overdraft: Column | None = None) -> DataFrame:
    """opening of each account: what was typed, else the first brought-forward or opening figure, else 0. A figure's own
    marker gives its sign, else the account's kind does."""
    f = found.filter(F.col("kind").isin("BF_BALANCE", "OPENING_BALANCE") & F.col("value").isNotNull()).groupBy("doc_id").agg(F.min_by(F.struct("value", "marker"), F.struct("page_no", "source_row")).alias("__a"))
    minus = F.coalesce(F.col("__a.marker") == "DR", overdraft if overdraft is not None else F.lit(False))
    printed = F.when(minus, -F.abs("__a.value")).otherwise(F.abs("__a.value"))
    return accounts.join(f, "doc_id", "left").withColumn("opening", money(F.coalesce(money("opening"), printed, F.lit(0)))).drop("__a")
