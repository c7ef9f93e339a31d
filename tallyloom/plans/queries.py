"""The registered queries of the ledger engine: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import similarity as S
from ..functions import text as T
from ..functions.columns import MONEY, money, texts
from ..operators import audit, chain, jobs, layout, lines, quality, repair, rules, summary
from ..sources import scans, sinks
from ..tables import written
from . import ledger as L
from . import statement

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LAYOUT = lines.profile("sbi_current")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Chain rows with a balance missing in every seven."""
    rows = L.ledger(spark, sf)
    return rows.withColumn("balance", F.when(F.col("source_row") % 7 != 3, F.col("balance")))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return rules.classify(L.ledger(spark, sf))


def _settled(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    rows = L.ledger(spark, sf)
    return repair.settle(L.faulty(rows, kind), L.accounts(rows))


def _repaired(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return _settled(spark, sf, kind).select("doc_id", "source_row", "printed_amount", "balance", "credit", "debit", "row_state", "diagnosis_kind")


def _read(spark: SparkSession, sf: str) -> DataFrame:
    return lines.read_lines(L.statement_lines(L.ledger(spark, sf)))


def _read_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same, classified once for all that reads it."""
    return written(_read(spark, sf), "lines")


# --- balance chain


@query
def chain_deltas(spark, sf):
    rows = chain.strict_deltas(chain.deltas(_gappy(spark, sf)))
    return rows.select("doc_id", "source_row", "delta", "strict_delta", chain.is_consistent(F.col("strict_delta"), F.col("amount")).alias("consistent"))


@query
def chain_directions(spark, sf):
    return chain.apply_directions(_gappy(spark, sf)).select("doc_id", "source_row", "credit", "debit")


@query
def chain_recompute(spark, sf):
    return chain.recompute_forward(L.ledger(spark, sf).withColumn("balance", F.lit(None).cast(MONEY))).select("doc_id", "source_row", "balance", chain.signed_amount().alias("signed"))


@query
def chain_report(spark, sf):
    rows = L.ledger(spark, sf)
    return chain.report(rows.withColumn("row_state", F.when(F.col("source_row") % 7 == 3, "REPAIRED").when(F.col("source_row") % 11 == 5, "UNRESOLVED").otherwise("CLEAN")), L.accounts(rows))


@query
def chain_totals(spark, sf):
    return chain.totals(L.ledger(spark, sf))


@query
def chain_row_agreement(spark, sf):
    return chain.row_agreement(L.faulty(L.ledger(spark, sf), "amount"))


# --- repair


@query
def repair_amount(spark, sf):
    return _repaired(spark, sf, "amount")


@query
def repair_balance(spark, sf):
    return _repaired(spark, sf, "balance")


@query
def repair_missing_balance(spark, sf):
    return _repaired(spark, sf, "no_balance")


@query
def repair_missing_amount(spark, sf):
    return _repaired(spark, sf, "no_amount")


@query
def repair_containment(spark, sf):
    return _repaired(spark, sf, "both")


@query
def repair_dropped_row(spark, sf):
    return _repaired(spark, sf, "row")


@query
def repair_diagnoses(spark, sf):
    return repair.diagnoses(_settled(spark, sf, "amount"))


@query
def repair_notes(spark, sf):
    return repair.notes(_settled(spark, sf, "both")).select("doc_id", F.size("notes").cast("long").alias("n"), F.array_join("notes", "|").alias("notes"))


@query
def repair_report(spark, sf):
    rows = L.ledger(spark, sf)
    return chain.report(repair.settle(L.faulty(rows, "balance"), L.accounts(rows)), L.accounts(rows))


@query
def plausible_readings(spark, sf):
    r = L.ledger(spark, sf).select("k", "amount")
    seen = money(F.when(F.col("k") % 5 == 0, F.col("amount") * 10).when(F.col("k") % 5 == 1, F.col("amount") + 1).when(F.col("k") % 5 == 2, F.col("amount") + F.lit("7654.32").cast(MONEY)).when(F.col("k") % 5 == 3, F.col("amount")))
    return r.select("k", S.plausible(seen, F.col("amount")).alias("plausible"))


# --- money


@query
def parse_amounts(spark, sf):
    r = L.ledger(spark, sf).select("k", "amount")
    t = M.format_indian(F.col("amount"))
    k = F.col("k") % 8
    raw = F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("CR"))).when(k == 2, F.concat(F.lit("Rs. "), t, F.lit(" Dr."))).when(k == 3, F.translate(t, "015", "OIS")).when(k == 4, F.concat(F.lit("-"), t)).when(k == 5, F.translate(t, ".", ",")).when(k == 6, F.concat(t, F.lit("De"))).otherwise(F.lit("----"))
    p = r.select("k", M.parse_amount(raw).alias("p"))
    return p.select("k", "p.value", "p.sign_hint", F.size("p.repairs").cast("long").alias("repairs"), "p.grouping_ok", "p.has_paise", "p.note", M.suspect(F.col("p")).alias("suspect"))


@query
def format_amounts(spark, sf):
    r = L.ledger(spark, sf).select("k", "balance")
    return r.select("k", M.format_indian(F.col("balance")).alias("indian"), M.format_drcr(F.col("balance")).alias("drcr"), M.format_indian(F.when(F.col("k") % 4 > 0, F.col("balance")).otherwise(F.lit(0)), True).alias("blank"), M.digit_string(F.col("balance")).alias("digits"))


@query
def signed_amounts(spark, sf):
    r = L.ledger(spark, sf).select("k", "amount")
    marker = F.when(F.col("k") % 3 == 0, "Dr").when(F.col("k") % 3 == 1, "CR")
    return r.select("k", M.signed_from_drcr(F.col("amount"), marker).alias("signed"), lines.header_total(F.concat(M.format_indian(F.col("amount")), F.coalesce(marker, F.lit(""))), F.col("k") % 2 == 0).alias("header_total"))


@query
def money_tokens(spark, sf):
    t = L.statement_lines(L.ledger(spark, sf))
    return t.select("doc_id", "page_no", "line_no", M.money_tokens(F.col("text")).alias("t")).select("doc_id", "page_no", "line_no", F.size("t").cast("long").alias("n"), F.array_join(F.transform("t", lambda x: x["token"]), "|").alias("tokens"))


@query
def round_half_even(spark, sf):
    v = L.read(spark, sf, "lineitem").select(F.sum(M.to_paise(money("l_extendedprice") * F.lit("0.1").cast("decimal(3,1)"))).alias("tenths"), F.count("*").alias("n"))
    return v.select(money("tenths").alias("tenths"), "n")


# --- text


@query
def canon_text(spark, sf):
    d = L.read(spark, sf, "documents")
    return d.select("doc_id", T.canon(F.col("text")).alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query
def narration_tokens(spark, sf):
    r = L.ledger(spark, sf).select("k", T.narration(F.col("narration")).alias("n"))
    return r.select("k", *[F.array_join(f"n.{c}", " ").alias(c) for c in ("words", "numbers", "references")])


@query
def holder_names(spark, sf):
    r = L.accounts(L.ledger(spark, sf))
    return r.select("doc_id", T.display_name(F.col("holder")).alias("shown"), F.array_join(T.name_words(F.col("holder")), " ").alias("words"))


@query
def word_similarity(spark, sf):
    p = L.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lower(F.col("p_name")).alias("name"))
    return p.select("k", F.round(S.ratio(F.lit("interest"), F.col("name")), 4).alias("ratio"), S.common(F.lit("electricity"), F.col("name")).cast("long").alias("common"))


# --- lines


@query
def line_kinds(spark, sf):
    return _read(spark, sf).select("doc_id", "page_no", "line_no", "kind", "label", "source_row")


@query
def damaged_line_kinds(spark, sf):
    t = L.statement_lines(L.ledger(spark, sf))
    return t.withColumn("c", lines.classify_line(F.translate("text", "goOl", "q001"))).select("doc_id", "page_no", "line_no", "c.kind", "c.reason")


@query
def extract_fields(spark, sf):
    t = L.statement_lines(L.ledger(spark, sf))
    f = t.select("doc_id", "page_no", "line_no", lines.extract_fields(F.col("text")).alias("f"))
    return f.select("doc_id", "page_no", "line_no", F.array_join(F.transform("f.dates", lambda d: d.cast("string")), "|").alias("dates"), F.array_join(F.transform("f.amounts", lambda v: v.cast("string")), "|").alias("amounts"), "f.instrument", "f.narration", "f.balance_marker")


@query
def build_rows(spark, sf):
    return lines.transactions(_read(spark, sf)).select("doc_id", "page_no", "source_row", "date", "instrument_no", "narration", "printed_amount", "balance", "raw_amount_text", "raw_balance_text", "ocr_confidence")


@query
def line_anchors(spark, sf):
    return lines.anchors(_read(spark, sf)).select("doc_id", "page_no", "kind", "value", "marker")


@query
def page_diagnostics(spark, sf):
    d = lines.page_diagnostics(_read(spark, sf))
    return d.withColumn("printed_pages", F.array_join("printed_pages", "|"))


@query
def limits_cut(spark, sf):
    """A limits table in the last fifth of a page ends it; one in its upper part is only dropped."""
    t = L.statement_lines(L.ledger(spark, sf))
    text = F.when(F.col("line_no") == F.when(F.col("doc_id") % 2 == 0, 40).otherwise(2), "Limits : 5,00,000.00 Draw Power : 4,00,000.00").otherwise(F.col("text"))
    extra = t.filter("line_no = 40").withColumn("line_no", F.lit(44)).withColumn("text", F.lit("01/01/2020  LATE ROW  1.00  2.00 Cr"))
    read = lines.read_lines(t.withColumn("text", text).unionByName(extra))
    return lines.transactions(read).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_rows"), F.count_if(F.col("narration") == "LATE ROW").alias("late"))


@query
def page_classes(spark, sf):
    d = L.read(spark, sf, "documents").select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("page_no"), "text")
    return lines.document_class(lines.page_class(d))


@query
def page_runs(spark, sf):
    d = L.page_images(spark, sf).select("doc_id", "page_no", "page_class")
    return lines.page_runs(d, 1, 6)


@query
def header_fields(spark, sf):
    a = L.accounts(L.ledger(spark, sf))
    number = F.lpad(F.col("doc_id").cast("string"), 11, "3")
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Tripura Gramin Bank\nCustomer Account Ledger Report\nAccount No : "), number, F.lit("  M/S "), F.substring("holder", 5, 40)))
    own = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("STATE BANK OF INDIA\nAccount Statement\nAccount Number : "), number, F.lit("\n"), F.col("holder"))).otherwise(own)
    first = a.select("doc_id", F.coalesce(own, F.lit("COOPERATIVE SOCIETY")).alias("text"))
    return lines.header(first).select("doc_id", "profile_key", "account_no", "holder")


@query
def first_page(spark, sf):
    t = lines.first_page_text(L.statement_lines(L.ledger(spark, sf)))
    return t.select("doc_id", F.length("text").cast("long").alias("n"), F.substring_index("text", "\n", 2).alias("head"))


@query
def opening_figures(spark, sf):
    """What was typed for every second account; else the figure that its first page brings forward."""
    rows = L.ledger(spark, sf)
    brought = F.concat(F.lit("Brought Forward "), L.printed(money(F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id")).otherwise(F.col("doc_id")) + F.lit("0.25").cast(MONEY))))
    t = L.statement_lines(rows)
    first = t.filter("page_no = 1 AND line_no = 1").withColumn("line_no", F.lit(3)).withColumn("text", brought)
    found = lines.anchors(lines.read_lines(t.unionByName(first)))
    typed = L.accounts(rows).withColumn("opening", F.when(F.col("doc_id") % 2 == 0, F.lit("12.50").cast(MONEY)))
    return lines.opening_balance(typed, found).select("doc_id", "opening")


# --- rules and summaries


@query
def rule_first_match(spark, sf):
    return _classified(spark, sf).select("k", "category", "tally_ledger", "contra", "rule_id", "needs_review")


@query
def rule_counts(spark, sf):
    return _classified(spark, sf).groupBy("rule_id").agg(F.count("*").alias("n"))


@query
def rule_corpus(spark, sf):
    """A narration of each rule's words, as a credit or a debit: which rule is the first to match it."""
    pack = rules.default_pack()
    words = texts(*[" ".join((*r.words, "wobble")).upper() for r in pack])
    rows = L.ledger(spark, sf).withColumn("narration", F.element_at(words, (F.col("k") % len(pack) + 1).cast("int")))
    return rules.classify(rows).select("k", "rule_id")


@query
def category_summary(spark, sf):
    return summary.category_totals(_classified(spark, sf))


@query
def statement_summary(spark, sf):
    s = summary.summary(_classified(spark, sf))
    return s.withColumn("ledgers", F.array_join("ledgers", "|"))


@query
def category_tie(spark, sf):
    """Every third account's summary lacks its first row, so it does not tie."""
    rows = L.ledger(spark, sf)
    some = rules.classify(rows.filter("doc_id % 3 <> 0 OR source_row > 0"))
    return summary.tie(summary.summary(some), chain.report(rows.withColumn("row_state", F.lit("CLEAN")), L.accounts(rows)))


@query
def summary_total_line(spark, sf):
    r = summary.render(_classified(spark, sf))
    return r.select("doc_id", F.size(F.split("report", "\n")).cast("long").alias("n_lines"), F.rtrim(F.element_at(F.split("report", "\n"), -1)).alias("total"))


@query
def lines_to_summary(spark, sf):
    """Printed lines to category totals: read, settle, classify, total."""
    rows = written(L.ledger(spark, sf), "ledger")
    accounts = L.accounts(rows)
    settled = repair.settle(lines.transactions(lines.read_lines(L.statement_lines(rows))), accounts)
    named = written(settled.join(accounts.select("doc_id", "holder"), "doc_id"), "settled")
    return summary.category_totals(rules.classify(named)).filter("n > 0").select("doc_id", "code", "n", "credit", "debit")


# --- audit


@query
def audit_evidence(spark, sf):
    read = _read_once(spark, sf)
    e = audit.evidence(lines.transactions(read), lines.anchors(read), lines.page_diagnostics(read))
    return e.withColumn("printed_pages", F.array_join("printed_pages", "|")).withColumn("mean_confidence", F.round("mean_confidence", 4)).drop("bf_balances")


@query
def page_totals(spark, sf):
    """Every second page prints totals that are off by one."""
    found = lines.anchors(_read(spark, sf))
    return audit.page_totals(L.ledger(spark, sf), found.withColumn("value", money(F.col("value") + F.col("page_no") % 2)))


@query
def against_expected(spark, sf):
    rows = L.ledger(spark, sf)
    want = rows.groupBy("doc_id").agg(money(F.sum("credit") + F.max("doc_id") % 2).alias("want")).withColumn("label", F.lit("total_credit"))
    return audit.against_expected(chain.report(rows.withColumn("row_state", F.lit("CLEAN")), L.accounts(rows)), want)


@query
def engine_bake_off(spark, sf):
    t = L.statement_lines(L.ledger(spark, sf))
    damaged = F.when(F.col("line_no") % 5 == 0, F.replace("text", F.lit("."), F.lit(" "))).otherwise(F.col("text"))
    engines = F.array(F.struct(F.lit("exact").alias("engine"), F.col("text")), F.struct(F.lit("damaged").alias("engine"), damaged.alias("text")))
    return audit.bake_off(t.select("doc_id", "page_no", "line_no", F.inline(engines)))


# --- layout


@query
def line_clusters(spark, sf):
    return layout.group_into_rows(L.words(spark, sf)).select("doc_id", "line_no", "text", "top", "bottom", "left", "right", F.round("confidence", 4).alias("confidence"))


@query
def row_bands(spark, sf):
    return layout.bands(L.band_rules(spark, sf))


@query
def band_lines(spark, sf):
    return layout.rows_to_lines(L.words(spark, sf), layout.bands(L.band_rules(spark, sf))).select("doc_id", "line_no", "text", "top", "bottom", "left", "right")


@query
def cell_texts(spark, sf):
    return layout.assign_cells(L.words(spark, sf), layout.bands(L.band_rules(spark, sf)))


@query
def column_roles(spark, sf):
    r = layout.column_roles(layout.assign_cells(L.words(spark, sf), layout.bands(L.band_rules(spark, sf))))
    return r.select("doc_id", "date", F.array_join(F.col("money").cast("array<string>"), "|").alias("money"), "description", "reference", "usable")


@query
def numeric_bands(spark, sf):
    found = layout.group_into_rows(L.words(spark, sf))
    pages = found.select("doc_id", "page_no", F.lit(600).alias("page_width")).distinct()
    return layout.numeric_band(found, pages)


@query
def overlaid_lines(spark, sf):
    found = layout.group_into_rows(L.words(spark, sf))
    digits = found.filter("line_no % 2 = 0").withColumn("text", F.lit("9,99,999.99")).withColumn("confidence", F.lit(99.5))
    return layout.overlay(found.drop("word_confidences"), digits).select("doc_id", "line_no", "text", "confidence")


@query
def rule_peaks(spark, sf):
    hits = L.band_rules(spark, sf).select("doc_id", "page_no", "axis", F.explode(F.sequence(F.col("pos"), F.col("pos") + 2)).alias("pos"))
    return layout.peaks(hits)


@query
def row_pitches(spark, sf):
    return layout.row_pitch(L.words(spark, sf))


# --- capture quality


@query
def capture_findings(spark, sf):
    p = quality.inspect(L.page_images(spark, sf))
    return p.select("doc_id", "page_no", "dpi_x", "dpi_y", "rank", F.array_join(F.transform("findings", lambda f: f["code"]), "|").alias("codes"))


@query
def document_verdicts(spark, sf):
    return quality.verdicts(quality.inspect(L.page_images(spark, sf)))


@query
def findings_by_code(spark, sf):
    f = quality.findings_by_code(quality.inspect(L.page_images(spark, sf)))
    return f.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), "|"))


@query
def measured_findings(spark, sf):
    p = quality.inspect(L.page_images(spark, sf)).withColumn("skew", (F.col("doc_id") % 7 - 3) / 1.5).withColumn("contrast", (F.col("page_no") % 4) / 5.0)
    return quality.measured(p).select("doc_id", "page_no", "rank", F.size("findings").cast("long").alias("n"))


@query
def sampled_pages(spark, sf):
    return quality.sample_pages(L.page_images(spark, sf))


@query
def largest_images(spark, sf):
    i = L.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").cast("int").alias("q"))
    return quality.largest_image(i.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("q") * 100000 + F.col("l_partkey")).cast("int").alias("src_w"), F.lit(3).alias("src_h")))


# --- jobs


@query
def job_latest_state(spark, sf):
    return jobs.latest(L.job_events(spark, sf))


@query
def job_illegal_moves(spark, sf):
    return jobs.illegal_moves(L.job_events(spark, sf))


@query
def job_queue_page(spark, sf):
    return jobs.queue(jobs.latest(L.job_events(spark, sf)), None, 20, 10).select("job_id", "state")


@query
def job_claim(spark, sf):
    return jobs.claim(jobs.latest(L.job_events(spark, sf)), 3).select("job_id", "created_at")


@query
def job_stale(spark, sf):
    return jobs.requeue_events(L.job_events(spark, sf), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"), 3600).select("job_id", "seq", "state")


@query
def job_counts(spark, sf):
    return jobs.counts_by_state(jobs.latest(L.job_events(spark, sf)))


@query
def job_rows_page(spark, sf):
    rows = sinks.job_rows(L.ledger(spark, sf).withColumn("job_id", F.col("doc_id")), ["narration", "credit", "debit", "balance", "date"])
    return jobs.rows_page(rows, 17, 5, 2)


@query
def job_overrides(spark, sf):
    latest = jobs.latest(L.job_events(spark, sf)).withColumn("state", F.when(F.col("job_id") % 3 == 0, "REJECTED").otherwise(F.col("state")))
    asked = latest.select("job_id", F.when(F.col("job_id") % 2 == 0, "PARTNER").otherwise("SENIOR_ACCOUNTANT").alias("role"), F.when(F.col("job_id") % 5 == 0, "short").otherwise("scan is legible").alias("reason"))
    return jobs.override_events(latest, asked, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("job_id", "seq", "state", "reason")


@query
def audit_log_recent(spark, sf):
    e = L.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("action"))
    return jobs.audit_recent(e, 25)


@query
def audit_log_of_job(spark, sf):
    e = L.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("action"))
    return jobs.audit_of_job(e, 8)


# --- records


@query
def frame_records(spark, sf):
    f = sinks.frame(_classified(spark, sf).select("*", F.lit("CLEAN").alias("row_state")))
    return f


@query
def transport_records(spark, sf):
    return sinks.job_rows(_classified(spark, sf).withColumn("job_id", F.col("doc_id")), ["date", "narration", "debit", "credit", "balance", "page_no", "contra"])


@query
def created_jobs(spark, sf):
    d = L.read(spark, sf, "documents").select("text", "source")
    return jobs.creation_event(d, "text", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).groupBy("job_id", "state", "stage").agg(F.count("*").alias("n"))


# --- readers and statements of both kinds


@query
def text_layer_words(spark, sf):
    w = L.words(spark, sf)
    points = {"x0": F.col("left") / 4.0, "x1": (F.col("left") + F.col("width")) / 4.0, "bottom": (F.col("top") + F.col("height")) / 4.0}
    items = w.withColumns(points).withColumn("top", F.col("top") / 4.0)
    return scans.text_layer_words(items.drop("left", "width", "height", "confidence"))


@query
def polygon_words(spark, sf):
    """Boxes as polygons with a slanted upper side; the middle word of every third document is blank."""
    w = L.words(spark, sf)
    x, y = F.col("left").cast("double"), F.col("top").cast("double")
    polygon = F.array(F.array(x, y + 0.75), F.array(x + F.col("width"), y), F.array(x + F.col("width") + 0.5, y + F.col("height")), F.array(x + 0.25, y + F.col("height")))
    blank = F.when((F.col("doc_id") % 3 == 0) & (F.col("left") == 200), "  ").otherwise(F.concat(F.lit(" "), F.col("text")))
    found = w.withColumn("polygon", polygon).withColumn("text", blank).withColumn("confidence", F.col("confidence") / 100.0)
    out = scans.polygon_words(found.drop("left", "top", "width", "height"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query
def numeric_words(spark, sf):
    return scans.numeric_words(L.words(spark, sf)).select("doc_id", "page_no", "text", "left", "top")


def _upper_part(words: DataFrame) -> DataFrame:
    box = {"region": "upper right", "x0": 180, "y0": 0, "x1": 600, "y1": 110}
    return words.select("doc_id", "page_no").distinct().withColumns({k: F.lit(v) for k, v in box.items()})


@query
def region_texts(spark, sf):
    w = L.words(spark, sf)
    return scans.region_text(w, _upper_part(w))


@query
def region_numbers(spark, sf):
    w = L.words(spark, sf)
    return scans.region_text(w, _upper_part(w), number=True)


@query
def raster_page_counts(spark, sf):
    """Page files by name; each document has a cover file without a number as well."""
    p = L.page_images(spark, sf).select("doc_id", F.format_string("/rasters/%d/page-%02d.png", "doc_id", "page_no").alias("path"))
    covers = p.select("doc_id", F.format_string("/rasters/%d/cover.png", "doc_id").alias("path")).distinct()
    return scans.page_counts(scans.numbered_pages(p.unionByName(covers)))


@query
def flattened_names(spark, sf):
    p = L.page_images(spark, sf)
    wrapped = F.when(F.col("page_no") % 3 == 0, F.array(F.lit(None).cast("string"), F.lit(""), "codec", F.lit("stream"))).when(F.col("page_no") % 3 == 1, F.array("codec"))
    return p.select("doc_id", "page_no", quality.flat_name(wrapped).alias("codec"))


@query
def routed_rows(spark, sf):
    """Even pages are read from their text layer, odd ones by a recogniser that takes zeros of the narration for letters."""
    t = L.statement_lines(L.ledger(spark, sf))
    classes = t.select("doc_id", "page_no").distinct().withColumn("page_class", F.when(F.col("page_no") % 2 == 0, "DIGITAL").otherwise("SCANNED"))
    scanned = t.withColumn("text", F.replace("text", F.lit("TOWN"), F.lit("TOVN"))).withColumn("confidence", F.lit(50.0))
    rows = statement.route(t, scanned, classes).rows
    return rows.select("doc_id", "page_no", "source_row", "narration", "printed_amount", "balance", "ocr_confidence")


@query
def routed_pages(spark, sf):
    t = L.statement_lines(L.ledger(spark, sf))
    classes = t.select("doc_id", "page_no").distinct().withColumn("page_class", F.when(F.col("page_no") % 2 == 0, "DIGITAL").otherwise("SCANNED"))
    parsed = statement.route(t, t.withColumn("confidence", F.lit(50.0)), classes, first=1, last=2)
    return parsed.pages.select("doc_id", "page_no", "page_class", "lines", "rows", "mean_confidence")


@query
def scanned_page_lines(spark, sf):
    """Every second page is ruled; a second reading of the money columns has every figure with a better confidence."""
    w = L.words(spark, sf)
    pages = w.select("doc_id", "page_no", F.lit(600).alias("page_width")).distinct()
    better = w.filter("left = 400").withColumn("confidence", F.lit(99.5))
    found = layout.page_lines(w, layout.bands(L.band_rules(spark, sf)).filter("doc_id % 2 = 0"), pages, better)
    return found.select("doc_id", "line_no", "text", "top", F.round("confidence", 4).alias("confidence"))


@query
def profile_line_kinds(spark, sf):
    """A bank's own header line is one only with that bank's layout."""
    t = L.statement_lines(L.ledger(spark, sf))
    own = t.filter("line_no = 1").withColumn("line_no", F.lit(5)).withColumn("text", F.lit("STATE BANK OF INDIA"))
    return lines.read_lines(t.unionByName(own), LAYOUT).select("doc_id", "page_no", "line_no", "kind", "label")


# --- positional joins, packs, reports, views


@query
def row_movements(spark, sf):
    c = _classified(spark, sf)
    classes = c.select("doc_id", "source_row", "category", "rule_id")
    return rules.movements(c.select("doc_id", "source_row", "credit", "debit"), classes)


@query
def pack_rows(spark, sf):
    """The default pack as a table and back again."""
    pack = rules.pack_from(rules.pack_frame(spark))
    return rules.pack_frame(spark, pack).select("priority", "id", "category", F.array_join("words", " ").alias("words"), "direction", "review")


@query
def chain_text(spark, sf):
    rows = L.ledger(spark, sf)
    state = F.when(F.col("source_row") % 7 == 3, "REPAIRED").otherwise("CLEAN")
    accounts = L.accounts(rows).withColumn("closing", F.when(F.col("doc_id") % 4 > 0, money(F.col("closing") + F.col("doc_id") % 2)))
    return chain.render(chain.report(rows.withColumn("row_state", state), accounts))


@query
def quality_text(spark, sf):
    return quality.render(quality.inspect(L.page_images(spark, sf)))


@query
def quality_view(spark, sf):
    return quality.distinct_findings(quality.inspect(L.page_images(spark, sf)))


@query
def job_lookup(spark, sf):
    return jobs.lookup(jobs.latest(L.job_events(spark, sf)), 8).select("job_id", "state", "n_events")


@query
def job_view(spark, sf):
    seen = jobs.view(jobs.latest(L.job_events(spark, sf)))
    return seen.select("job_id", "filename", "state", "stage", "progress_done", "row_count")


@query
def job_queue_total(spark, sf):
    return jobs.total(jobs.latest(L.job_events(spark, sf)).filter("state = 'QUEUED'"))


@query
def job_rows_decoded(spark, sf):
    """A page of a job's rows as columns, with the count of all its rows."""
    rows = sinks.job_rows(L.ledger(spark, sf).withColumn("job_id", F.col("doc_id")), ["narration", "credit", "debit", "balance", "date"])
    page = jobs.decoded(jobs.rows_page(rows, 17, 5, 2), "narration string, credit decimal(18,2), balance decimal(18,2), date date")
    return page.join(F.broadcast(jobs.total(jobs.lookup(rows, 17))))


@query
def job_intake(spark, sf):
    """An order is an upload: some are no PDFs, some cannot be read, the others have the verdict of their pages."""
    graded = quality.verdicts(quality.inspect(L.page_images(spark, sf))).withColumnRenamed("doc_id", "job_id").filter("job_id % 10 <> 3")
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, ".xlsx").when(F.col("o_orderkey") % 2 == 0, ".PDF").otherwise(".pdf"))
    uploads = L.read(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), name.alias("filename"))
    return jobs.intake(uploads, graded, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).select("job_id", "status", "state", "stage", "message")


@query
def override_log(spark, sf):
    latest = jobs.latest(L.job_events(spark, sf))
    asked = latest.select("job_id", F.when(F.col("job_id") % 2 == 0, "PARTNER").otherwise("SENIOR_ACCOUNTANT").alias("role"), F.when(F.col("job_id") % 5 == 0, "short").otherwise("scan is legible").alias("reason"))
    entries = jobs.override_entries(latest, asked, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return jobs.with_overridden(latest, entries).join(entries.select("job_id", "detail"), "job_id", "left").select("job_id", "overridden", "detail")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: printed lines to category totals that tie."""
    return QUERIES["lines_to_summary"](spark, sf_dir)
