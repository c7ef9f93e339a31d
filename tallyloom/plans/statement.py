"""Whole statements, many at a time: parse, categorise, audit, grade. Every step is lazy and keyed by document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, chain, lines, quality, repair, rules, summary
from ..sources import sinks


@dataclass(frozen=True)
class Parsed:
    """rows, check figures and page diagnostics of all documents."""

    rows: DataFrame
    anchors: DataFrame
    pages: DataFrame


@dataclass(frozen=True)
class Categorised:
    """Settled and classified rows, chain reports, findings, category totals, summaries, and whether they tie."""

    rows: DataFrame
    reports: DataFrame
    diagnoses: DataFrame
    notes: DataFrame
    totals: DataFrame
    summaries: DataFrame
    ties: DataFrame


def parse(printed: DataFrame, profile_key: str | None = None, first: int | None = None, last: int | None = None, pages: DataFrame | None = None) -> Parsed:
    """Rows of printed lines (doc_id, page_no, line_no, text, confidence), of a range of pages if asked. ``pages``
    (doc_id, page_no, page_class): all pages there are; those without a readable line are reported with none."""
    layout = lines.profile(profile_key)
    read = lines.read_lines(printed.filter(F.col("page_no").between(first or 1, last or 2**31 - 1)), layout)
    found = lines.page_diagnostics(read)
    if pages is not None:
        every = pages.filter(F.col("page_no").between(first or 1, last or 2**31 - 1)).select("doc_id", "page_no", "page_class")
        found = every.join(found, ["doc_id", "page_no"], "left").fillna(0, ["lines", "rows", "unparsed_lines"]).fillna(0.0, ["mean_confidence"])
        found = found.withColumn("printed_pages", F.coalesce("printed_pages", F.array().cast("array<int>")))
    return Parsed(lines.transactions(read, layout), lines.anchors(read), found)


def route(digital: DataFrame, scanned: DataFrame, classes: DataFrame, profile_key: str | None = None, first: int | None = None, last: int | None = None) -> Parsed:
    """Statements of both kinds of pages, also within one document: every page's lines come from the reader that its class
    (doc_id, page_no, page_class) calls for; rows are numbered over all of them. Diagnostics carry the page's class."""
    of = lambda lines_, kind: lines_.join(classes.filter(F.col("page_class") == kind).select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")
    return parse(of(digital, "DIGITAL").unionByName(of(scanned, "SCANNED")), profile_key, first, last, classes)


def categorise(parsed: Parsed, accounts: DataFrame, profile_key: str | None = None, pack: list[rules.Rule] | None = None) -> Categorised:
    """Accounts (doc_id, holder, opening, closing): a missing opening is the first brought-forward figure, else 0."""
    layout = lines.profile(profile_key)
    known = lines.opening_balance(accounts, parsed.anchors, F.lit(layout.overdraft))
    settled = repair.settle(parsed.rows, known)
    named = rules.classify(settled.join(known.select("doc_id", "holder"), "doc_id", "left"), pack)
    reports = chain.report(named, known)
    summaries = summary.summary(named)
    return Categorised(named, reports, repair.diagnoses(settled), repair.notes(settled), summary.category_totals(named), summaries, summary.tie(summaries, reports))


def audit_report(parsed: Parsed, done: Categorised) -> DataFrame:
    """doc_id and the printed evidence."""
    return audit.render(audit.evidence(parsed.rows, parsed.anchors, parsed.pages), done.reports, done.notes)


def frame(done: Categorised) -> DataFrame:
    """The emitted rows, in the frame's 19 columns."""
    return sinks.frame(done.rows)


def grade(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inspected pages and document verdicts."""
    seen = quality.inspect(pages)
    return seen, quality.verdicts(seen)
