from decimal import Decimal as D

import pytest

from tallyloom.operators import audit
from tallyloom.plans import statement as S

PAGE = [
    "STATE BANK OF INDIA", "Account Statement", "Brought Forward 1,00,000.00 Cr", "01/01/2024  CASH DEP SELF  15,400.00  1,15,400.00 Cr", "02/01/2024  ATM WDL 4276 TOWN  8,750.00  1,06,650.00 Cr",
    "03/01/2024  UPI/CR/RAMU/AXL  17,500.00  1,24,150.00 Cr", "04/01/2024  UPI/DR/ASHA BORA/PUNB  22,118.00  1,02,032.00 Cr", "Page Total Credit : 32,900.00", "Page Total Debit : 30,868.00",
]
LINE = "doc_id string, page_no int, line_no int, text string, confidence double"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(d, 1, i, t, 95.0) for d in ("a", "b") for i, t in enumerate(PAGE)], LINE)


def test_end_to_end(spark, lines):
    accounts = spark.createDataFrame([("a", "MR. ASHA BORA", None, D("102032.00")), ("b", None, D("100000.00"), None)], "doc_id string, holder string, opening decimal(18,2), closing decimal(18,2)")
    pages = spark.createDataFrame([("a", 1, "DIGITAL"), ("a", 2, "SCANNED"), ("b", 1, "DIGITAL")], "doc_id string, page_no int, page_class string")
    parsed = S.parse(lines, "sbi_current", pages=pages)
    done = S.categorise(parsed, accounts, "sbi_current")
    a, b = done.reports.orderBy("doc_id").collect()
    assert (a.opening, a.total_credit, a.total_debit, a.reconciled) == (D("100000.00"), D("32900.00"), D("30868.00"), True) and not b.balances_tie
    assert all(r.ties for r in done.ties.collect())
    got = {(r.doc_id, r.code): r.n for r in done.totals.filter("n > 0").collect()}
    assert got == {("a", "S"): 1, ("a", "R"): 1, ("a", "T1"): 1, ("a", "F"): 1, ("b", "S"): 1, ("b", "R"): 1, ("b", "T1"): 1, ("b", "T2"): 1}
    assert {(r.doc_id, r.page_no): r.lines for r in parsed.pages.collect()} == {("a", 1): 9, ("a", 2): 0, ("b", 1): 9}
    assert all(r.difference == 0 for r in audit.page_totals(done.rows, parsed.anchors).collect())
    text = S.audit_report(parsed, done).filter("doc_id = 'a'").first().report
    assert "transaction rows    4" in text and "1,02,032.00 Cr" in text and len(S.frame(done).columns) == 20
    assert S.parse(lines, first=2).rows.count() == 0


def test_bake_off(spark, lines):
    from pyspark.sql import functions as F

    worse = lines.withColumn("text", F.replace("text", F.lit("17,500.00"), F.lit("17,600.00")))
    got = {r.engine: r for r in audit.bake_off(lines.withColumn("engine", F.lit("x")).unionByName(worse.withColumn("engine", F.lit("y")))).collect()}
    assert (got["x"].n_rows, got["x"].comparisons, got["x"].agreeing, got["x"].money_tokens) == (8, 6, 6, 22)
    assert got["y"].agreeing == 4


def test_bake_off_reads_each_text_once(spark, lines):
    """Engines that agree share the work, repeated lines count again, and the plan has the lines once and no join."""
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([("c", 1, i, t, 95.0) for i, t in enumerate(["01/01/2024 A 1O,000.00 10,000.00 Dr", None, "", "Page Total Credit 1,00.00 2,00.00", "02/01/2024 B 5,000,00 5,000.00", "02/01/2024 C 12 345.00 1 234.00", "x 1.00"])], LINE)
    both = lines.unionByName(odd)
    both = both.withColumn("engine", F.lit("x")).unionByName(both.withColumn("engine", F.lit("y"))).unionByName(both.limit(0).withColumn("engine", F.lit("z")))
    got = {r.engine: tuple(r)[1:] for r in audit.bake_off(both).collect()}
    assert set(got) == {"x", "y"} and got["x"] == got["y"]
    alone = audit.bake_off(odd.withColumn("engine", F.lit("x"))).first()
    assert (alone.money_tokens, alone.n_rows, alone.comparisons, alone.agreeing) == (9, 3, 2, 0)
    twice = audit.bake_off(lines.unionByName(lines).withColumn("engine", F.lit("x"))).first()
    assert (twice.money_tokens, twice.n_rows) == (44, 16)
    plan = audit.bake_off(both)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Union") == 1


def test_amount_value_is_that_of_parse_amount(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions.money import amount_value, parse_amount

    tokens = ["1.00", "1,00", "12,34,567.89", ",,.00", ".50", ",50", "1,2,3,4.56", "12.34.56", "1O.00", "1.00\n", " 1.00", "1.00 Dr", "-5.00", "99999999999999999999.00", "9" * 16 + ".99", "", "abc", "1,234", "12,345", "١.٠٠", None]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", amount_value(F.col("t")).alias("a"), parse_amount(F.col("t"))["value"].alias("b")).collect()
    assert all(r.a == r.b for r in rows), rows
