from decimal import Decimal as D

import pytest

from tallyloom.operators import rules as R
from tallyloom.operators import summary as S

CASES = [
    ("UPI/CR/RAVI/AXL", 1, "T1"), ("UPI/CR/RAVI/AXL", -1, "T2"), ("NEFT CR-XX-PHONEPE LIMITED", 1, "NEFT_IN"), ("IMPS-607123456789-PHONEPELIMITEDPAYMENTAGG", 1, "IMPS_IN"), ("UPI/DR/ANIL DEB/PUNB", -1, "F"), ("UPI/REV/RAVI/YBL", 1, "Y"),
    ("GST 1820-GST", -1, "C"), ("INTEREST CHARGED ON CC", -1, "E"), ("CBDT TAX PAYMENT 280", -1, "P"), ("CASH DEP-SELF-CASH TOWN", 1, "S"), ("ATM WDL 4276 TOWN", -1, "R"), ("184693 TOWN", 1, "U1"), ("WOBBLE FLUX", -1, "UNCL"), ("UPI/CR/RAVI", 0, "UNCL"),
    ("lNTERE5T CREDlTED", 1, "D"), ("ELECTRCITY BILL", -1, "V"), ("REFUND OF TAX", 1, "Y"),
]


@pytest.fixture(scope="module")
def classified(spark):
    rows = [("d", 1, i, t, D("100.00") if s > 0 else D("0.00"), D("100.00") if s < 0 else D("0.00"), "MR. ANIL DEB") for i, (t, s, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, source_row int, narration string, credit decimal(18,2), debit decimal(18,2), holder string")
    return R.classify(df).cache()


def test_first_match(classified):
    assert [r.category for r in classified.orderBy("source_row").collect()] == [c for _, _, c in CASES]


def test_ledgers_and_review(classified):
    rows = classified.orderBy("source_row").collect()
    assert rows[2].tally_ledger == R.PHONEPE and rows[4].tally_ledger == "Anil Deb - Own Accounts (Contra)" and rows[4].contra and rows[4].needs_review
    assert rows[12].rule_id is None and rows[12].needs_review and rows[11].rule_id == "cheque.bare-number"


def test_plan_has_no_python_and_no_shuffle(classified, spark):
    df = R.classify(classified.select("narration", "credit", "debit"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_summary_ties_and_breaks(classified, spark):
    from tallyloom.operators import chain

    accounts = spark.createDataFrame([("d", D("0.00"), None)], "doc_id string, opening decimal(18,2), closing decimal(18,2)")
    from pyspark.sql import functions as F

    report = chain.report(classified.withColumn("row_state", F.lit("CLEAN")), accounts)
    assert S.tie(S.summary(classified), report).first().ties
    assert not S.tie(S.summary(classified.filter("source_row <> 3")), report).first().ties
    assert S.category_totals(classified).count() == 35
    assert S.as_json(classified).first().summary.startswith('{"categories":[{"code":"A"')
    assert len(S.render(classified).first().report.split("\n")) == 39


def test_pack_is_checked():
    assert len(R.checked(R.default_pack())) == 76
    for bad in ([R.Rule("a", "C")], [R.Rule("a", "C", ("x",), "CREDIT")], [R.Rule("a", "C", ("x",), "DEBIT")] * 2):
        with pytest.raises(ValueError):
            R.checked(bad)
    for bad in ([R.Rule("a", "??", ("x",))], [R.Rule("a", "F", predicate="nobody")]):
        with pytest.raises(KeyError):
            R.checked(bad)
