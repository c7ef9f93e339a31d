import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lines as N

KINDS = [
    ("Page Total Credit : 12,34,567.00", "PAGE_TOTAL"), ("Paqe Tota1 Credit : 12,34,567.00", "PAGE_TOTAL"), ("Service Outlet : 12", "HEADER_REPEAT"), ("Date  Particulars  Chq No  Withdrawal  Deposit  Balance", "HEADER_REPEAT"),
    ("......", "SEPARATOR"), ("-----", "SEPARATOR"), ("   ", "BLANK_FILLER"), ("Limits : 1 Draw Power : 2", "LIMITS_TABLE"), ("B/F Balance 71,85,895.72 Dr", "OPENING"), ("Carried Forward 1,20,000.00", "CARRY_FORWARD"),
    ("15/07/2025  CASH DEPOSIT SELF  50,000.00  1,20,000.00", "TRANSACTION"), ("12 34", "TRANSACTION"), ("Statemxnt of accoumt", "HEADER_REPEAT"), (None, "BLANK_FILLER"),
]


def test_kinds(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KINDS)], "i int, t string")
    got = df.select("i", N.classify_line(F.col("t"))["kind"].alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [k for _, k in KINDS]


def test_profiles_come_first(spark):
    df = spark.createDataFrame([("Value date 12/12/2024 10.00 20.00",)], "t string")
    assert df.select(N.classify_line(F.col("t"))["kind"]).first()[0] == "TRANSACTION"
    assert df.select(N.classify_line(F.col("t"), N.profile("sbi_current"))["kind"]).first()[0] == "HEADER_REPEAT"
    with pytest.raises(KeyError):
        N.profile("nobody")


def test_fields(spark):
    df = spark.createDataFrame([("15/O7/2025 14-07-2025 CASH 123456 SELF  50,000.00  1,20,000.00 Cr EN01",), ("31-12-1899 x",), ("",)], "t string")
    a, b, c = df.select(N.extract_fields(F.col("t")).alias("f")).select("f.*").collect()
    assert [str(d) for d in a.dates] == ["2025-07-15", "2025-07-14"] and [str(x) for x in a.amounts] == ["50000.00", "120000.00"]
    assert (a.instrument, a.narration, a.balance_marker) == ("123456", "CASH SELF", "CR") and b.dates == [] and c.amounts == []


def test_marker_beats_the_kind_of_account(spark):
    df = spark.createDataFrame([("01/01/2024 A 10.00 20.00 Cr",), ("01/01/2024 A 10.00 20.00 Dr",), ("01/01/2024 A 10.00 20.00",)], "text string")
    got = [str(r.balance) for r in N.build_rows(df, F.lit(True)).collect()]
    assert got == ["20.00", "-20.00", "-20.00"]


def test_page(spark):
    text = ["Service Outlet : 1  Page 3", "Opening Balance 1,000.00", "01/01/2024 A 10.00 1,010.00", "interest rate note", "02/01/2024 B 5.00 1,005.00", "just words", "Page Total Credit : 10.00", "Sanction Limit 5,000.00", "03/01/2024 C 1.00 1,006.00"]
    df = spark.createDataFrame([("d", 1, i, t, 90.0) for i, t in enumerate(text)], "doc_id string, page_no int, line_no int, text string, confidence double")
    read = N.read_lines(df)
    assert [r.narration for r in N.transactions(read).orderBy("source_row").collect()] == ["A", "B"]
    d = N.page_diagnostics(read).first()
    assert (d.printed_pages, d.lines, d.rows, d.unparsed_lines) == ([3], 9, 2, 1)
    assert [(r.kind, str(r.value)) for r in N.anchors(read).orderBy("source_row").collect()] == [("OPENING_BALANCE", "1000.00"), ("PAGE_TOTAL_CREDIT", "10.00")]
