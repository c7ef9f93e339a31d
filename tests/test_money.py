from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import money as M
from tallyloom.functions import similarity as S
from tallyloom.functions import text as T

AMOUNTS = [
    ("71,85,895.72", "7185895.72", None), ("15.400,00", "15400.00", None), ("1,50,000,00", "150000.00", None), ("1S,4OO.OO", "15400.00", None), ("15,400.OO", "15400.00", None),
    ("1,97,817.10CR", "197817.10", "CR"), ("1,2345,678.00", "12345678.00", None), ("15400", "15400.00", None), ("", None, None), ("----", None, None), (None, None, None), ("Rs. 1,234.50 Dr.", "1234.50", "DR"),
    ("-131.24", "-131.24", None), ("131.24-", "-131.24", None), ("90,98,371.22De", "9098371.22", "DR"), ("42.720r", "42.72", None),
]


def test_amounts_are_read(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(AMOUNTS)], "i int, x string").select("i", M.parse_amount(F.col("x")).alias("p")).orderBy("i").select("p.*").collect()
    assert [(r.value and str(r.value), r.sign_hint) for r in rows] == [(v, h) for _, v, h in AMOUNTS]
    assert not rows[6].grouping_ok and not rows[7].has_paise and len(rows[3].repairs) == 5 and rows[8].note == "empty"


def test_formats_round_trip(spark):
    values = ["9098371.22", "214589593.12", "100000.00", "-9098371.22", "0.00", "999.50", "131.24"]
    df = spark.createDataFrame([(D(v),) for v in values], "v decimal(18,2)")
    rows = df.select("v", M.format_indian(F.col("v")).alias("i"), M.format_drcr(F.col("v")).alias("d"), M.parse_amount(M.format_indian(F.col("v")))["value"].alias("back")).collect()
    assert [r.i for r in rows] == ["90,98,371.22", "21,45,89,593.12", "1,00,000.00", "-90,98,371.22", "0.00", "999.50", "131.24"]
    assert rows[3].d == "90,98,371.22 Dr" and rows[4].d == "0.00 Cr" and all(r.v == r.back for r in rows)


def test_tokens_and_false_joins(spark):
    df = spark.createDataFrame([("CASH 1, 80,000.00 1,20,000.00",), ("REF071760 36,199.06 5,00,000.00Dr",), ("none",)], "x string")
    got = [[t["token"] for t in r.t] for r in df.select(M.money_tokens(F.col("x")).alias("t")).collect()]
    assert got == [["1, 80,000.00", "1,20,000.00"], ["36,199.06", "5,00,000.00"], []]


@pytest.mark.parametrize("observed,candidate,want", [("15400.00", "15400.00", True), ("15400.00", "16500.00", True), ("15400.00", "1540.00", True), ("15400.00", "154000.00", True), ("15400.00", "98765.43", False), (None, "1.00", True), ("5000.00", "17000.00", False)])
def test_plausible(spark, observed, candidate, want):
    df = spark.createDataFrame([(observed and D(observed), D(candidate))], "a decimal(18,2), b decimal(18,2)")
    assert df.select(S.plausible(F.col("a"), F.col("b"))).first()[0] is want


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_against_brute_force(spark):
    import random

    rng = random.Random(1)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 10))), "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 16)))) for _ in range(120)]

    def partial(a, b):
        if not a or not b:
            return 100.0 if len(a) == len(b) else 0.0
        n, h = (a, b) if len(a) <= len(b) else (b, a)
        windows = (h[max(i, 1) - 1 : i - 1 + len(n)] for i in range(2 - len(n), len(h) + 1))
        return max(200 * _common(n, w) / (len(n) + len(w)) for w in windows)

    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.common(F.col("a"), F.col("b")).alias("c"), S.partial_ratio(F.col("a"), F.col("b")).alias("p")).collect():
        assert r.c == _common(r.a, r.b) and abs(r.p - partial(r.a, r.b)) < 1e-9


def test_resemblance_is_the_partial_ratio(spark):
    """Damaged phrases inside other text, around the threshold."""
    import random

    from tallyloom.operators.lines import _parts

    rng, phrase = random.Random(2), "statementofaccount"
    texts = []
    for _ in range(250):
        p = list(phrase)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(p))
            p[k : k + rng.randrange(0, 2)] = rng.choice(["", "x", "t"])
        cut = rng.randrange(0, 4)
        texts.append("".join(rng.choice("aetnos") for _ in range(rng.randrange(0, 12))) + "".join(p)[cut:] + "".join(rng.choice("aetnos") for _ in range(rng.randrange(0, 12))))
    df = spark.createDataFrame([(t,) for t in texts + ["", "ment"]], "t string")
    rows = df.select(S.resembles(F.lit(phrase), _parts(phrase), S.letter_bits(phrase), F.col("t"), 88).alias("a"), (S.partial_ratio(F.lit(phrase), F.col("t")) >= 88).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and 30 < sum(r.a for r in rows) < 240


def test_pieces_never_miss():
    """Whatever two edits hit, one of the parts stays whole."""
    phrase = "openlngbalance"
    parts = S.pieces(phrase, 88)
    for i in range(len(phrase)):
        assert any(p in phrase[:i] + "#" + phrase[i + 1 :] for p in parts)


def test_narration_and_names(spark):
    df = spark.createDataFrame([("IMPS-532116454511-KANU-UCBA0002520", "MR. ASHA BORA"), ("G5T 1820-GST", "O'NEIL A.K. DAS"), (None, None)], "n string, h string")
    a, b, c = df.select(T.narration(F.col("n")).alias("n"), T.display_name(F.col("h")).alias("d"), T.name_words(F.col("h")).alias("w")).collect()
    assert (a.n.words, a.n.numbers, a.n.references) == (["lmps", "kanu"], ["532116454511"], ["UCBA0002520"]) and (a.d, a.w) == ("Asha Bora", ["asha", "bora"])
    assert b.n.words == ["gst", "gst"] and b.d == "O'Neil A.K. Das" and c.n.words == [] and c.d == ""
