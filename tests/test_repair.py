"""Faults put into a clean chain, each with what is found and what is mended."""

from decimal import Decimal as D

import pytest

from tallyloom.operators import chain, repair

OPENING, CLOSING = D("100000.00"), D("124900.00")
MOVES = [D(x) for x in ("15400.00", "-8750.00", "22000.00", "-5000.00", "1250.00")]
ACCOUNT = "doc_id string, opening decimal(18,2), closing decimal(18,2)"
ROW = "doc_id string, source_row int, page_no int, printed_amount decimal(18,2), balance decimal(18,2)"


def clean():
    out, b = [], OPENING
    for i, m in enumerate(MOVES):
        b += m
        out.append([i, 1, abs(m), b])
    return out


def put(*faults, drop=None):
    rows = clean()
    for i, field, v in faults:
        rows[i][field] = v and D(v)
    return [r for i, r in enumerate(rows) if i != drop]


A, B = 2, 3
CASES = {
    "none": (CLOSING, put(), [], True),
    "amount": (CLOSING, put((1, A, "8760.00")), [(1, "AMOUNT_CORRUPT", True)], True),
    "amount digit": (CLOSING, put((1, A, "3750.00")), [(1, "AMOUNT_CORRUPT", True)], True),
    "balance": (CLOSING, put((1, B, "106660.00")), [(1, "BALANCE_CORRUPT", True)], True),
    "no balance": (CLOSING, put((1, B, None)), [(1, "BALANCE_MISSING", True)], True),
    "no amount": (CLOSING, put((3, A, None)), [(3, "AMOUNT_MISSING", True)], True),
    "last balance": (CLOSING, put((4, B, "124910.00")), [(4, "BALANCE_CORRUPT", True)], True),
    "last amount": (CLOSING, put((4, A, "1260.00")), [(4, "AMOUNT_CORRUPT", True)], True),
    "last without closing": (None, put((4, A, "1260.00")), [(4, "AMBIGUOUS", False)], False),
    "row gone": (CLOSING, put(drop=2), [(2, "MISSING_ROW", False)], False),
    "both": (CLOSING, put((1, B, "106660.00"), (1, A, "9999.00")), [(1, "AMBIGUOUS", False), (2, "UPSTREAM_BREAK", False)], False),
    "neither legible": (CLOSING, put((2, A, None), (2, B, None)), [(2, "BALANCE_MISSING", False), (3, "UPSTREAM_BREAK", False)], False),
    "two far apart": (CLOSING, put((0, A, "15500.00"), (3, B, "123660.00")), [(0, "AMOUNT_CORRUPT", True), (3, "BALANCE_CORRUPT", True)], True),
}


def settle(spark, names):
    rows = spark.createDataFrame([(n, *r) for n in names for r in CASES[n][1]], ROW)
    accounts = spark.createDataFrame([(n, OPENING, CASES[n][0]) for n in names], ACCOUNT)
    return repair.settle(rows, accounts), accounts


@pytest.fixture(scope="module")
def together(spark):
    settled, accounts = settle(spark, list(CASES))
    return settled.cache(), accounts


def found(settled):
    out = {}
    for r in repair.diagnoses(settled).orderBy("doc_id", "row_index").collect():
        out.setdefault(r.doc_id, []).append((r.row_index, r.kind, r.applied))
    return out


def test_all_faults_at_once(together):
    got = found(together[0])
    assert {n: got.get(n, []) for n in CASES} == {n: c[2] for n, c in CASES.items()}


@pytest.mark.parametrize("name", ["balance", "both", "row gone"])
def test_one_at_a_time_is_the_same(spark, name):
    assert found(settle(spark, [name])[0]).get(name, []) == CASES[name][2]


def test_reports(together):
    settled, accounts = together
    for r in chain.report(settled, accounts).collect():
        assert r.reconciled is CASES[r.doc_id][3] and r.closing_computed == CLOSING
        assert r.blocks_export is (r.unresolved > 0) and (r.variance == 0)


def test_mended_fields_and_notes(together):
    rows = {(r.doc_id, r.row_index): r for r in together[0].collect()}
    assert rows["balance", 1].balance == D("106650.00") and rows["balance", 2].row_state == "REPAIRED" and rows["balance", 2].repair_note == "balance of preceding row corrected"
    assert rows["amount", 1].printed_amount == D("8750.00") and rows["no amount", 3].debit == D("5000.00") and rows["both", 3].row_state == "CLEAN"
    gap = rows["row gone", 2].repair_note
    assert "12000.00 or 22000.00" in gap


def test_repair_is_idempotent(spark, together):
    settled, accounts = together
    again = repair.settle(settled.select("doc_id", "source_row", "page_no", "printed_amount", "balance"), accounts)
    mended = {n for n, c in CASES.items() if c[3]}
    assert not mended & set(found(again))


def test_order_of_input_does_not_matter(spark, together):
    settled, accounts = settle(spark, list(CASES))
    a = sorted(map(tuple, settled.orderBy("repair_note").collect()), key=str)
    assert a == sorted(map(tuple, together[0].collect()), key=str)


def test_balances_telescope(together):
    for r in together[0].groupBy("doc_id").agg({"credit": "sum", "debit": "sum"}).collect():
        assert r["sum(credit)"] - r["sum(debit)"] == CLOSING - OPENING


def test_empty(spark):
    rows, accounts = spark.createDataFrame([], ROW), spark.createDataFrame([("x", OPENING, None)], ACCOUNT)
    settled = repair.settle(rows, accounts)
    assert settled.count() == 0
    assert chain.report(settled, accounts).first().closing_computed == OPENING
