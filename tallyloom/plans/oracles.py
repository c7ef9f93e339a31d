"""SQL for DuckDB that states the results of the registered queries, from the same tables."""

from __future__ import annotations

#: The ledger of plans.ledger: one row for each order.
LEDGER = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS INTEGER) AS source_row,
 CAST(count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS n FROM orders),
s AS (SELECT *, CAST(1 + source_row // 20 AS INTEGER) AS page_no, CAST(CASE WHEN k % 3 = 0 THEN amount ELSE 0 END AS DECIMAL(18,2)) AS credit, CAST(CASE WHEN k % 3 <> 0 THEN amount ELSE 0 END AS DECIMAL(18,2)) AS debit,
 source_row = n - 1 AS is_last, source_row % 7 = 3 AS hit, [ 'ASHA BORA', 'KIRAN DOLI', 'MEENA SAHU', 'TARUN GOGOI' ][doc_id % 4 + 1] AS holder, k % 12 AS t, k % 5 = 0 AS damaged FROM o),
b AS (SELECT *, CAST(sum(credit - debit) OVER (PARTITION BY doc_id ORDER BY source_row) AS DECIMAL(18,2)) AS balance FROM s),
l AS (SELECT *, CAST(balance - credit + debit AS DECIMAL(18,2)) AS before FROM b)"""

#: Indian notation of a magnitude: v is a decimal(18,2) that is not negative.
def indian(v: str) -> str:
    whole = f"split_part(CAST({v} AS VARCHAR), '.', 1)"
    head = f"left({whole}, length({whole}) - 3)"
    grouped = f"ltrim(reverse(regexp_replace(reverse({head}), '(\\d\\d)', '\\1,', 'g')), ',')"
    return f"(CASE WHEN length({whole}) > 3 THEN {grouped} || ',' || right({whole}, 3) ELSE {whole} END || '.' || split_part(CAST({v} AS VARCHAR), '.', 2))"


def printed(v: str) -> str:
    return f"({indian(f'abs({v})')} || CASE WHEN {v} < 0 THEN ' Dr' ELSE ' Cr' END)"


def slip(v: str) -> str:
    return f"CAST({v} + CASE WHEN CAST(floor(abs({v}) / 10) AS BIGINT) % 10 < 9 THEN 1 ELSE -1 END * CASE WHEN {v} < 0 THEN -10 ELSE 10 END AS DECIMAL(18,2))"


def canon(v: str) -> str:
    return f"regexp_replace(translate(lower({v}), '01i|!2569q8', 'ollllzsgggb'), '[^a-z]', '', 'g')"


#: Narrations, and what rules make of them by template and direction.
TEXT = """x AS (SELECT *, CAST(k % 900000 + 100000 AS VARCHAR) AS number, CASE WHEN k % 5 = 0 THEN translate(raw, 'IOS', '105') ELSE raw END AS narration FROM (
 SELECT *, replace(replace(['UPI/CR/RAMU/AXL', 'NEFT CR-HDFC0001-PHONEPE LIMITED', 'IMPS-532116454511-KANU-UCBA0002520', 'CASH DEP-SELF', 'ATM WDL 4276 TOWN', '# TOWN', 'GST 1820-GST', 'INTEREST CHARGED', 'WOBBLE FLUX', 'UPI/DR/@/PUNB',
 'ELECTRCITY BILL PAYMENT', 'RETURNED CHQ REVERSAL'][t + 1], '#', CAST(k % 900000 + 100000 AS VARCHAR)), '@', holder) AS raw FROM l))"""
RULES = """r(t, side, category, tally_ledger, contra, rule_id, needs_review) AS (VALUES
 (0, 'C', 'T1', 'Sundry Receipts / Debtors', false, 'upi.in', false), (0, 'D', 'T2', 'Sundry Payments / Creditors', false, 'upi.out', false),
 (1, 'C', 'NEFT_IN', 'Sundry Receipts - PhonePe Aggregator', false, 'neft.phonepe', false), (1, 'D', 'NEFT_OUT', 'Sundry Payments - NEFT', false, 'neft.out', false),
 (2, 'C', 'IMPS_IN', 'Sundry Receipts - IMPS', false, 'imps.in', false), (2, 'D', 'IMPS_OUT', 'Sundry Payments - IMPS', false, 'imps.out', false),
 (3, 'C', 'S', 'Cash A/c (Contra)', true, 'cash.deposit', false), (3, 'D', 'UNCL', 'Suspense A/c (Unclassified)', false, NULL, true),
 (4, 'C', 'UNCL', 'Suspense A/c (Unclassified)', false, NULL, true), (4, 'D', 'R', 'Cash A/c (Contra)', true, 'atm.atm', false),
 (5, 'C', 'U1', 'Cheque/Cash Deposit (Suspense - verify)', false, 'cheque.bare-number', true), (5, 'D', 'UNCL', 'Suspense A/c (Unclassified)', false, NULL, true),
 (6, 'C', 'U1', 'Cheque/Cash Deposit (Suspense - verify)', false, 'cheque.bare-number', true), (6, 'D', 'C', 'Bank Charges A/c', false, 'charges.gst', false),
 (7, 'C', 'D', 'Interest Received A/c', false, 'interest.credited', false), (7, 'D', 'E', 'Interest Paid A/c', false, 'interest.debited', false),
 (8, 'C', 'UNCL', 'Suspense A/c (Unclassified)', false, NULL, true), (8, 'D', 'UNCL', 'Suspense A/c (Unclassified)', false, NULL, true),
 (9, 'C', 'F', '@ - Own Accounts (Contra)', true, 'self.holder-name', true), (9, 'D', 'F', '@ - Own Accounts (Contra)', true, 'self.holder-name', true),
 (10, 'C', 'UNCL', 'Suspense A/c (Unclassified)', false, NULL, true), (10, 'D', 'V', 'Utility Expenses A/c', false, 'utility.electricity', false),
 (11, 'C', 'Y', 'Reversals / Refunds A/c', false, 'reversal.reversal', false), (11, 'D', 'Y', 'Reversals / Refunds A/c', false, 'reversal.reversal', false)),
c AS (SELECT x.*, r.category, r.contra, r.rule_id, r.needs_review, replace(r.tally_ledger, '@', ['Asha Bora', 'Kiran Doli', 'Meena Sahu', 'Tarun Gogoi'][doc_id % 4 + 1]) AS tally_ledger
 FROM x JOIN r ON x.t = r.t AND r.side = CASE WHEN k % 3 = 0 THEN 'C' ELSE 'D' END)"""
CODES = "A B C D E F G H I J K L M N O P Q R S T1 T2 U1 U2 V W X Y Z NEFT_IN NEFT_OUT RTGS_IN RTGS_OUT IMPS_IN IMPS_OUT UNCL".split()


def taxonomy() -> str:
    from ..operators.rules import TAXONOMY

    rows = ", ".join(f"({i}, '{c}', '{d}', {str(contra).lower()})" for i, (c, d, _, _, contra) in enumerate(TAXONOMY))
    return f"tax(ord, code, description, contra) AS (VALUES {rows})"


#: Lines of statements with what each is: line_no, text, kind, label.
LINES = f"""p AS (SELECT doc_id, page_no, CAST(sum(credit) AS DECIMAL(18,2)) AS credit, CAST(sum(debit) AS DECIMAL(18,2)) AS debit, arg_max(balance, source_row) AS balance, max(page_no) OVER (PARTITION BY doc_id) = page_no AS final, count(*) AS n_rows
 FROM x GROUP BY doc_id, page_no),
t AS (SELECT doc_id, page_no, CAST(source_row % 20 + 10 AS INTEGER) AS line_no, strftime(date, '%d/%m/%Y') || '  ' || narration || '  ' || {indian('amount')} || '  ' || {printed('balance')} AS text, 'TRANSACTION' AS kind, 'TXN' AS label FROM x
 UNION ALL SELECT doc_id, page_no, 1, 'Service Outlet : 0042   Page no. ' || page_no, 'HEADER_REPEAT', 'HEADER' FROM p
 UNION ALL SELECT doc_id, page_no, 2, 'Date  Particulars  Chq No  Withdrawal  Deposit  Balance', 'HEADER_REPEAT', 'COLUMN_HEADER' FROM p
 UNION ALL SELECT doc_id, page_no, 40, '------------------------', 'SEPARATOR', 'RULE' FROM p
 UNION ALL SELECT doc_id, page_no, 41, 'Page Total Credit : ' || {indian('credit')}, 'PAGE_TOTAL', 'PAGE_TOTAL_CREDIT' FROM p
 UNION ALL SELECT doc_id, page_no, 42, 'Page Total Debit : ' || {indian('debit')}, 'PAGE_TOTAL', 'PAGE_TOTAL_DEBIT' FROM p
 UNION ALL SELECT doc_id, page_no, 43, 'Carried Forward ' || {printed('balance')}, 'CARRY_FORWARD', 'CF_BALANCE' FROM p WHERE final),
tn AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no) - 1 AS INTEGER) AS source_row FROM t)"""
NARRATION = "CASE WHEN t = 5 THEN CASE WHEN damaged THEN 'T0WN' ELSE 'TOWN' END ELSE narration END"

SQL: dict[str, str] = {}


def sql(name: str, body: str, *parts: str) -> None:
    SQL[name] = f"WITH {', '.join(parts)} {body}" if parts else body


# --- balance chain
GAPPY = "g AS (SELECT *, CASE WHEN NOT hit THEN balance END AS seen FROM l), gg AS (SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, lag(seen) OVER (PARTITION BY doc_id ORDER BY source_row) AS prior FROM g), d AS (SELECT *, CAST(seen - coalesce(known, 0) AS DECIMAL(18,2)) AS delta, CAST(seen - CASE WHEN source_row = 0 THEN 0 ELSE prior END AS DECIMAL(18,2)) AS strict_delta FROM gg)"
sql("chain_deltas", "SELECT doc_id, source_row, delta, strict_delta, coalesce(abs(strict_delta) = amount, false) AS consistent FROM d", LEDGER, GAPPY)
sql("chain_directions", "SELECT doc_id, source_row, CAST(greatest(coalesce(delta, 0), 0) AS DECIMAL(18,2)) AS credit, CAST(greatest(-coalesce(delta, 0), 0) AS DECIMAL(18,2)) AS debit FROM d", LEDGER, GAPPY)
sql("chain_recompute", "SELECT doc_id, source_row, balance, CAST(credit - debit AS DECIMAL(18,2)) AS signed FROM l", LEDGER)
REPORT = "SELECT doc_id, CAST(0 AS DECIMAL(18,2)) AS opening, CAST(sum(credit - debit) AS DECIMAL(18,2)) AS closing_printed, CAST(sum(debit) AS DECIMAL(18,2)) AS total_debit, CAST(sum(credit) AS DECIMAL(18,2)) AS total_credit, count(*) FILTER (debit > 0) AS debit_count, count(*) FILTER (credit > 0) AS credit_count, {repaired} AS repaired, {unresolved} AS unresolved, CAST(sum(credit - debit) AS DECIMAL(18,2)) AS closing_computed, CAST(0 AS DECIMAL(18,2)) AS variance, true AS balances_tie, {unresolved} = 0 AS reconciled, {unresolved} > 0 AS blocks_export FROM l GROUP BY doc_id"
sql("chain_report", REPORT.format(repaired="count(*) FILTER (hit)", unresolved="count(*) FILTER (NOT hit AND source_row % 11 = 5)"), LEDGER)
sql("repair_report", REPORT.format(repaired="count(*) FILTER (hit OR (source_row > 3 AND source_row % 7 = 4))", unresolved="CAST(0 AS BIGINT)"), LEDGER)
sql("chain_totals", "SELECT doc_id, CAST(sum(debit) AS DECIMAL(18,2)) AS total_debit, CAST(sum(credit) AS DECIMAL(18,2)) AS total_credit, count(*) AS n_rows, count(*) AS n_settled FROM l GROUP BY doc_id", LEDGER)
sql("chain_row_agreement", "SELECT doc_id, count(*) AS comparisons, count(*) FILTER (NOT hit) AS agreeing, round(100.0 * count(*) FILTER (NOT hit) / count(*), 4) AS agreement FROM l WHERE source_row > 0 GROUP BY doc_id", LEDGER)

# --- repair: the clean chain, and where the faults were
CLEAN = "SELECT doc_id, source_row, {amount} AS printed_amount, {balance} AS balance, {credit} AS credit, {debit} AS debit, {state} AS row_state, {kind} AS diagnosis_kind FROM l {where}"
FIXED = {"amount": "amount", "balance": "balance", "credit": "credit", "debit": "debit", "where": ""}
sql("repair_amount", CLEAN.format(**FIXED, state="CASE WHEN hit THEN 'REPAIRED' ELSE 'CLEAN' END", kind="CASE WHEN hit THEN 'AMOUNT_CORRUPT' END"), LEDGER)
sql("repair_balance", CLEAN.format(**FIXED, state="CASE WHEN hit OR (source_row > 3 AND source_row % 7 = 4) THEN 'REPAIRED' ELSE 'CLEAN' END", kind="CASE WHEN hit THEN 'BALANCE_CORRUPT' END"), LEDGER)
sql("repair_missing_balance", CLEAN.format(**FIXED, state="CASE WHEN hit THEN 'REPAIRED' ELSE 'CLEAN' END", kind="CASE WHEN hit THEN 'BALANCE_MISSING' END"), LEDGER)
sql("repair_missing_amount", CLEAN.format(**FIXED, state="CASE WHEN hit THEN 'REPAIRED' ELSE 'CLEAN' END", kind="CASE WHEN hit THEN 'AMOUNT_MISSING' END"), LEDGER)
AFTER = "(source_row > 3 AND source_row % 7 = 4)"
MOVED = f"q AS (SELECT *, CAST(CASE WHEN hit THEN {slip('balance')} ELSE balance END AS DECIMAL(18,2)) AS seen FROM l), l2 AS (SELECT *, CAST(seen - coalesce(lag(seen) OVER (PARTITION BY doc_id ORDER BY source_row), 0) AS DECIMAL(18,2)) AS move FROM q)"
sql("repair_containment", f"SELECT doc_id, source_row, CAST(CASE WHEN hit THEN amount + 12345.67 ELSE amount END AS DECIMAL(18,2)) AS printed_amount, seen AS balance, CAST(greatest(move, 0) AS DECIMAL(18,2)) AS credit, CAST(greatest(-move, 0) AS DECIMAL(18,2)) AS debit, CASE WHEN hit OR {AFTER} THEN 'UNRESOLVED' ELSE 'CLEAN' END AS row_state, CASE WHEN hit THEN 'AMBIGUOUS' WHEN {AFTER} THEN 'UPSTREAM_BREAK' END AS diagnosis_kind FROM l2", LEDGER, MOVED)
sql("repair_notes", f"SELECT doc_id, count(*) AS n, string_agg('row ' || source_row || ' (page ' || page_no || '): ' || CASE WHEN hit THEN 'AMBIGUOUS - ' || CASE WHEN is_last THEN 'final row disagrees and no printed closing resolves it' ELSE 'no balance value satisfies both neighbouring rows' END ELSE 'UPSTREAM_BREAK - delta unreliable: the preceding row is unresolved' END, '|' ORDER BY source_row) AS notes FROM l WHERE hit OR {AFTER} GROUP BY doc_id", LEDGER)
sql("repair_diagnoses", f"SELECT doc_id, source_row AS row_index, page_no, 'AMOUNT_CORRUPT' AS kind, 'amount ' || {slip('amount')} || ' -> ' || amount || CASE WHEN is_last THEN '; balance matches printed closing' ELSE ' from balance delta' END AS detail, true AS applied FROM l WHERE hit", LEDGER)


def plausible(seen: str, want: str) -> str:
    a, b = (f"replace(CAST(abs({v}) AS VARCHAR), '.', '')" for v in (seen, want))
    return f"({seen} IS NULL OR {a} = {b} OR ({seen} <> 0 AND (abs({seen}) * 10 = {want} OR abs({seen}) * 100 = {want} OR round_even(abs({seen}) * 0.1, 2) = {want} OR round_even(abs({seen}) * 0.01, 2) = {want})) OR (length({a}) = length({b}) AND levenshtein({a}, {b}) <= 2) OR (abs(length({a}) - length({b})) = 1 AND levenshtein({a}, {b}) <= 1))"


GAP = "q AS (SELECT *, lag(hit AND NOT is_last) OVER (PARTITION BY doc_id ORDER BY source_row) AS lost, CAST(balance - coalesce(lag(balance, 2) OVER (PARTITION BY doc_id ORDER BY source_row), 0) AS DECIMAL(18,2)) AS gap FROM l), q2 AS (SELECT *, coalesce(lost, false) AS after, CAST(CASE WHEN lost THEN gap ELSE credit - debit END AS DECIMAL(18,2)) AS move FROM q WHERE NOT hit OR is_last)"
FOUND = f"CASE WHEN after AND abs(move) <> amount THEN CASE WHEN is_last OR {plausible('amount', 'abs(move)')} THEN 'AMOUNT_CORRUPT' ELSE 'MISSING_ROW' END END"
sql("repair_dropped_row", "SELECT doc_id, source_row, CAST(CASE WHEN kind = 'AMOUNT_CORRUPT' THEN abs(move) ELSE amount END AS DECIMAL(18,2)) AS printed_amount, balance, CAST(greatest(move, 0) AS DECIMAL(18,2)) AS credit, CAST(greatest(-move, 0) AS DECIMAL(18,2)) AS debit, CASE kind WHEN 'AMOUNT_CORRUPT' THEN 'REPAIRED' WHEN 'MISSING_ROW' THEN 'UNRESOLVED' ELSE 'CLEAN' END AS row_state, kind AS diagnosis_kind FROM q3", LEDGER, GAP, f"q3 AS (SELECT *, {FOUND} AS kind FROM q2)")
SEEN = "v AS (SELECT k, amount, CAST(CASE k % 5 WHEN 0 THEN amount * 10 WHEN 1 THEN amount + 1 WHEN 2 THEN amount + 7654.32 WHEN 3 THEN amount END AS DECIMAL(18,2)) AS seen FROM l)"
sql("plausible_readings", f"SELECT k, {plausible('seen', 'amount')} AS plausible FROM v", LEDGER, SEEN)

# --- money
GLYPHED = f"m AS (SELECT k, amount, k % 8 AS m, {indian('amount')} AS t FROM l)"
sql("parse_amounts", """SELECT k, CAST(CASE m WHEN 4 THEN -amount WHEN 7 THEN NULL ELSE amount END AS DECIMAL(18,2)) AS value, CASE m WHEN 1 THEN 'CR' WHEN 2 THEN 'DR' WHEN 6 THEN 'DR' END AS sign_hint,
 CASE WHEN m = 3 THEN length(regexp_replace(t, '[^015]', '', 'g')) ELSE 0 END AS repairs, true AS grouping_ok, true AS has_paise, CASE WHEN m = 7 THEN 'no numeric content' ELSE '' END AS note, m = 3 AND length(regexp_replace(t, '[^015]', '', 'g')) > 0 AS suspect FROM m""", LEDGER, GLYPHED)
SQL["parse_amounts"] = SQL["parse_amounts"]
sql("format_amounts", f"SELECT k, CASE WHEN balance < 0 THEN '-' ELSE '' END || {indian('abs(balance)')} AS indian, {printed('balance')} AS drcr, CASE WHEN k % 4 > 0 AND balance <> 0 THEN CASE WHEN balance < 0 THEN '-' ELSE '' END || {indian('abs(balance)')} ELSE '' END AS blank, replace(CAST(abs(balance) AS VARCHAR), '.', '') AS digits FROM l", LEDGER)
sql("signed_amounts", "SELECT k, CAST(CASE WHEN k % 3 = 0 THEN -amount ELSE amount END AS DECIMAL(18,2)) AS signed, CAST(CASE WHEN k % 3 = 0 OR (k % 3 = 2 AND k % 2 = 0) THEN -amount ELSE amount END AS DECIMAL(18,2)) AS header_total FROM l", LEDGER)
sql("money_tokens", f"""SELECT doc_id, page_no, CAST(source_row % 20 + 10 AS INTEGER) AS line_no, CAST(2 AS BIGINT) AS n, {indian('amount')} || '|' || {indian('abs(balance)')} AS tokens FROM x
 UNION ALL SELECT doc_id, page_no, n.i, CAST(0 AS BIGINT), '' FROM p, (VALUES (1), (2), (40)) n(i)
 UNION ALL SELECT doc_id, page_no, 41, CAST(1 AS BIGINT), {indian('credit')} FROM p UNION ALL SELECT doc_id, page_no, 42, CAST(1 AS BIGINT), {indian('debit')} FROM p
 UNION ALL SELECT doc_id, page_no, 43, CAST(1 AS BIGINT), {indian('abs(balance)')} FROM p WHERE final""", LEDGER, TEXT, LINES)
sql("round_half_even", "SELECT CAST(sum(round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.1, 2)) AS DECIMAL(18,2)) AS tenths, count(*) AS n FROM lineitem")

# --- text
sql("canon_text", f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, {canon('text')} AS c FROM documents)")
TOKENS = f"k2 AS (SELECT k, list_filter(regexp_split_to_array(narration, '[^0-9A-Za-z]+'), lambda z: z <> '') AS ts FROM x), k3 AS (SELECT k, list_filter(ts, lambda z: regexp_full_match(z, '\\d+')) AS numbers, list_filter(ts, lambda z: NOT regexp_full_match(z, '\\d+') AND length(z) >= 6 AND 2 * length(regexp_replace(z, '\\D', '', 'g')) > length(z)) AS refs, ts FROM k2)"
sql("narration_tokens", f"SELECT k, array_to_string(list_filter(list_transform(list_filter(ts, lambda z: NOT list_contains(numbers, z) AND NOT list_contains(refs, z)), lambda z: {canon('z')}), lambda z: z <> ''), ' ') AS words, array_to_string(numbers, ' ') AS numbers, array_to_string(refs, ' ') AS \"references\" FROM k3", LEDGER, TEXT, TOKENS)
sql("holder_names", "SELECT DISTINCT doc_id, ['Asha Bora', 'Kiran Doli', 'Meena Sahu', 'Tarun Gogoi'][doc_id % 4 + 1] AS shown, ['asha bora', 'klran doll', 'meena sahu', 'tarun gogol'][doc_id % 4 + 1] AS words FROM l", LEDGER)

# --- lines
sql("line_kinds", "SELECT doc_id, page_no, line_no, kind, label, source_row FROM tn", LEDGER, TEXT, LINES)
sql("damaged_line_kinds", "SELECT doc_id, page_no, line_no, kind, CASE WHEN line_no = 40 THEN 'separator glyphs only' WHEN line_no = 2 THEN 'header tokens, no money' WHEN kind = 'TRANSACTION' THEN '' ELSE 'canonical match' END AS reason FROM tn", LEDGER, TEXT, LINES)
sql("extract_fields", f"""SELECT doc_id, page_no, CAST(source_row % 20 + 10 AS INTEGER) AS line_no, CAST(date AS VARCHAR) AS dates, amount || '|' || abs(balance) AS amounts, CASE WHEN t = 5 THEN number ELSE '' END AS instrument, {NARRATION} AS narration,
 CASE WHEN balance < 0 THEN 'DR' ELSE 'CR' END AS balance_marker FROM x
 UNION ALL SELECT doc_id, page_no, 1, '', '', '', 'Service Outlet : 0042 Page no. ' || page_no, NULL FROM p
 UNION ALL SELECT doc_id, page_no, 2, '', '', '', 'Date Particulars Chq No Withdrawal Deposit Balance', NULL FROM p
 UNION ALL SELECT doc_id, page_no, 40, '', '', '', '', NULL FROM p
 UNION ALL SELECT doc_id, page_no, 41, '', CAST(credit AS VARCHAR), '', 'Page Total Credit', NULL FROM p
 UNION ALL SELECT doc_id, page_no, 42, '', CAST(debit AS VARCHAR), '', 'Page Total Debit', NULL FROM p
 UNION ALL SELECT doc_id, page_no, 43, '', CAST(abs(balance) AS VARCHAR), '', 'Carried Forward', CASE WHEN balance < 0 THEN 'DR' ELSE 'CR' END FROM p WHERE final""", LEDGER, TEXT, LINES)
sql("build_rows", f"SELECT x.doc_id, x.page_no, tn.source_row, date, CASE WHEN t = 5 THEN number ELSE '' END AS instrument_no, {NARRATION} AS narration, amount AS printed_amount, balance, {indian('amount')} AS raw_amount_text, {indian('abs(balance)')} AS raw_balance_text, CAST(100.0 - line_no % 7 AS DOUBLE) AS ocr_confidence FROM x JOIN tn ON x.doc_id = tn.doc_id AND x.page_no = tn.page_no AND line_no = x.source_row % 20 + 10", LEDGER, TEXT, LINES)
sql("line_anchors", "SELECT doc_id, page_no, 'PAGE_TOTAL_CREDIT' AS kind, credit AS value, CAST(NULL AS VARCHAR) AS marker FROM p UNION ALL SELECT doc_id, page_no, 'PAGE_TOTAL_DEBIT', debit, NULL FROM p UNION ALL SELECT doc_id, page_no, 'CF_BALANCE', CAST(abs(balance) AS DECIMAL(18,2)), CASE WHEN balance < 0 THEN 'DR' ELSE 'CR' END FROM p WHERE final", LEDGER, TEXT, LINES)
sql("page_diagnostics", "SELECT doc_id, page_no, CAST(page_no AS VARCHAR) AS printed_pages, count(*) AS lines, count(*) FILTER (kind = 'TRANSACTION') AS rows, CAST(0 AS BIGINT) AS unparsed_lines, round(avg(100.0 - line_no % 7), 1) AS mean_confidence FROM tn GROUP BY doc_id, page_no", LEDGER, TEXT, LINES)
sql("limits_cut", "SELECT doc_id, page_no, n_rows + CASE WHEN doc_id % 2 = 1 THEN 1 ELSE CASE WHEN n_rows + 2 > 0.6 * (n_rows + 6 + CASE WHEN final THEN 1 ELSE 0 END) THEN 0 ELSE 1 END END AS n_rows, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE CASE WHEN n_rows + 2 > 0.6 * (n_rows + 6 + CASE WHEN final THEN 1 ELSE 0 END) THEN 0 ELSE 1 END END AS late FROM p", LEDGER, TEXT, LINES)
CLASSED = "pc AS (SELECT doc_id % 50 AS doc_id, length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n FROM documents)"
sql("page_classes", "SELECT doc_id, count(*) AS pages, count(*) FILTER (n < 50) AS scanned, median(n) AS median_chars, CASE WHEN count(*) FILTER (n < 50) * 2 >= count(*) THEN 'SCANNED' ELSE 'DIGITAL' END AS dominant, count(*) FILTER (n < 50) > 0 AND count(*) FILTER (n < 50) < count(*) AS mixed FROM pc GROUP BY doc_id", CLASSED)
IMAGES = """im AS (SELECT *, CASE WHEN m % 6 = 0 THEN 'DIGITAL' ELSE 'SCANNED' END AS page_class, m % 11 <> 0 AS has_image, [150, 200, 240, 300, 400][m % 5 + 1] AS d, m % 4 = 1 AS turned, m % 13 <> 0 AS sized, CASE WHEN m % 7 = 0 THEN 1 ELSE 8 END AS bits, m % 3 = 0 AS rgb
 FROM (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page_no, l_orderkey * 7 + l_linenumber AS m FROM lineitem)),
iq AS (SELECT *, CASE WHEN sized THEN round_even(floor(d * 8.5) / 8.5, 1) END AS dpi_x, CASE WHEN sized THEN CAST(d AS DOUBLE) END AS dpi_y, page_class = 'SCANNED' AS scanned FROM im),
ir AS (SELECT *, least(dpi_x, dpi_y) AS dpi FROM iq),
ic AS (SELECT *, list_filter([CASE WHEN scanned AND NOT has_image THEN 'NO_IMAGE' END, CASE WHEN scanned AND has_image AND bits = 1 THEN 'BILEVEL' END, CASE WHEN scanned AND has_image AND dpi IS NULL THEN 'NO_DPI' END,
 CASE WHEN scanned AND has_image AND dpi < 200 THEN 'LOW_DPI' END, CASE WHEN scanned AND has_image AND dpi >= 200 AND dpi < 300 THEN 'MARGINAL_DPI' END, CASE WHEN scanned AND has_image AND bits > 1 AND rgb THEN 'COLOUR_SCAN' END], lambda z: z IS NOT NULL) AS codes FROM ir),
iv AS (SELECT *, CASE WHEN list_has_any(codes, ['BILEVEL', 'LOW_DPI']) THEN 2 WHEN len(codes) > 0 THEN 1 ELSE 0 END AS rank FROM ic)"""
sql("page_runs", "SELECT doc_id, page_class, min(page_no) AS first_page, max(page_no) AS last_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - row_number() OVER (PARTITION BY doc_id, page_class ORDER BY page_no) AS run FROM im WHERE page_no <= 6) GROUP BY doc_id, page_class, run", IMAGES)
sql("header_fields", "SELECT DISTINCT doc_id, CASE doc_id % 3 WHEN 0 THEN 'gramin_cc' WHEN 1 THEN 'sbi_current' END AS profile_key, CASE WHEN doc_id % 3 < 2 THEN lpad(CAST(doc_id AS VARCHAR), 11, '3') END AS account_no, CASE WHEN doc_id % 3 < 2 THEN holder END AS holder FROM l", LEDGER)
sql("first_page", "SELECT doc_id, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n, 'Service Outlet : 0042   Page no. 1' || chr(10) || 'Date  Particulars  Chq No  Withdrawal  Deposit  Balance' AS head FROM tn WHERE page_no = 1 GROUP BY doc_id", LEDGER, TEXT, LINES)
sql("opening_figures", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 12.50 WHEN doc_id % 3 = 0 THEN 0.25 - doc_id ELSE doc_id + 0.25 END AS DECIMAL(18,2)) AS opening FROM p WHERE final", LEDGER, TEXT, LINES)

# --- rules and summaries
sql("rule_first_match", "SELECT k, category, tally_ledger, contra, rule_id, needs_review FROM c", LEDGER, TEXT, RULES)
sql("rule_counts", "SELECT rule_id, count(*) AS n FROM c GROUP BY rule_id", LEDGER, TEXT, RULES)
BY_CODE = "ag AS (SELECT doc_id, category AS code, count(*) AS n, sum(credit) AS credit, sum(debit) AS debit FROM c GROUP BY doc_id, category), ev AS (SELECT doc_id, tax.* FROM (SELECT DISTINCT doc_id FROM c), tax)"
sql("category_summary", "SELECT doc_id, ord, code, description, contra, coalesce(n, 0) AS n, CAST(coalesce(credit, 0) AS DECIMAL(18,2)) AS credit, CAST(coalesce(debit, 0) AS DECIMAL(18,2)) AS debit FROM ev LEFT JOIN ag USING (doc_id, code)", LEDGER, TEXT, RULES, taxonomy(), BY_CODE)
sql("lines_to_summary", "SELECT doc_id, code, n, CAST(credit AS DECIMAL(18,2)) AS credit, CAST(debit AS DECIMAL(18,2)) AS debit FROM ag", LEDGER, TEXT, RULES, taxonomy(), BY_CODE)
SUMMED = "su AS (SELECT doc_id, count(*) AS n_rows, CAST(sum(credit) AS DECIMAL(18,2)) AS total_credit, CAST(sum(debit) AS DECIMAL(18,2)) AS total_debit, count(*) FILTER (credit > 0 OR debit > 0) AS movement_count, count(*) FILTER (needs_review) AS review_count, count(*) FILTER (contra) AS contra_count, count(*) FILTER (category = 'UNCL') AS unclassified, count(*) FILTER (NOT (credit > 0 OR debit > 0)) AS settled_count FROM c GROUP BY doc_id), le AS (SELECT doc_id, string_agg(tally_ledger, '|' ORDER BY first) AS ledgers FROM (SELECT doc_id, tally_ledger, min(source_row) AS first FROM c GROUP BY doc_id, tally_ledger) GROUP BY doc_id)"
sql("statement_summary", "SELECT * FROM su JOIN le USING (doc_id)", LEDGER, TEXT, RULES, SUMMED)
sql("category_tie", """SELECT doc_id, CAST(-sum(credit) FILTER (gone) AS DECIMAL(18,2)) AS credit_variance, CAST(-sum(debit) FILTER (gone) AS DECIMAL(18,2)) AS debit_variance, -count(*) FILTER (gone) AS movement_variance, false AS ties
 FROM (SELECT *, source_row = 0 AS gone FROM l WHERE doc_id % 3 = 0 AND n > 1) GROUP BY doc_id UNION ALL SELECT DISTINCT doc_id, 0, 0, 0, true FROM l WHERE doc_id % 3 <> 0""", LEDGER)
sql("summary_total_line", f"SELECT doc_id, CAST(39 AS BIGINT) AS n_lines, rpad('', 9, ' ') || rpad('TOTAL', 30, ' ') || lpad(CAST(n_rows AS VARCHAR), 7, ' ') || lpad({indian('total_credit')}, 18, ' ') || lpad({indian('total_debit')}, 18, ' ') AS total FROM su", LEDGER, TEXT, RULES, SUMMED)

# --- audit
sql("audit_evidence", """SELECT doc_id, pages, array_to_string(range(1, CAST(pages AS BIGINT) + 1), '|') AS printed_pages, CAST(0 AS BIGINT) AS unparsed_lines, mean_confidence, n_rows, first_date, last_date, page_total_credit, page_total_debit, 2 * pages AS page_total_count
 FROM (SELECT doc_id, count(*) AS pages, round(avg(c), 4) AS mean_confidence FROM (SELECT doc_id, page_no, round(avg(100.0 - line_no % 7), 1) AS c FROM tn GROUP BY doc_id, page_no) GROUP BY doc_id)
 JOIN (SELECT doc_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, CAST(sum(credit) AS DECIMAL(18,2)) AS page_total_credit, CAST(sum(debit) AS DECIMAL(18,2)) AS page_total_debit FROM x GROUP BY doc_id) USING (doc_id)""", LEDGER, TEXT, LINES)
sql("page_totals", "SELECT doc_id, page_no, 'PAGE_TOTAL_CREDIT' AS kind, CAST(credit + page_no % 2 AS DECIMAL(18,2)) AS printed, credit AS summed, CAST(-(page_no % 2) AS DECIMAL(18,2)) AS difference FROM p UNION ALL SELECT doc_id, page_no, 'PAGE_TOTAL_DEBIT', debit + page_no % 2, debit, -(page_no % 2) FROM p", LEDGER, TEXT, LINES)
sql("against_expected", "SELECT doc_id, 'total_credit' AS label, CAST(sum(credit) + doc_id % 2 AS DECIMAL(18,2)) AS want, CAST(sum(credit) AS DECIMAL(18,2)) AS got, CAST(-(doc_id % 2) AS DECIMAL(18,2)) AS difference, doc_id % 2 = 0 AS ok FROM l GROUP BY doc_id", LEDGER)

# --- layout
ITEMS = f"li AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS n, CAST(min(l_extendedprice) AS DECIMAL(18,2)) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber), lo AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS line_no, 'L' || n || ' ITEM ' || {indian('v')} AS text, CAST(n * 40 + doc_id % 3 AS INTEGER) AS top FROM li), pg AS (SELECT doc_id, max(n) AS last FROM li GROUP BY doc_id)"
sql("line_clusters", "SELECT doc_id, line_no, text, top, top + 24 AS bottom, 0 AS left, 550 AS right, CAST(90.0 + n AS DOUBLE) AS confidence FROM lo", ITEMS)
sql("row_bands", "SELECT doc_id, 1 AS page_no, 'row' AS axis, CAST(i - 1 AS INTEGER) AS band, CAST(i * 40 - 10 AS INTEGER) AS start, CAST(i * 40 + 30 AS INTEGER) AS \"end\" FROM pg, LATERAL (SELECT unnest(range(1, last + 1)) AS i) UNION ALL SELECT doc_id, 1, 'col', i, [0, 180, 380][i + 1], [180, 380, 600][i + 1] FROM pg, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS i)", ITEMS)
sql("band_lines", "SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no, text, n * 40 - 10 AS top, n * 40 + 30 AS bottom, 0 AS left, 550 AS right FROM lo", ITEMS)
sql("cell_texts", f"SELECT doc_id, 1 AS page_no, CAST(n - 1 AS INTEGER) AS row, i AS col, [ 'L' || n, 'ITEM', {indian('v')} ][i + 1] AS text FROM lo, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS i)", ITEMS)
sql("column_roles", "SELECT doc_id, CAST(NULL AS INTEGER) AS date, CASE WHEN count(*) >= 3 THEN '2' ELSE '' END AS money, 1 AS description, CASE WHEN count(*) >= 3 THEN 0 ELSE 2 END AS reference, false AS usable FROM lo GROUP BY doc_id", ITEMS)
sql("numeric_bands", "SELECT doc_id, 1 AS page_no, 223 AS band_left, 574 AS band_right FROM lo GROUP BY doc_id HAVING count(*) >= 5", ITEMS)
sql("overlaid_lines", "SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN 'L' || n || ' ITEM 9,99,999.99' ELSE text END AS text, CAST(CASE WHEN line_no % 2 = 0 THEN greatest(99.5, 90.0 + n) ELSE 90.0 + n END AS DOUBLE) AS confidence FROM lo", ITEMS)
sql("rule_peaks", "SELECT doc_id, 1 AS page_no, 'row' AS axis, CAST(i * 40 - 9 AS INTEGER) AS pos FROM pg, LATERAL (SELECT unnest(range(1, last + 2)) AS i) UNION ALL SELECT doc_id, 1, 'col', CAST(i + 1 AS INTEGER) FROM pg, (SELECT unnest([0, 180, 380, 600]) AS i)", ITEMS)
sql("row_pitches", "SELECT doc_id, 1 AS page_no, CAST(20 AS DOUBLE) AS pitch FROM pg", ITEMS)

# --- capture quality
sql("capture_findings", "SELECT doc_id, page_no, CASE WHEN turned THEN dpi_x ELSE dpi_x END AS dpi_x, dpi_y, rank, array_to_string(codes, '|') AS codes FROM iv", IMAGES)
sql("document_verdicts", """SELECT doc_id, ['PASS', 'WARN', 'REJECT'][r + 1] AS verdict, dpi, mixed, CASE WHEN r = 0 THEN 'Capture quality is good enough to process.' WHEN list_contains(cs, 'BILEVEL') THEN 'Scanned in black-and-white. Rescan in greyscale at 300 DPI.'
 WHEN list_contains(cs, 'LOW_DPI') THEN 'Scanned at ' || CASE WHEN dpi IS NULL THEN 'too low a resolution' ELSE CAST(round_even(dpi, 0) AS BIGINT) || ' DPI' END || '. Rescan at 300 DPI greyscale.' WHEN list_contains(cs, 'MARGINAL_DPI') THEN 'Below the 300 DPI target — expect more rows to need checking.'
 ELSE 'Capture quality is usable but flawed; see the findings.' END AS summary
 FROM (SELECT doc_id, max(rank) AS r, median(CASE WHEN scanned THEN dpi END) AS dpi, count(DISTINCT page_class) > 1 AS mixed, flatten(list(codes)) AS cs FROM iv GROUP BY doc_id)""", IMAGES)
#: Findings of pages, one by one: place (page and order), code, verdict and detail.
EACH = """ie AS (SELECT doc_id, page_no, page_no * 100 + list_position(codes, code) AS place, code, CASE WHEN code IN ('BILEVEL', 'LOW_DPI') THEN 'REJECT' ELSE 'WARN' END AS verdict, CASE code WHEN 'NO_IMAGE' THEN 'page has neither a text layer nor a scanned image'
 WHEN 'BILEVEL' THEN 'captured as 1-bit black-and-white' WHEN 'NO_DPI' THEN 'resolution could not be determined from the page structure' WHEN 'LOW_DPI' THEN 'scanned at ' || CAST(round_even(dpi, 0) AS BIGINT) || ' DPI, below the 200 DPI floor'
 WHEN 'MARGINAL_DPI' THEN 'scanned at ' || CAST(round_even(dpi, 0) AS BIGINT) || ' DPI, under the 300 DPI target' ELSE 'captured in colour (DeviceRGB)' || CASE WHEN m % 2 = 0 THEN ', JPEG-compressed' ELSE '' END END AS detail
 FROM (SELECT *, unnest(codes) AS code FROM iv)),
ig AS (SELECT doc_id, code, verdict, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(place)) AS INTEGER) AS ord, arg_min(detail, place) AS detail, arg_max(detail, place) AS last_detail, list(page_no ORDER BY page_no) AS ps FROM ie GROUP BY doc_id, code, verdict)"""
sql("findings_by_code", "SELECT doc_id, ord, code, detail, array_to_string(list_slice(ps, 1, 6), '|') AS pages, CAST(greatest(len(ps) - 6, 0) AS INTEGER) AS more FROM ig", IMAGES, EACH)
sql("quality_view", "SELECT doc_id, ord, code, verdict, last_detail AS detail FROM ig", IMAGES, EACH)
sql("quality_text", """SELECT doc_id, array_to_string(list_filter(['Quality gate - ' || doc_id, repeat('=', 64), rpad('verdict', 22, ' ') || verdict, rpad('', 22, ' ') || summary, '', 'PAGES', rpad('  pages', 22, ' ') || n, rpad('  scanned / digital', 22, ' ') || s || ' / ' || (n - s),
 CASE WHEN mixed THEN '  -> mixed: capture checks apply to scanned pages only' END, CASE WHEN dpi IS NOT NULL THEN rpad('  effective DPI', 22, ' ') || CAST(round_even(dpi, 0) AS BIGINT) || ' (median over scanned pages)' WHEN s = 0 THEN rpad('  effective DPI', 22, ' ') || 'n/a - a text layer, nothing was scanned' END,
 '', 'FINDINGS', coalesce(found, '  none')], lambda z: z IS NOT NULL), chr(10)) AS report FROM dv JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (scanned) AS s FROM iv GROUP BY doc_id) USING (doc_id)
 LEFT JOIN (SELECT doc_id, string_agg('  [' || verdict || '] ' || code || '  pages ' || array_to_string(list_slice(ps, 1, 6), ', ') || CASE WHEN len(ps) > 6 THEN ', ... (+' || (len(ps) - 6) || ' more)' ELSE '' END || chr(10) || repeat(' ', 8) || detail, chr(10) ORDER BY ord) AS found FROM ig GROUP BY doc_id) USING (doc_id)""", IMAGES, EACH, f"dv AS ({SQL['document_verdicts'].split(IMAGES, 1)[1]})")
sql("measured_findings", "SELECT doc_id, page_no, greatest(rank, CASE WHEN extra > 0 THEN 1 ELSE 0 END) AS rank, CAST(len(codes) + extra AS BIGINT) AS n FROM (SELECT *, CASE WHEN abs((doc_id % 7 - 3) / 1.5) > 1.5 THEN 1 ELSE 0 END + CASE WHEN (page_no % 4) / 5.0 < 0.35 THEN 1 ELSE 0 END AS extra FROM iv)", IMAGES)
sql("sampled_pages", "SELECT doc_id, page_no FROM (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM im WHERE page_class = 'SCANNED') WHERE n <= 3 OR i = 0 OR i = n - 1 OR i = CAST(round_even((n - 1) / 2.0, 0) AS BIGINT)", IMAGES)
sql("largest_images", "SELECT l_orderkey AS doc_id, 1 AS page_no, CAST(max(CAST(l_quantity AS INTEGER) * 100000 + l_partkey) AS INTEGER) AS src_w, 3 AS src_h FROM (SELECT l_orderkey, l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")

# --- jobs
EVENTS = """e0 AS (SELECT user_id AS job_id, event_id, ts AS "at", CAST(event_id % 7 AS INTEGER) AS m, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
e AS (SELECT job_id, seq, "at", CASE WHEN seq = 1 THEN 'QUEUED' ELSE CASE m WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'NEEDS_HEADER' WHEN 2 THEN 'QUEUED' WHEN 3 THEN 'PARSED' WHEN 4 THEN 'FAILED' END END AS state,
 CASE WHEN m = 1 THEN 'PARSE' WHEN seq = 1 THEN 'HEADER' END AS stage, CASE WHEN m = 0 THEN 'w' || event_id % 3 END AS claimed_by, CASE WHEN m = 5 THEN CAST(floor(value) AS INTEGER) END AS progress_done FROM e0),
j AS (SELECT job_id, min("at") AS created_at, arg_max("at", seq) AS updated_at, count(*) AS n_events, arg_max(state, seq) FILTER (state IS NOT NULL) AS state, arg_max(stage, seq) FILTER (stage IS NOT NULL) AS stage,
 arg_max(claimed_by, seq) FILTER (claimed_by IS NOT NULL) AS claimed_by, arg_max(progress_done, seq) FILTER (progress_done IS NOT NULL) AS progress_done FROM e GROUP BY job_id)"""
sql("job_latest_state", "SELECT * FROM j", EVENTS)
sql("job_illegal_moves", "SELECT job_id, seq, before, state FROM (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM e WHERE state IS NOT NULL) WHERE coalesce(before, '') || '>' || state NOT IN ('>QUEUED', '>REJECTED', 'QUEUED>RUNNING', 'RUNNING>QUEUED', 'RUNNING>NEEDS_HEADER', 'RUNNING>PARSED', 'RUNNING>FAILED', 'NEEDS_HEADER>QUEUED', 'REJECTED>QUEUED')", EVENTS)
sql("job_queue_page", "SELECT job_id, state FROM j ORDER BY created_at DESC, job_id DESC LIMIT 20 OFFSET 10", EVENTS)
sql("job_claim", "SELECT job_id, created_at FROM j WHERE state = 'QUEUED' ORDER BY created_at, job_id LIMIT 3", EVENTS)
sql("job_stale", "SELECT job_id, n_events + 1 AS seq, 'QUEUED' AS state FROM j WHERE state = 'RUNNING' AND updated_at < TIMESTAMP '2025-01-01 00:00:00' - INTERVAL 3600 SECOND", EVENTS)
sql("job_counts", "SELECT state, count(*) AS n FROM j GROUP BY state", EVENTS)
sql("job_overrides", "SELECT job_id, n_events + 1 AS seq, 'QUEUED' AS state, 'scan is legible' AS reason FROM j WHERE job_id % 3 = 0 AND job_id % 2 = 0 AND job_id % 5 <> 0", EVENTS)
sql("audit_log_recent", "SELECT event_id AS id, user_id AS job_id, event_type AS action FROM events ORDER BY event_id DESC LIMIT 25")
sql("audit_log_of_job", "SELECT event_id AS id, user_id AS job_id, event_type AS action FROM events WHERE user_id = 8 ORDER BY id")

# --- records
PAYLOAD = """'{"narration":"' || narration || '","credit":"' || credit || '","debit":"' || debit || '","balance":"' || balance || '","date":"' || date || '"}'"""
sql("job_rows_page", f"SELECT doc_id AS job_id, source_row AS idx, {PAYLOAD} AS payload FROM x WHERE doc_id = 17 ORDER BY source_row LIMIT 5 OFFSET 2", LEDGER, TEXT)
sql("frame_records", """SELECT doc_id, date, CAST(NULL AS DATE) AS value_date, '' AS instrument_no, narration, debit, credit, balance, page_no, source_row, category, tally_ledger, contra, rule_id, needs_review,
 '' AS raw_amount_text, '' AS raw_balance_text, CAST(0 AS DOUBLE) AS ocr_confidence, 'CLEAN' AS row_state, '' AS repair_note FROM c""", LEDGER, TEXT, RULES)
sql("transport_records", """SELECT doc_id AS job_id, source_row AS idx, '{"date":"' || date || '","narration":"' || narration || '","debit":"' || debit || '","credit":"' || credit || '","balance":"' || balance || '","page_no":' || page_no || ',"contra":' || contra || '}' AS payload FROM c""", LEDGER, TEXT, RULES)
sql("created_jobs", "SELECT sha256(text) AS job_id, 'QUEUED' AS state, 'HEADER' AS stage, count(*) AS n FROM documents GROUP BY text")

# --- readers and statements of both kinds
PLACED = f"""pw AS (SELECT doc_id, 1 AS page_no, n, i, 200 * i AS "left", CAST(n * 40 + doc_id % 3 + 2 * i AS INTEGER) AS top, ['L' || n, 'ITEM', {indian('v')}][i + 1] AS text FROM lo, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS i))"""
WHITE = "regexp_replace(text, '[^0-9.,\\-/]', '', 'g')"
sql("text_layer_words", 'SELECT doc_id, page_no, text, "left", top, 150 AS width, 20 AS height, CAST(100 AS DOUBLE) AS confidence FROM pw', ITEMS, PLACED)
sql("polygon_words", 'SELECT doc_id, page_no, text, "left", top, 150 AS width, 20 AS height, CAST(90 + n AS DOUBLE) AS confidence FROM pw WHERE NOT (doc_id % 3 = 0 AND i = 1)', ITEMS, PLACED)
sql("numeric_words", f"""SELECT doc_id, page_no, {WHITE} AS text, "left", top FROM pw WHERE i <> 1""", ITEMS, PLACED)
REGION = """SELECT doc_id, page_no, 'upper right' AS region, string_agg({text}, ' ' ORDER BY top, "left") AS text FROM pw WHERE i > 0 AND top + 10 < 110 {where} GROUP BY doc_id, page_no"""
sql("region_texts", REGION.format(text="text", where=""), ITEMS, PLACED)
sql("region_numbers", REGION.format(text=WHITE, where="AND i = 2"), ITEMS, PLACED)
sql("raster_page_counts", "SELECT doc_id, count(*) AS pages, max(page_no) AS last_page FROM im GROUP BY doc_id", IMAGES)
sql("flattened_names", "SELECT doc_id, page_no, CASE WHEN page_no % 3 < 2 THEN CASE WHEN m % 2 = 0 THEN 'DCTDecode' ELSE 'FlateDecode' END END AS codec FROM im", IMAGES)
sql("routed_rows", f"""SELECT x.doc_id, x.page_no, tn.source_row, CASE WHEN x.page_no % 2 = 1 THEN replace({NARRATION}, 'TOWN', 'TOVN') ELSE {NARRATION} END AS narration, amount AS printed_amount, balance,
 CASE WHEN x.page_no % 2 = 1 THEN CAST(50 AS DOUBLE) ELSE CAST(100.0 - line_no % 7 AS DOUBLE) END AS ocr_confidence FROM x JOIN tn ON x.doc_id = tn.doc_id AND x.page_no = tn.page_no AND line_no = x.source_row % 20 + 10""", LEDGER, TEXT, LINES)
sql("routed_pages", "SELECT doc_id, page_no, CASE WHEN page_no % 2 = 0 THEN 'DIGITAL' ELSE 'SCANNED' END AS page_class, count(*) AS lines, count(*) FILTER (kind = 'TRANSACTION') AS rows, CASE WHEN page_no % 2 = 0 THEN round(avg(100.0 - line_no % 7), 1) ELSE 50.0 END AS mean_confidence FROM tn WHERE page_no <= 2 GROUP BY doc_id, page_no", LEDGER, TEXT, LINES)
sql("scanned_page_lines", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(n - 1 AS INTEGER) ELSE line_no END AS line_no, text, CASE WHEN doc_id % 2 = 0 THEN CAST(n * 40 - 10 AS INTEGER) ELSE top END AS top,
 CASE WHEN lines >= 5 THEN 99.5 ELSE CAST(90.0 + n AS DOUBLE) END AS confidence FROM lo JOIN (SELECT doc_id, count(*) AS lines FROM lo GROUP BY doc_id) USING (doc_id)""", ITEMS)
sql("profile_line_kinds", "SELECT doc_id, page_no, line_no, kind, label FROM tn UNION ALL SELECT doc_id, page_no, 5, 'HEADER_REPEAT', 'HEADER' FROM p", LEDGER, TEXT, LINES)

# --- positional joins, packs, reports, views
sql("row_movements", "SELECT doc_id, source_row, credit, debit, category, rule_id FROM c", LEDGER, TEXT, RULES)


def pack() -> str:
    from ..operators.rules import DEFAULT_PACK
    from ..functions.text import canon_of

    return ", ".join(f"({i}, '{r.id}', '{r.category}', '{' '.join(map(canon_of, r.words))}', '{r.direction}', {str(r.review).lower()})" for i, r in enumerate(DEFAULT_PACK))


sql("pack_rows", f"SELECT CAST(priority AS INTEGER) AS priority, id, category, words, direction, review FROM (VALUES {pack()}) AS t(priority, id, category, words, direction, review)")
sql("chain_text", f"""SELECT doc_id, array_to_string(list_filter(['opening        0.00 Cr', 'total credits  ' || {indian('c')} || '  (' || cn || ')', 'total debits   ' || {indian('d')} || '  (' || dn || ')', 'closing (calc) ' || {printed('b')},
 CASE WHEN doc_id % 4 > 0 THEN 'closing (print)' || {printed('e')} END, CASE WHEN doc_id % 4 > 0 THEN 'variance       ' || CASE WHEN doc_id % 2 = 1 THEN '-1.00' ELSE '0.00' END END, 'repaired ' || hits || '   unresolved 0'], lambda z: z IS NOT NULL), chr(10)) AS report
 FROM (SELECT *, CAST(b + doc_id % 2 AS DECIMAL(18,2)) AS e FROM (SELECT doc_id, CAST(sum(credit) AS DECIMAL(18,2)) AS c, CAST(sum(debit) AS DECIMAL(18,2)) AS d, CAST(sum(credit - debit) AS DECIMAL(18,2)) AS b, count(*) FILTER (credit > 0) AS cn, count(*) FILTER (debit > 0) AS dn, count(*) FILTER (hit) AS hits FROM l GROUP BY doc_id))""", LEDGER)
sql("job_lookup", "SELECT job_id, state, n_events FROM j WHERE job_id = 8", EVENTS)
sql("job_view", "SELECT job_id, CAST(NULL AS VARCHAR) AS filename, state, stage, progress_done, CAST(NULL AS VARCHAR) AS row_count FROM j", EVENTS)
sql("job_queue_total", "SELECT count(*) AS total FROM j WHERE state = 'QUEUED'", EVENTS)
sql("job_rows_decoded", "SELECT doc_id AS job_id, source_row AS idx, narration, credit, balance, date, CAST(n AS BIGINT) AS total FROM x WHERE doc_id = 17 ORDER BY source_row LIMIT 5 OFFSET 2", LEDGER, TEXT)
sql("job_intake", """SELECT o_orderkey AS job_id, status, CASE WHEN status = 201 THEN CASE WHEN verdict = 'REJECT' THEN 'REJECTED' ELSE 'QUEUED' END END AS state, CASE WHEN status = 201 AND verdict <> 'REJECT' THEN 'HEADER' END AS stage,
 CASE status WHEN 201 THEN summary WHEN 415 THEN 'only PDF statements are accepted' ELSE 'could not read the PDF' END AS message
 FROM (SELECT *, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 415 WHEN verdict IS NULL THEN 422 ELSE 201 END AS INTEGER) AS status FROM orders LEFT JOIN (SELECT * FROM dv WHERE doc_id % 10 <> 3) ON doc_id = o_orderkey)""", IMAGES, f"dv AS ({SQL['document_verdicts'].split(IMAGES, 1)[1]})")
sql("override_log", "SELECT job_id, job_id % 2 = 0 AND job_id % 5 <> 0 AS overridden, CASE WHEN job_id % 2 = 0 AND job_id % 5 <> 0 THEN 'state=' || coalesce(state, 'none') END AS detail FROM j", EVENTS)


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def corpus() -> str:
    """Rules with their words, and which words are hits of which rule words."""
    from ..functions.text import canon_of
    from ..operators.rules import DEFAULT_PACK

    each = [(i, r.id, [canon_of(w) for w in r.words], r.direction, bool(r.predicate)) for i, r in enumerate(DEFAULT_PACK)]
    seen = sorted({w for _, _, ws, _, _ in each for w in ws})
    hit = lambda w, r: w == r or len(r) >= 6 and w.startswith(r) or len(r) >= 5 and 200 * common(w, r) >= 85 * (len(w) + len(r))
    rows = ", ".join(f"({i}, '{n}', {ws}::VARCHAR[], '{d}', {str(p).lower()})" for i, n, ws, d, p in each)
    hits = ", ".join(f"('{w}', '{r}')" for w in [*seen, "wobble"] for r in seen if hit(w, r))
    return f"ru(priority, id, words, direction, shaped) AS (VALUES {rows}), hi(word, rule_word) AS (VALUES {hits})"


sql("rule_corpus", f"""SELECT k, arg_min(id, priority) FILTER (fits) AS rule_id FROM (SELECT o.k, ru.id, ru.priority, NOT ru.shaped AND (ru.direction = 'EITHER' OR ru.direction = side) AND list_has_all(hits, ru.words) AS fits
 FROM (SELECT k, CASE WHEN k % 3 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS side, k % {corpus().count("', [")} AS i FROM l) o JOIN (SELECT a.priority AS i, list_distinct(list(rule_word)) AS hits FROM ru a, hi WHERE list_contains(list_append(a.words, 'wobble'), word) GROUP BY a.priority
 UNION ALL SELECT a.priority, []::VARCHAR[] FROM ru a WHERE len(a.words) = 0) USING (i), ru) GROUP BY k""", LEDGER, corpus())
