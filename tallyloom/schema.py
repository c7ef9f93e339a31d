"""Column names and types that operators agree on. Money is decimal(18,2), never a float; credit is positive."""

from __future__ import annotations

#: The emitted row, in order; the first nine are the contract with readers.
FRAME = {
    "date": "date", "value_date": "date", "instrument_no": "string", "narration": "string", "debit": "decimal(18,2)", "credit": "decimal(18,2)", "balance": "decimal(18,2)",
    "page_no": "int", "source_row": "int", "category": "string", "tally_ledger": "string", "contra": "boolean", "rule_id": "string", "needs_review": "boolean",
    "raw_amount_text": "string", "raw_balance_text": "string", "ocr_confidence": "double", "row_state": "string", "repair_note": "string",
}
CONTRACT = list(FRAME)[:9]
CLEAN, REPAIRED, UNRESOLVED = "CLEAN", "REPAIRED", "UNRESOLVED"
CREDIT, DEBIT, EITHER = "CREDIT", "DEBIT", "EITHER"
#: Fields that mean "not given" where a row lacks them.
EMPTY = {"instrument_no": "", "tally_ledger": "", "contra": False, "needs_review": False, "raw_amount_text": "", "raw_balance_text": "", "ocr_confidence": 0.0, "row_state": CLEAN, "repair_note": ""}
