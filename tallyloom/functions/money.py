"""Money figures in Indian notation: reading damaged ones, finding them in lines, printing them. All JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import MONEY, let, record, strip

# Letters that a recogniser confuses with digits, and the digits they stand for.
GLYPHS = "OoQlIi|][Ss$BZzGbgq"
DIGITS = "0001111115558226699"
# Fixed value: what may stand for a digit inside a figure.
D = r"[\dOoIlSsBbZzGgQq]"
#: A figure in a line; white space may stand for a comma. The strict form has commas only.
TOKEN = rf"(?<![0-9A-Za-z]){D}{{1,3}}(?:[,\s]{{1,2}}{D}{{2,3}})*[.,]{D}{{2}}"
STRICT = rf"(?<![0-9A-Za-z]){D}{{1,3}}(?:,{D}{{2,3}})*[.,]{D}{{2}}"
CURRENCY = r"(?i)(?:^|\s)(?:rs\.?|inr|₹)\s*"
GLUED = r"(?i)(?<=\d)\s*(DR|CR)\.?\s*$"
SPACED = r"(?i)\s*\b(dr|cr)\b\.?\s*$"
GROUPED = r"^(\d{1,3}|\d{1,2}(?:,\d{2})*,\d{3})$"
PLAIN = r"^[0-9,]*[.,][0-9]{2}\z"
#: Marks around matches while a line is taken apart; they don't occur in printed text.
OPEN, CLOSE = "\x01", "\x02"


def to_paise(c: Column) -> Column:
    """To two places, halves to even."""
    return F.bround(c, 2).cast(MONEY)


def parse_amount(raw: Column, repair: bool = True) -> Column:
    """raw, value, sign_hint, repairs, grouping_ok, has_paise, note of a printed figure.

    The paise are sought with letters that stand for digits, so that ``15,400.OO`` is 15400.00 and not 15.40."""
    return let(strip(raw), lambda text: F.when(F.coalesce(text, F.lit("")) == "", _unread(raw)).otherwise(_parsed(raw, text, repair)))


def _amount(raw, value, hint, repairs, grouping, paise, note) -> Column:
    return record(
        raw=F.coalesce(raw, F.lit("")),
        value=value.cast(MONEY),
        sign_hint=hint.cast("string"),
        repairs=repairs.cast("array<string>"),
        grouping_ok=grouping,
        has_paise=paise,
        note=note,
    )


def _unread(raw: Column) -> Column:
    return _amount(raw, F.lit(None), F.lit(None), F.array(), F.lit(True), F.lit(True), F.lit("empty"))


def _parsed(raw: Column, text: Column, repair: bool) -> Column:
    def marker(work: Column) -> Column:
        glued, spaced = F.regexp_extract(work, GLUED, 1), F.regexp_extract(work, SPACED, 1)
        return (
            F.when(glued != "", record(hint=F.upper(glued), work=F.regexp_replace(work, GLUED, "")))
            .when(spaced != "", record(hint=F.upper(spaced), work=F.regexp_replace(work, SPACED, "")))
            .otherwise(record(hint=F.lit(None).cast("string"), work=work))
        )

    def signed(m: Column) -> Column:
        work = F.replace(strip(m["work"]), F.lit(" "), F.lit(""))
        return record(hint=m["hint"], negative=work.startswith("-") | work.endswith("-"), work=F.btrim(work, F.lit("-")))

    def cut(s: Column) -> Column:
        """Debris behind the paise goes; its first letter may be all that is left of Dr or Cr."""
        kept, rest = F.regexp_extract(s["work"], rf"(?s)^(.*[.,]{D}{{2}})(.*)$", 1), F.regexp_extract(s["work"], rf"(?s)^(.*[.,]{D}{{2}})(.*)$", 2)
        debris = (rest != "") & ~rest.rlike(r"^\d+$")
        head = F.upper(F.substring(rest, 1, 1))
        hint = F.coalesce(s["hint"], F.when(debris & (head == "C"), "CR").when(debris & (head == "D"), "DR"))
        return record(hint=hint, negative=s["negative"], work=F.when(debris, kept).otherwise(s["work"]))

    def read(s: Column) -> Column:
        notes = F.transform(F.filter(F.split(s["work"], ""), lambda c: F.lit(GLYPHS).contains(c) & (c != "")), lambda c: F.concat(c, F.lit("->"), F.translate(c, GLYPHS, DIGITS)))
        work = F.translate(s["work"], GLYPHS, DIGITS) if repair else s["work"]
        return let(work, lambda w: _value(raw, w, s, notes if repair else F.array()))

    return let(strip(F.regexp_replace(text, CURRENCY, " ")), lambda w: let(marker(w), lambda m: let(signed(m), lambda s: let(cut(s), read))))


def _value(raw: Column, w: Column, s: Column, notes: Column) -> Column:
    unread = _amount(raw, F.lit(None), s["hint"], notes, F.lit(True), F.lit(True), F.lit("no numeric content"))
    tail = F.regexp_extract(w, r"[.,](\d{2})$", 1)
    whole = F.when(tail != "", F.regexp_replace(w, r"[.,]\d{2}$", "")).otherwise(w)

    def result(p: Column) -> Column:
        digits = F.translate(p["whole"], ",.", "")
        digits = F.when(digits == "", "0").otherwise(digits)
        value = F.concat(digits, F.lit("."), F.when(p["tail"] != "", p["tail"]).otherwise("00")).try_cast(MONEY)
        grouping = ~p["whole"].rlike("[,.]") | F.replace(p["whole"], F.lit("."), F.lit(",")).rlike(GROUPED)
        note = F.concat_ws("; ", F.when(p["tail"] == "", "no decimal point in source"), F.when(~grouping, "irregular grouping"))
        note = F.when(value.isNull(), "undecodable").otherwise(note)
        return _amount(raw, F.when(s["negative"], -value).otherwise(value), s["hint"], notes, grouping, p["tail"] != "", note)

    parts = record(tail=tail, whole=whole)
    return F.when(w.rlike(r"^[\d.,]+$"), let(parts, result)).otherwise(unread)


def amount_value(raw: Column) -> Column:
    """The value of ``parse_amount``. A figure of digits and commas with its paise needs none of the repairs."""
    size = F.length(raw)
    digits = F.translate(F.substring(raw, F.lit(1), size - 3), ",", "")
    plain = F.concat(F.when(digits == "", "0").otherwise(digits), F.lit("."), F.right(raw, F.lit(2))).try_cast(MONEY)
    return F.when(raw.rlike(PLAIN), plain).otherwise(parse_amount(raw)["value"])


def suspect(parsed: Column) -> Column:
    """Read, but with something amiss."""
    return (F.size(parsed["repairs"]) > 0) | ~parsed["grouping_ok"] | ~parsed["has_paise"]


def money_tokens(text: Column) -> Column:
    """The figures of a line in order: token, head (all text before it) and tail (all text behind it).

    A token with a space in it stands if it is well grouped; else its last strict figure stands for it, or nothing."""

    def piece(marked: Column) -> Column:
        parts = F.split(marked, OPEN)
        plain = lambda c: F.replace(c, F.lit(CLOSE), F.lit(""))

        def found(part: Column, i: Column) -> Column:
            token = F.substring_index(part, CLOSE, 1)
            before = plain(F.array_join(F.slice(parts, 1, i), ""))
            behind = F.concat(plain(F.substring(part, F.length(token) + 2, F.length(part))), plain(F.array_join(F.slice(parts, i + 2, F.size(parts)), "")))
            inner = let(F.regexp_replace(token, STRICT, OPEN + "$0" + CLOSE), lambda m: record(
                token=F.substring_index(F.element_at(F.split(m, OPEN), -1), CLOSE, 1),
                skip=plain(F.array_join(F.slice(F.split(m, OPEN), 1, F.size(F.split(m, OPEN)) - 1), "")),
                over=F.substring_index(m, CLOSE, -1),
                any=m.contains(OPEN),
            ))
            recut = F.when(inner["any"], record(token=inner["token"], head=F.concat(before, inner["skip"]), tail=F.concat(inner["over"], behind)))
            stands = ~token.contains(" ") | parse_amount(token)["grouping_ok"]
            return F.when(stands, record(token=token, head=before, tail=behind)).otherwise(recut)

        return F.filter(F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: found(p, i + 1)), lambda x: x.isNotNull())

    return let(F.regexp_replace(text, TOKEN, OPEN + "$0" + CLOSE), piece)


def format_indian(value: Column, blank_zero: bool = False) -> Column:
    """Lakh grouping with two places, e.g. 90,98,371.22."""
    v = to_paise(value)
    plain = F.abs(v).cast("string")
    whole, paise = F.substring_index(plain, ".", 1), F.substring_index(plain, ".", -1)
    grouped = F.when(
        F.length(whole) > 3,
        F.concat(F.regexp_replace(F.substring(whole, F.lit(1), F.length(whole) - 3), r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), F.right(whole, F.lit(3))),
    ).otherwise(whole)
    out = F.concat(F.when(v < 0, "-").otherwise(""), grouped, F.lit("."), paise)
    return F.when(v == 0, "").otherwise(out) if blank_zero else out


def format_drcr(signed: Column) -> Column:
    """A signed balance as it is printed: credit positive, debit negative, zero a credit."""
    v = to_paise(signed)
    return F.concat(format_indian(F.abs(v)), F.when(v < 0, " Dr").otherwise(" Cr"))


def signed_from_drcr(magnitude: Column, marker: Column) -> Column:
    m = F.abs(to_paise(magnitude)).cast(MONEY)
    return F.when(F.upper(F.coalesce(marker, F.lit(""))).startswith("D"), -m).otherwise(m).cast(MONEY)


def digit_string(v: Column) -> Column:
    """The digits of the magnitude, paise included."""
    return F.replace(F.abs(to_paise(v)).cast("string"), F.lit("."), F.lit(""))
