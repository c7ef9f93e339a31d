"""Text brought to the alphabet in which damaged print is matched, and narrations cut into tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, strip, texts

# Glyphs that low-resolution print interchanges, and the letters they are brought to.
CANON_FROM = "01i|!2569q8"
CANON_TO = "ollllzsgggb"
# Titles in front of names.
HONORIFICS = ("mr", "mrs", "ms", "miss", "shri", "smt", "sri", "dr", "m/s", "messrs")
HONORIFIC = r"(?i)^\s*(m/s|messrs|mrs|mr|ms|miss|shri|smt|sri|dr)\.?\s+"
#: The least length of a token that can be a reference.
REFERENCE = 6


def canon(text: Column) -> Column:
    """Lower case, interchangeable glyphs as one letter, nothing but a to z."""
    return F.regexp_replace(F.translate(F.lower(text), CANON_FROM, CANON_TO), "[^a-z]", "")


def canon_of(text: str) -> str:
    """The same of a constant."""
    return "".join(c for c in text.lower().translate(str.maketrans(CANON_FROM, CANON_TO)) if "a" <= c <= "z")


def narration(raw: Column) -> Column:
    """words, numbers and references of a narration, in order, repeated ones too."""
    tokens = F.filter(F.split(F.coalesce(raw, F.lit("")), "[^0-9A-Za-z]+"), lambda t: t != "")
    number = lambda t: t.rlike(r"^\d+$")
    reference = lambda t: ~number(t) & (F.length(t) >= REFERENCE) & (F.length(F.regexp_replace(t, r"\D", "")) * 2 > F.length(t))
    return let(
        tokens,
        lambda ts: F.struct(
            F.filter(F.transform(F.filter(ts, lambda t: ~number(t) & ~reference(t)), canon), lambda w: w != "").alias("words"),
            F.filter(ts, number).alias("numbers"),
            F.filter(ts, reference).alias("references"),
        ),
    )


def display_name(holder: Column) -> Column:
    """Without a title in front; in title case if it was all in capitals."""
    plain = strip(F.regexp_replace(strip(F.coalesce(holder, F.lit(""))), HONORIFIC, ""))

    def titled(name: Column) -> Column:
        letters = F.transform(F.split(name, ""), lambda c, i: F.when((i == 0) | ~F.substring(name, i, F.lit(1)).rlike(r"^\p{L}$"), F.upper(c)).otherwise(F.lower(c)))
        return F.when((F.upper(name) == name) & name.rlike(r"\p{L}"), F.array_join(letters, "")).otherwise(name)

    return let(plain, titled)


def name_words(holder: Column) -> Column:
    """The canonical words of a name without titles and initials."""
    titles = texts(*sorted({canon_of(t) for t in HONORIFICS}))
    return F.filter(narration(holder)["words"], lambda w: ~F.array_contains(titles, w) & (F.length(w) > 1))
