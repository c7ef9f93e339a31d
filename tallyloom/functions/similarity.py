"""Similarity of short strings by their longest common subsequence, as JVM expressions over bit vectors.

The first argument of each is the pattern; it has at most 60 characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .money import digit_string, to_paise

LONGEST = 60


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _bits() -> Column:
    return F.array(*[F.lit(1 << i).cast("bigint") for i in range(LONGEST + 1)])


def _places(p: Column, text: Column) -> Column:
    """For each character of the text, the bits of its places in the pattern (an array of characters)."""
    zero = F.lit(0).cast("bigint")
    place = lambda c: F.aggregate(F.transform(p, lambda x, i: F.when(x == c, F.element_at(_bits(), i + 1)).otherwise(zero)), zero, lambda a, b: a.bitwiseOR(b))
    return F.transform(_chars(text), lambda c: F.when(F.array_contains(p, c), place(c)).otherwise(zero))


def _met(n: Column, places: Column) -> Column:
    """The length of the longest common subsequence: a bit for each of the pattern's n characters, cleared as it is met."""

    def run(ones: Column) -> Column:
        step = lambda v, u: F.when(u == 0, v).otherwise(let(v.bitwiseAND(u), lambda x: (v + x).bitwiseOR(v - x).bitwiseAND(ones)))
        return n - F.bit_count(F.aggregate(places, ones, step))

    return let(F.element_at(_bits(), n + 1) - F.lit(1).cast("bigint"), run)


def common(pattern: Column, text: Column) -> Column:
    """The length of the longest common subsequence."""
    return let(_chars(pattern), lambda p: _met(F.size(p), _places(p, text)))


def ratio(pattern: Column, text: Column) -> Column:
    """100 * 2 LCS / (sum of lengths); two empty strings are alike."""
    total = F.length(pattern) + F.length(text)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common(pattern, text) / total)


def partial_ratio(pattern: Column, text: Column) -> Column:
    """The best ratio of the shorter string with a window of the longer one of its length, or cut short at either end."""

    def slide(needle: Column, hay: Column) -> Column:
        n, m = F.size(needle), F.length(hay)
        size = lambda i: F.least(n, F.least(n + i - 1, m - i + 1))

        def best(places: Column) -> Column:
            scores = F.transform(F.sequence(F.lit(2) - n, m), lambda i: F.lit(200.0) * _met(n, F.slice(places, F.greatest(i, F.lit(1)), size(i))) / (n + size(i)))
            return F.array_max(scores)

        return let(_places(needle, hay), best)

    empty = (F.length(pattern) == 0) | (F.length(text) == 0)
    return F.when(empty, F.when(F.length(pattern) == F.length(text), 100.0).otherwise(0.0)).when(F.length(pattern) <= F.length(text), let(_chars(pattern), lambda p: slide(p, text))).otherwise(let(_chars(text), lambda p: slide(p, pattern)))


def letter_bits(phrase: str) -> Column:
    """For each letter from a to z, the bits of its places in a phrase."""
    return F.array(*[F.lit(sum(1 << i for i, c in enumerate(phrase) if c == letter)).cast("bigint") for letter in "abcdefghijklmnopqrstuvwxyz"])


def resembles(phrase: Column, parts: Column, bits: Column, text: Column, threshold: float) -> Column:
    """Whether the partial ratio of a phrase with a text is at least ``threshold``; both have letters from a to z only.
    ``parts``: the phrase's ``pieces`` with their places in it (text, at from 0); ``bits``: its ``letter_bits``. In a text as long as the phrase, the window that reaches the threshold holds a
    part unchanged, no further from its place than edits are allowed, so only windows around the parts found are scored."""
    n, m = F.length(phrase), F.length(text)
    edits = F.floor(F.lit(2 * (1 - threshold / 100)) * n + F.lit(1e-9)).cast("int")
    places_of = lambda part: F.filter(F.sequence(F.lit(1), m - F.length(part["text"]) + 1), lambda i: F.substring(text, i, F.length(part["text"])) == part["text"])
    starts = F.flatten(F.transform(F.filter(parts, lambda part: text.contains(part["text"])), lambda part: F.transform(places_of(part), lambda i: i - part["at"])))
    windows = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(F.greatest(i - edits, F.lit(2) - n), F.least(i + edits, m)))))
    size = lambda i: F.least(n, F.least(n + i - 1, m - i + 1))
    good = lambda places: F.exists(windows, lambda i: F.lit(200.0) * _met(n, F.slice(places, F.greatest(i, F.lit(1)), size(i))) / (n + size(i)) >= threshold)
    long = F.exists(parts, lambda part: text.contains(part["text"])) & let(F.transform(_chars(text), lambda c: F.element_at(bits, F.ascii(c) - 96)), good)
    return F.when(m >= n, long).otherwise(partial_ratio(phrase, text) >= threshold)


def pieces(phrase: str, threshold: float) -> list[str]:
    """Parts of a phrase of which any text with a partial ratio of at least ``threshold`` contains one unchanged.

    Such a window is at most (1 - threshold / 100) * 2 * length insertions and deletions away; each spoils one part."""
    parts = int((1 - threshold / 100) * 2 * len(phrase) + 1e-9) + 1
    cut = [round(i * len(phrase) / parts) for i in range(parts + 1)]
    return [phrase[a:b] for a, b in zip(cut, cut[1:]) if b > a]


def plausible(observed: Column, candidate: Column) -> Column:
    """Could ``candidate`` have been read as ``observed``: the same digits, a misplaced separator, up to two other digits
    at the same length or one digit more or less. Nothing read is no evidence against it."""
    a, b = digit_string(observed), digit_string(candidate)
    moved = F.lit(False)
    for factor in ("10", "100", "0.1", "0.01"):
        moved = moved | (to_paise(F.abs(observed) * F.lit(factor).cast("decimal(6,2)")) == F.abs(candidate))
    gap, far = F.abs(F.length(a) - F.length(b)), F.levenshtein(a, b)
    near = F.when(gap == 0, far <= 2).when(gap == 1, far <= 1).otherwise(False)
    return F.when(observed.isNull(), True).otherwise((a == b) | ((observed != 0) & moved) | near)
