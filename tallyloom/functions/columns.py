"""Small helpers over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Between the members of a constant list; no member holds it.
FENCE = "\x1f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**fields: Column) -> Column:
    """A struct with these names."""
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_or_null(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def texts(*values: str) -> Column:
    """A constant array of strings. The optimiser folds it into one literal; a plan of many single ones is slow to build."""
    if any(FENCE in v for v in values):
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit(FENCE.join(values)), FENCE) if values else F.array().cast("array<string>")
