"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(value: ColumnOrName) -> Column:
    """A column from a column or a column name."""
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used.

    Branches of a CASE do not share work otherwise, and nested uses multiply.
    """
    return F.get(F.transform(F.array(value), use), 0)


def text(value: ColumnOrName) -> Column:
    """The value as text, with NULL read as empty."""
    return F.coalesce(col(value), F.lit(""))


def filled(value: ColumnOrName) -> Column:
    """The value, with empty text read as NULL."""
    return F.nullif(col(value), F.lit(""))


def first_filled(*values: ColumnOrName) -> Column:
    """The first value that is neither NULL nor empty, else empty.

    Each value is computed once, where a chain of NULLIFs computes it twice per step.
    """
    if all(isinstance(v, str) for v in values):
        return F.coalesce(*[filled(v) for v in values], F.lit(""))
    present = F.filter(F.array(*[col(v) for v in values]), lambda v: v != "")
    return F.coalesce(F.get(present, 0), F.lit(""))


def leading_int(value: ColumnOrName) -> Column:
    """The integer a text starts with (blanks and a sign allowed), else NULL."""
    digits = F.regexp_extract(col(value), r"^\s*([+-]?[0-9]+)", 1)
    return filled(digits).try_cast("int")


def contains_either_way(a: Column, b: Column) -> Column:
    """One text holds the other."""
    return F.contains(a, b) | F.contains(b, a)
