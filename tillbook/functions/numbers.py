"""Exact arithmetic, number parsing and the aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


from tillbook.functions.columns import ColumnOrName, col
from tillbook.schemas import MONEY

_WIDE = T.DecimalType(38, 18)


def round2(amount: ColumnOrName) -> Column:
    """Two decimals, half away from zero. Meant for decimals, which round exactly."""
    return F.round(col(amount), 2)


def truncate_cents(amount: ColumnOrName) -> Column:
    """Two decimals, the rest cut off towards zero, as the cast to a whole number does.

    Every amount whose cents overflow that whole number is too large for money as well.
    """
    cents = (col(amount) * 100).cast("bigint").cast(T.DecimalType(18, 0))
    return (cents * F.lit("0.01").cast(T.DecimalType(3, 2))).cast(MONEY)


def to_int(text: ColumnOrName) -> Column:
    """Whole number in plain digits with an optional sign; anything else gives NULL."""
    raw = col(text)
    return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("int"))


def to_long(text: ColumnOrName) -> Column:
    """As :func:`to_int`, as wide as the tables' keys."""
    raw = col(text)
    return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("bigint"))


def to_money(text: ColumnOrName) -> Column:
    """Amount from text, to the cent; anything that is no number gives NULL."""
    return F.trim(text).try_cast(MONEY)


def sum_product(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.sum(col(a) * col(b))


def sum0(amount: ColumnOrName) -> Column:
    """Sum that is 0, not NULL, when there is nothing to add."""
    return F.coalesce(F.sum(col(amount)), F.lit(0))


def average2(total: ColumnOrName, count: ColumnOrName) -> Column:
    """Average to two decimals from an exact sum and a count, rounded once."""
    count = col(count)
    return F.round(col(total).cast(_WIDE) / F.when(count != 0, count), 2).cast(MONEY)


def avg2(amount: ColumnOrName) -> Column:
    """Average to two decimals, NULLs left out."""
    return average2(F.sum(col(amount)), F.count(col(amount)))


def sum_if(condition: Column, amount: ColumnOrName) -> Column:
    """Sum over the rows that meet a condition; 0 when none does."""
    return sum0(F.when(condition, col(amount)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def first_last(ts: ColumnOrName, first: str = "first", last: str = "last") -> tuple[Column, Column]:
    """Earliest and latest time; both NULL when there are no rows."""
    return F.min(col(ts)).alias(first), F.max(col(ts)).alias(last)
