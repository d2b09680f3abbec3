"""Filters as column expressions. Range filters compare the bare column with constants,
so they reach the Parquet scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.columns import ColumnOrName, col
from tillbook.functions.dates import date_literal, iso_week, month_day, timestamp_literal

ONE_DAY = dt.timedelta(days=1)


def check_range(start: dt.date | None, end: dt.date | None, ordered: bool = False) -> None:
    """Reject a missing bound and, with ``ordered``, an end before its start."""
    if start is None or end is None:
        raise ValueError("both a start and an end date are needed")
    if ordered and end < start:
        raise ValueError(f"the range ends ({end}) before it starts ({start})")


def in_category(category: ColumnOrName, value: str) -> Column:
    return col(category) == F.lit(value)


def in_window(ts: ColumnOrName, start: dt.datetime | dt.date, end: dt.datetime | dt.date) -> Column:
    """Half-open window ``[start, end)`` at timestamp grain."""
    return (col(ts) >= timestamp_literal(start)) & (col(ts) < timestamp_literal(end))


def in_day_range(ts: ColumnOrName, start: dt.date, end: dt.date) -> Column:
    """Whole days ``start`` to ``end``, both included; midnight after ``end`` is out."""
    return in_window(ts, start, end + ONE_DAY)


def in_closed_range(ts: ColumnOrName, start: dt.date, end: dt.date) -> Column:
    """Like :func:`in_day_range`, but the midnight that follows ``end`` is in as well."""
    return col(ts).between(timestamp_literal(start), timestamp_literal(end + ONE_DAY))


def on_day(ts: ColumnOrName, day: dt.date) -> Column:
    return in_day_range(ts, day, day)


def in_iso_week(ts: ColumnOrName, week: int) -> Column:
    """ISO week of any year."""
    return iso_week(ts) == F.lit(week)


def is_return(total: ColumnOrName) -> Column:
    return col(total) < 0


def is_void(total: ColumnOrName) -> Column:
    return col(total) == 0


def has_pending_restock(restock_ordered: ColumnOrName) -> Column:
    return col(restock_ordered) > 0


def is_rotation_cashier(position: ColumnOrName, employee_id: ColumnOrName, ids: Sequence[int]) -> Column:
    return (col(position) == F.lit("Cashier")) & col(employee_id).isin(*ids)


def in_season(start: ColumnOrName, end: ColumnOrName, as_of: dt.date | Column) -> Column:
    """Whether a season contains ``as_of``, by month and day only.

    A missing bound means always. A season whose end month is before its start month wraps
    over the new year. One that is reversed inside a single month never matches.
    """
    start, end = col(start), col(end)
    today = month_day(date_literal(as_of) if isinstance(as_of, dt.date) else as_of)
    after_start = today >= month_day(start)
    before_end = today <= month_day(end)
    return (
        F.when(start.isNull() | end.isNull(), F.lit(True))
        .when(F.month(end) < F.month(start), after_start | before_end)
        .otherwise(after_start & before_end)
    )


def needs_restock(quantity: ColumnOrName, minimum: ColumnOrName) -> Column:
    """'Y' at or below the minimum, else 'N'; a missing number counts as zero."""
    low = F.coalesce(col(quantity), F.lit(0)) <= F.coalesce(col(minimum), F.lit(0))
    return F.when(low, F.lit("Y")).otherwise(F.lit("N"))


def non_empty_orders(carts: DataFrame, n_lines: str = "n_lines") -> DataFrame:
    """Orders that have at least one line."""
    return carts.where(F.col(n_lines) > 0)
