"""Text labels of the screens and reports, and their inverses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.functions.columns import ColumnOrName, col
from tillbook.schemas import MONEY

# Fixed value: names of days and months are blank-padded to this width.
NAME_WIDTH = 9


def weekday_label(ts: ColumnOrName) -> Column:
    """English day name, padded: ``'Monday   '``."""
    return F.rpad(F.date_format(ts, "EEEE"), NAME_WIDTH, " ")


def day_month_label(day: ColumnOrName) -> Column:
    """Two-digit day and padded month name: ``'28 June     '``."""
    return F.concat(F.date_format(day, "dd "), F.rpad(F.date_format(day, "MMMM"), NAME_WIDTH, " "))


def money_label(amount: ColumnOrName) -> Column:
    """``$1,234.50``; a negative amount prints as ``$-1,234.50``."""
    return F.format_string("$%,.2f", col(amount).cast("double"))


def hour_label(hour: ColumnOrName) -> Column:
    return F.format_string("%02d:00", col(hour))


def time_label(ts: ColumnOrName) -> Column:
    """Time with at least one decimal, ``2025-06-23 09:15:00.0``; a missing one is ``None``."""
    text = col(ts).cast("string")
    shown = F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))
    return F.coalesce(shown, F.lit("None"))


def items_label(count: ColumnOrName) -> Column:
    return F.format_string("Discards: %.0f items", col(count).cast("double"))


def total_label(amount: ColumnOrName) -> Column:
    return F.format_string("Total: $%.2f", col(amount).cast("double"))


def unit_label(name: ColumnOrName, unit: ColumnOrName) -> Column:
    """``name (unit)``; a missing part prints as ``null``."""
    shown = [F.coalesce(col(part), F.lit("null")) for part in (name, unit)]
    return F.concat(shown[0], F.lit(" ("), shown[1], F.lit(")"))


def line_label(name: ColumnOrName, price: ColumnOrName) -> Column:
    """Cart line: ``name - $price``."""
    return F.format_string("%s - $%.2f", col(name), col(price).cast("double"))


def label_price(label: ColumnOrName) -> Column:
    """Price after the last ``$`` of a cart line; NULL if it is no number."""
    return F.substring_index(col(label), "$", -1).try_cast(MONEY)


def trimmed(text: ColumnOrName) -> Column:
    """Text without the blanks and control characters around it."""
    return F.regexp_replace(col(text), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
