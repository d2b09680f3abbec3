"""Date and time expressions: parts of a timestamp, day arithmetic, text to date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.functions.columns import ColumnOrName, col


def timestamp_literal(value: dt.date | dt.datetime) -> Column:
    """A zone-free timestamp constant; it folds, so comparisons reach the file scan."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time.min)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def date_literal(value: dt.date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def iso_week(ts: ColumnOrName) -> Column:
    """ISO week number, 1 to 53. The year is not part of it."""
    return F.weekofyear(ts)


def hour_of(ts: ColumnOrName) -> Column:
    return F.hour(ts)


def day_of(ts: ColumnOrName) -> Column:
    return F.to_date(ts)


def month_day(ts: ColumnOrName) -> Column:
    """Month and day as one comparable number, for example 1225 for December 25."""
    return F.month(ts) * 100 + F.dayofmonth(ts)


def add_days(day: ColumnOrName | dt.date, n: int) -> Column | dt.date:
    """``n`` days later (earlier if negative), for a plain date or for a column."""
    if isinstance(day, dt.date):
        return day + dt.timedelta(days=n)
    return F.date_add(day, n)


def usage_window(as_of: dt.date, days: int = 7) -> tuple[dt.date, dt.date]:
    """Default range of the ingredient usage report: the last ``days`` days up to ``as_of``."""
    return add_days(as_of, -days), as_of


def iso_date(text: ColumnOrName) -> Column:
    """Strict ``yyyy-MM-dd``; anything else, and days that do not exist, give NULL."""
    return F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd")).cast("date")


# The three date spellings a session date may have.
SESSION_DATE_PATTERN = r"^(\d{4})(?: (\d{2}) |/(\d{2})/|-(\d{2})-)(\d{2})$"


def normalise_date(text: ColumnOrName) -> Column:
    """Date from ``yyyy MM dd``, ``yyyy/MM/dd`` or ``yyyy-MM-dd``; NULL if blank or bad.

    Days 29 to 31 that the month lacks move back to its last day (2025-02-30 becomes
    2025-02-28), as a lenient calendar resolver does.
    """
    iso = F.regexp_replace(F.trim(text), SESSION_DATE_PATTERN, "$1-$2$3$4-$5")
    first_of_month = F.regexp_replace(iso, r"^(\d{4}-\d{2})-(29|30|31)$", "$1-01")
    day = F.coalesce(iso_date(iso), F.last_day(iso_date(first_of_month)))
    return F.when(F.year(day) > 0, day)


def parse_feed_timestamp(text: ColumnOrName) -> Column:
    """Feed timestamp in ISO spelling or as ``M/d/yyyy H:mm``; bad text fails the load."""
    raw = F.trim(text)
    us_style = F.to_timestamp_ntz(raw, F.lit("M/d/yyyy H:mm"))
    parsed = F.when(raw.contains("/"), us_style).otherwise(raw.cast("timestamp_ntz"))
    bad = F.raise_error(F.concat(F.lit("not a feed timestamp: "), raw)).cast("timestamp_ntz")
    return F.when(raw.isNull(), F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce(parsed, bad))
