"""Sorting, top-k and n-th row, with NULLs placed as the reports expect.

NULL is the largest value: last when ascending, first when descending. Tie keys make every
result repeatable, and let a range sort split rows that share one measure over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.sequence import number_rows


def _keys(measure: str, ties: Sequence[str], descending: bool) -> list[Column]:
    first = F.col(measure).desc_nulls_first() if descending else F.col(measure).asc_nulls_last()
    return [first, *[F.col(tie).asc_nulls_last() for tie in ties]]


def order_asc(df: DataFrame, measure: str, *ties: str) -> DataFrame:
    return df.orderBy(*_keys(measure, ties, descending=False))


def order_desc(df: DataFrame, measure: str, *ties: str) -> DataFrame:
    return df.orderBy(*_keys(measure, ties, descending=True))


def top_k(df: DataFrame, measure: str, k: int, ties: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """The first ``k`` rows by a measure; every task keeps at most ``k`` rows."""
    return df.orderBy(*_keys(measure, ties, descending)).limit(k)


_ACCURACY = 10_000


def nth_row(df: DataFrame, measure: str, n: int | Column, ties: Sequence[str] = (), few: int = 1) -> DataFrame:
    """The row at position ``n`` (from 0, a number or a one-row subquery) in ascending order; no row when ``n`` is too large.

    Found by selection: approximate quantiles around the place cut the measure into intervals, whose rows are counted exactly, and the
    search goes on in the one that holds the place, by the tie keys where all measures are equal, until ``few`` rows are left.
    Nothing is sorted or written in full, and no task gathers the rows before the n-th. Several rows that are left (equal in all keys), and
    keys other than numbers, dates and times, are numbered by a range sort over all tasks.
    """
    keys = [measure, *ties]
    place = n if isinstance(n, int) else df.sparkSession.range(1).select(n).first()[0]
    if place is None or place < 0:
        return df.limit(0)
    rows, size = df, None
    keyed = all(_has_quantiles(df.schema[key].dataType) for key in keys)
    for key in keys if keyed else ():
        rows, place, size = _narrowed(rows, key, place, few, size)
        if size <= few:
            break
    if size == 1 and place == 0:
        return rows
    return number_rows(rows, keys, "_nth").where(F.col("_nth") == place).drop("_nth")


def _has_quantiles(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _narrowed(rows: DataFrame, key: str, place: int, few: int, size: int | None) -> tuple[DataFrame, int, int]:
    """Rows that hold the row at ``place`` in the order of ``key``, its place among them, and their number: few, or all with one key.

    Each round cuts at three quantiles, of which the middle one is a value of the key: it is found, or left out for good.
    """
    kind = rows.schema[key].dataType
    value = F.col(key)
    total, known = rows.agg(F.count("*"), F.count(value)).first() if size is None else (size, None)
    while total > few:
        if known is None:
            known = rows.agg(F.count(value)).first()[0]
        if place >= known:
            return rows.where(value.isNull()), place - known, total - known
        width = 2 / _ACCURACY
        shares = [min(max(place / known + d, 0.0), 1.0) for d in (-width, 0.0, width)]
        cuts = rows.agg(F.percentile_approx(value, shares, _ACCURACY).cast("array<string>")).first()[0]
        low, middle, high = (F.lit(cut).cast(kind) for cut in cuts)
        counts = rows.agg(*[F.count_if(c) for c in (value < low, value < middle, value <= middle, value <= high)]).first()
        starts = [0, *counts]
        parts = [value < low, (value >= low) & (value < middle), value == middle, (value > middle) & (value <= high), value > high]
        at = max(i for i in range(5) if starts[i] <= place and (i == 4 or starts[i + 1] > place))
        end = starts[at + 1] if at < 4 else known
        rows, place, total = rows.where(parts[at]), place - starts[at], end - starts[at]
        if at == 2:
            break
        known = total
    return rows, place, total
