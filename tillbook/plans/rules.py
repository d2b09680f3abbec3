"""Business rules behind generated sales data: price steps, line prices, roll-ups, rosters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.columns import ColumnOrName, col
from tillbook.functions.dates import date_literal, day_of
from tillbook.functions.numbers import truncate_cents
from tillbook.operators.ordering import order_asc
from tillbook.schemas import MONEY

# First day of sales, days between price steps and size of a step, the
# surcharge per cup size, the days with unusually high sales.
FIRST_DAY = dt.date(2024, 6, 30)
STEP_DAYS = 91
STEP = "0.25"
SIZE_PRICE = "0.50"
PEAK_DAYS = (
    dt.date(2024, 8, 12),
    dt.date(2025, 6, 5),
    dt.date(2025, 4, 30),
    dt.date(2024, 12, 4),
    dt.date(2025, 7, 6),
)


def price_on(
    base: ColumnOrName, day: ColumnOrName, start: dt.date = FIRST_DAY, step_days: int = STEP_DAYS,
    step: str = STEP,
) -> Column:
    """Price on a day: one step on the first day and one more every ``step_days`` days.

    Before the first day the base price holds.
    """
    elapsed = F.datediff(col(day), date_literal(start))
    steps = F.when(elapsed < 0, F.lit(0)).otherwise(F.floor(elapsed / F.lit(step_days)).cast("int") + 1)
    return (col(base) + F.lit(step).cast(MONEY) * steps).cast(MONEY)


def flag_peak_days(orders: DataFrame, days: Sequence[dt.date] = PEAK_DAYS) -> DataFrame:
    """Orders with ``is_peak``: whether they fall on one of the given days."""
    is_peak = day_of("orderDate").isin(*[date_literal(day) for day in days]) if days else F.lit(False)
    return orders.withColumn("is_peak", is_peak)


def line_price(lines: DataFrame, menu: DataFrame, mods: DataFrame) -> DataFrame:
    """Price of each line: (menu price + add-ons + size surcharge) times quantity, cut to cents."""
    addons = mods.groupBy("orderItemID").agg(F.sum("cost").alias("_addons"))
    priced = (
        lines.select("orderItemID", "menuID", "orderSize", "quantityPurchased")
        .join(addons, "orderItemID", "left")
        .join(menu.select("menuID", "price"), "menuID")
    )
    unit = (
        F.col("price")
        + F.coalesce("_addons", F.lit(0)).cast(MONEY)
        + F.lit(SIZE_PRICE).cast(MONEY) * F.col("orderSize")
    ).cast(MONEY)
    return priced.select(
        "orderItemID", "menuID", truncate_cents(unit * F.col("quantityPurchased")).alias("linePrice")
    )


def reconcile_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders whose total differs from the sum of their lines; an order without lines sums to 0."""
    sums = lines.groupBy("orderID").agg(F.sum("priceAtPurchase").alias("_lines"))
    compared = orders.select("orderID", F.col("orderTotal").alias("header")).join(sums, "orderID", "left")
    diff = F.coalesce("header", F.lit(0)) - F.coalesce("_lines", F.lit(0))
    return compared.select(
        "orderID", "header", F.coalesce("_lines", F.lit(0)).alias("lines"), diff.alias("diff")
    ).where(F.col("diff") != 0)


def roster(day: ColumnOrName, n: int, start: dt.date = FIRST_DAY) -> Column:
    """Employee on duty: number 1 to ``n``, changing daily from the first day."""
    return F.pmod(F.datediff(col(day), date_literal(start)), F.lit(n)) + 1


def running_sales(orders: DataFrame) -> DataFrame:
    """Sales per day and the total so far.

    The window has no partition, but its input is one row per calendar day.
    """
    days = orders.groupBy(day_of("orderDate").alias("sales_day")).agg(F.sum("orderTotal").alias("daySales"))
    so_far = Window.orderBy("sales_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return order_asc(days.withColumn("totalSales", F.sum("daySales").over(so_far)), "sales_day")
