"""Roll-ups by day, and range reports from them: whole days come from the roll-up, only the edges of a range from the orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions.labels import money_label, unit_label
from tillbook.functions.numbers import round2, sum0, sum_product
from tillbook.functions.predicates import ONE_DAY, check_range, in_window
from tillbook.operators.joins import aggregate_by_attribute, sold_lines, spread_join
from tillbook.operators.ordering import order_desc, top_k
from tillbook.plans.sales import line_revenue

_SUM = "decimal(38,2)"


def day_sales(orders: DataFrame) -> DataFrame:
    """Revenue and number of orders of each day."""
    return orders.groupBy(F.to_date("orderDate").alias("day")).agg(
        F.sum("orderTotal").cast(_SUM).alias("revenue"), F.count("*").alias("orders")
    )


def day_items(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Quantity and revenue of each menu item and day, the revenue both ways (see :func:`tillbook.plans.sales.line_revenue`).

    Lines are summed for each order and item before the join, so an order with a third of all lines is a few rows in it.
    """
    return _items(lines, orders).groupBy(F.to_date("orderDate").alias("day"), "menuID").agg(*_sums())


def _measures(lines: DataFrame) -> DataFrame:
    return lines.groupBy("orderID", "menuID").agg(
        F.sum("quantityPurchased").cast(_SUM).alias("quantity"),
        line_revenue(True).cast("decimal(38,4)").alias("revenue_times_qty"),
        line_revenue(False).cast("decimal(38,4)").alias("revenue_as_is"),
    )


def _items(lines: DataFrame, orders: DataFrame) -> DataFrame:
    return _measures(lines).join(orders.select("orderID", "orderDate"), "orderID")


def _sums() -> list:
    kinds = {"quantity": _SUM, "revenue_times_qty": "decimal(38,4)", "revenue_as_is": "decimal(38,4)"}
    return [F.sum(name).cast(kind).alias(name) for name, kind in kinds.items()]


def save_rollups(lines: DataFrame, orders: DataFrame, folder: str) -> None:
    """Write both roll-ups beside a version of the tables, by day, so that a range of days skips the rest."""
    for name, rollup in (("sales", day_sales(orders)), ("items", day_items(lines, orders))):
        keys = ["day", "menuID"][: 1 + (name == "items")]
        rollup.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{folder}/{name}")


def open_rollups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/sales"), spark.read.parquet(f"{folder}/items")


def split_window(start: dt.datetime, end: dt.datetime) -> tuple[tuple[dt.date, dt.date] | None, list[tuple[dt.datetime, dt.datetime]]]:
    """``[start, end)`` as its whole days (first and last, or None) and the windows left at its edges (at most two)."""
    midnight = dt.time()
    first = start.date() if start.time() == midnight else start.date() + ONE_DAY
    last = end.date() - ONE_DAY
    if first > last:
        return None, [(start, end)] if start < end else []
    edges = [(start, dt.datetime.combine(first, midnight)), (dt.datetime.combine(end.date(), midnight), end)]
    return (first, last), [edge for edge in edges if edge[0] < edge[1]]


def _edge_orders(orders: DataFrame, edges: list[tuple[dt.datetime, dt.datetime]]) -> DataFrame | None:
    found = None
    for start, end in edges:
        part = orders.where(in_window("orderDate", start, end))
        found = part if found is None else found.unionByName(part)
    return found


def window_totals(sales: DataFrame, orders: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """As :func:`tillbook.plans.reports.window_totals`. ``orders`` are read at the edges only, and not at all for whole days."""
    days, edges = split_window(start, end)
    rows = sales.where(F.col("day").between(*days)) if days else sales.where(F.lit(False))
    rows = rows.select("revenue", "orders")
    at_edges = _edge_orders(orders, edges)
    if at_edges is not None:
        rows = rows.unionByName(at_edges.agg(F.sum("orderTotal").cast(_SUM).alias("revenue"), F.count("*").alias("orders")))
    return rows.agg(sum0("revenue").alias("totalRevenue"), F.coalesce(F.sum("orders"), F.lit(0)).alias("totalOrders"))


def _window_items(items: DataFrame, lines: DataFrame, orders: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Quantity and revenue of each menu item in the window: one row for each item and source."""
    days, edges = split_window(start, end)
    rows = items.where(F.col("day").between(*days)) if days else items.where(F.lit(False))
    rows = rows.groupBy("menuID").agg(*_sums())
    at_edges = _edge_orders(orders, edges)
    if at_edges is not None:
        rows = rows.unionByName(_measures(sold_lines(lines, at_edges)).groupBy("menuID").agg(*_sums()))
    return rows


def window_top_items(
    items: DataFrame, lines: DataFrame, menu: DataFrame, orders: DataFrame, start: dt.datetime, end: dt.datetime, k: int = 5,
    line_price_includes_qty: bool = True,
) -> DataFrame:
    """As :func:`tillbook.plans.reports.window_top_items`, with lines and orders read at the edges only."""
    sold = _window_items(items, lines, orders, start, end)
    measure = "revenue_times_qty" if line_price_includes_qty else "revenue_as_is"
    revenue = aggregate_by_attribute(sold, menu, "menuID", ["menuName"], {"totalRevenue": F.sum(measure)})
    return top_k(revenue, "totalRevenue", k, ["menuName"]).select(
        F.col("menuName").alias("itemName"), "totalRevenue", money_label("totalRevenue").alias("revenueFormatted")
    )


def ingredient_usage(
    items: DataFrame, orders: DataFrame, lines: DataFrame, recipe: DataFrame, inventory: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """As :func:`tillbook.plans.reports.ingredient_usage`: the range is closed, so of the orders the midnight after ``end`` is read."""
    check_range(start, end, ordered=True)
    midnight = dt.datetime.combine(end + ONE_DAY, dt.time())
    window = (dt.datetime.combine(start, dt.time()), midnight + dt.timedelta(microseconds=1))
    sold = _window_items(items, lines, orders, *window).groupBy("menuID").agg(F.sum("quantity").alias("quantitySold"))
    used = aggregate_by_attribute(
        spread_join(recipe, sold, ["menuID"], spread="inventoryID"), inventory, "inventoryID", ["inventoryName", "unit"],
        {"totalUsed": sum_product("menuInfoQuantity", "quantitySold")},
    )
    shown = used.select(
        F.col("inventoryName").alias("ingredient"), "unit", round2("totalUsed").alias("totalUsed"),
        unit_label("inventoryName", "unit").alias("label"),
    )
    return order_desc(shown, "totalUsed", "ingredient", "unit")
