"""Manager and cashier reports R1 to R14.

Every report takes its day or range as an argument; none reads the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import hour_of
from tillbook.functions.labels import hour_label, items_label, money_label, unit_label
from tillbook.functions.numbers import count_if, first_last, round2, sum0, sum_if, sum_product
from tillbook.functions.predicates import (
    ONE_DAY,
    check_range,
    has_pending_restock,
    in_category,
    in_closed_range,
    in_season,
    in_window,
    is_return,
    is_void,
    needs_restock,
    on_day,
)
from tillbook.operators.joins import aggregate_by_attribute, recipe_with_sales, sold_lines
from tillbook.operators.ordering import order_asc, order_desc, top_k
from tillbook.plans.sales import line_revenue
from tillbook.schemas import MONEY

def inventory_view(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        F.col("inventoryName").alias("Ingredient"),
        F.col("quantityAvailable").alias("Quantity"),
        F.col("unit").alias("Unit"),
    )


def order_history(orders: DataFrame, k: int = 40) -> DataFrame:
    """The latest ``k`` orders."""
    columns = ["orderID", "employeeID", "orderLocation", "orderDate", "orderTotal"]
    return top_k(orders.select(*columns), "orderDate", k, ["orderID", "employeeID", "orderTotal"]).select(
        F.col("orderID").alias("Order ID"),
        F.col("employeeID").alias("Employee ID"),
        F.col("orderLocation").alias("Location"),
        F.col("orderDate").alias("Date"),
        F.col("orderTotal").alias("Total ($)"),
    )


def employee_view(employee: DataFrame) -> DataFrame:
    """Employees without their passcodes."""
    return employee.select(
        F.col("employeeID").alias("ID"),
        F.col("employeeName").alias("Name"),
        F.col("employeePosition").alias("Position"),
    )


def menu_view(menu: DataFrame) -> DataFrame:
    shown = menu.select(
        F.col("menuID").alias("ID"),
        F.col("menuName").alias("Name"),
        F.col("category").alias("Category"),
        F.col("price").alias("Price ($)"),
        F.col("menuDescription").alias("Description"),
    )
    return order_asc(shown, "ID")


def restock_status(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        F.col("inventoryName").alias("Ingredient"),
        F.col("quantityAvailable").alias("Quantity Available"),
        F.col("restockMin").alias("Restock Min"),
        needs_restock("quantityAvailable", "restockMin").alias("Restock: Y/N"),
    )


def window_totals(orders: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Revenue (0 when empty) and number of orders in ``[start, end)``."""
    return orders.where(in_window("orderDate", start, end)).agg(
        sum0("orderTotal").alias("totalRevenue"), F.count("*").alias("totalOrders")
    )


def window_top_items(
    lines: DataFrame, menu: DataFrame, orders: DataFrame, start: dt.datetime, end: dt.datetime, k: int = 5,
    line_price_includes_qty: bool = True,
) -> DataFrame:
    """The ``k`` item names with the highest revenue in ``[start, end)``."""
    sold = sold_lines(lines, orders.where(in_window("orderDate", start, end)))
    revenue = aggregate_by_attribute(
        sold, menu, "menuID", ["menuName"], {"totalRevenue": line_revenue(line_price_includes_qty)}
    )
    return top_k(revenue, "totalRevenue", k, ["menuName"]).select(
        F.col("menuName").alias("itemName"),
        "totalRevenue",
        money_label("totalRevenue").alias("revenueFormatted"),
    )


def range_totals(orders: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """:func:`window_totals` over whole days, ``end`` included."""
    check_range(start, end)
    return window_totals(orders, start, end + ONE_DAY)


def top_items(
    lines: DataFrame, menu: DataFrame, orders: DataFrame, start: dt.date, end: dt.date, k: int = 5
) -> DataFrame:
    """:func:`window_top_items` over whole days, ``end`` included."""
    check_range(start, end)
    return window_top_items(lines, menu, orders, start, end + ONE_DAY, k)


def hourly_totals(orders: DataFrame, day: dt.date) -> DataFrame:
    return orders.where(on_day("orderDate", day)).groupBy(hour_of("orderDate").alias("hour")).agg(
        F.sum("orderTotal").alias("totalSales")
    )


def x_report_hourly(orders: DataFrame, day: dt.date) -> DataFrame:
    """Sales per hour of a day. Hours without orders are absent, returns count negative."""
    sales = order_asc(hourly_totals(orders, day), "hour")
    return sales.select(hour_label("hour").alias("hour"), "totalSales")


def grand_total(groups: DataFrame, measure: str) -> DataFrame:
    """Total of the rows of an aggregated report; 0 when it is empty."""
    return groups.agg(sum0(measure).alias(measure))


def x_report_totals(orders: DataFrame, day: dt.date) -> DataFrame:
    """Sales, returns (as a positive amount) and voids of a day, in one pass."""
    return orders.where(on_day("orderDate", day)).agg(
        sum0("orderTotal").alias("totalSales"),
        F.abs(sum_if(is_return("orderTotal"), "orderTotal")).alias("totalReturns"),
        count_if(is_void("orderTotal")).alias("voidCount"),
    )


def discards(inventory: DataFrame) -> DataFrame:
    """Pending restock amounts of all items, of any day."""
    pending = inventory.where(has_pending_restock("restockOrdered"))
    return pending.agg(sum0("restockOrdered").alias("totalDiscards")).select(
        "totalDiscards", items_label("totalDiscards").alias("label")
    )


def z_report(orders: DataFrame, day: dt.date) -> DataFrame:
    """Sales, number of orders, first and last order of a day. Adjustments are always zero."""
    zero = F.lit(0).cast(MONEY)
    return orders.where(on_day("orderDate", day)).agg(
        sum0("orderTotal").alias("totalSales"),
        F.count("orderID").alias("totalOrders"),
        *first_last("orderDate", "firstOrder", "lastOrder"),
    ).select("*", zero.alias("discounts"), zero.alias("voids"), zero.alias("serviceCharges"))


def ingredient_usage(
    orders: DataFrame, lines: DataFrame, recipe: DataFrame, inventory: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Quantity of each ingredient that the sales of a range used up.

    The range is closed: it includes the midnight after ``end``. Quantities are added up per
    menu item, then per inventory item, before the joins that follow.
    """
    check_range(start, end, ordered=True)
    in_range = orders.where(in_closed_range("orderDate", start, end))
    used = aggregate_by_attribute(
        recipe_with_sales(recipe, sold_lines(lines, in_range)), inventory, "inventoryID", ["inventoryName", "unit"],
        {"totalUsed": sum_product("menuInfoQuantity", "quantitySold")},
    )
    shown = used.select(
        F.col("inventoryName").alias("ingredient"),
        "unit",
        round2("totalUsed").alias("totalUsed"),
        unit_label("inventoryName", "unit").alias("label"),
    )
    return order_desc(shown, "totalUsed", "ingredient", "unit")


def available_menu(menu: DataFrame, category: str, as_of: dt.date) -> DataFrame:
    """Items of a category that are in season on a day."""
    offered = menu.where(in_category("category", category) & in_season("seasonalStart", "seasonalEnd", as_of))
    return offered.select("menuName", "price", "menuImage")
