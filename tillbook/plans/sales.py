"""The sales queries Q1 to Q18. Tables in, one DataFrame out; nothing runs here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import day_of, hour_of, iso_week
from tillbook.functions.labels import day_month_label, weekday_label
from tillbook.functions.numbers import average2, round2, sum_product
from tillbook.functions.predicates import ONE_DAY, in_iso_week
from tillbook.operators.joins import (
    aggregate_by_attribute,
    orders_with_lines,
    sold_lines,
    with_employee,
)
from tillbook.operators.ordering import order_asc, order_desc, top_k


def weekly_orders(orders: DataFrame) -> DataFrame:
    """Orders per ISO week, years merged."""
    weeks = orders.groupBy(iso_week("orderDate").alias("week_number"))
    return order_asc(weeks.agg(F.count("*").alias("total_orders")), "week_number")


def hourly_sales(orders: DataFrame) -> DataFrame:
    """Orders and sales per hour of the day."""
    hours = orders.groupBy(hour_of("orderDate").alias("hour_of_day"))
    sales = hours.agg(F.count("*").alias("total_orders"), F.sum("orderTotal").alias("total_sales"))
    return order_asc(sales, "hour_of_day")


def daily_sales(orders: DataFrame, day: str = "sales_day") -> DataFrame:
    return orders.groupBy(day_of("orderDate").alias(day)).agg(F.sum("orderTotal").alias("total_sales"))


def peak_days(orders: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` days with the highest sales."""
    return top_k(daily_sales(orders), "total_sales", k, ["sales_day"])


def recipe_size(recipe: DataFrame, menu: DataFrame) -> DataFrame:
    """Number of inventory items per menu item name."""
    sizes = aggregate_by_attribute(
        recipe, menu, "menuID", ["menuName"], {"inventory_items_used": F.count("inventoryID")}
    )
    return order_desc(sizes, "inventory_items_used", "menuName")


def worst_day_top_seller(orders: DataFrame, lines: DataFrame, menu: DataFrame, week: int = 26) -> DataFrame:
    """The lowest-sales day of an ISO week and the item sold most on it.

    The day and its sales enter the second part as one scalar: a first scan of the orders finds them, and a second one gets the
    day as a time range.
    """
    week_days = daily_sales(orders.where(in_iso_week("orderDate", week)), "sale_day")
    worst = top_k(week_days, "total_sales", 1, ["sale_day"], descending=False)
    found = worst.select(F.struct("sale_day", "total_sales")).scalar()
    opening = found["sale_day"].cast("timestamp_ntz")
    that_day = orders.where((F.col("orderDate") >= opening) & (F.col("orderDate") < opening + F.lit(ONE_DAY)))
    sold = aggregate_by_attribute(
        sold_lines(lines, that_day), menu, "menuID", ["menuName"],
        {"total_quantity": F.sum("quantityPurchased")},
    )
    best = top_k(sold, "total_quantity", 1, ["menuName"])
    return best.select(
        day_month_label(found["sale_day"]).alias("lowest_sales_day"),
        found["total_sales"].alias("total_sales"),
        F.col("menuName").alias("top_seller"),
        "total_quantity",
    )


def orders_with_employee(orders: DataFrame, employee: DataFrame) -> DataFrame:
    """Every order with the employee who handled it, newest first."""
    handled = with_employee(
        orders.select("orderID", "employeeID", "orderDate", "orderTotal"),
        employee.select("employeeID", "employeeName"),
    )
    return order_desc(handled.select("orderID", "employeeName", "orderDate", "orderTotal"), "orderDate", "orderID")


def orders_per_location(orders: DataFrame, location: DataFrame) -> DataFrame:
    named = location.select(F.col("locationName").alias("orderLocation"), "locationName")
    counts = aggregate_by_attribute(
        orders, named, "orderLocation", ["locationName"], {"numOrders": F.count("orderID")}
    )
    return order_asc(counts, "locationName")


def _mods_by_line(mods: DataFrame) -> DataFrame:
    return mods.groupBy("orderItemID").agg(
        F.count("modificationID").alias("totalModifications"), F.sum("cost").alias("extraCost")
    )


def mods_per_line(lines: DataFrame, mods: DataFrame, menu: DataFrame) -> DataFrame:
    """Number and cost of the modifications of each modified line.

    Modifications are added up per line before the join. The last grouping merges lines that
    repeat a key, as far as there are any; their rows already share a partition unless the
    menu had to be shuffled in.
    """
    joined = (
        _mods_by_line(mods)
        .join(lines.select("orderItemID", "menuID"), "orderItemID")
        .join(menu.select("menuID", "menuName"), "menuID")
    )
    per_line = joined.groupBy("orderItemID", "menuName").agg(
        F.sum("totalModifications").alias("totalModifications"), F.sum("extraCost").alias("extraCost")
    )
    return order_desc(per_line, "totalModifications", "orderItemID", "menuName")


def quantity_by_item(lines: DataFrame, menu: DataFrame) -> DataFrame:
    sold = aggregate_by_attribute(
        lines, menu, "menuID", ["menuName"], {"totalPurchased": F.sum("quantityPurchased")}
    )
    return order_desc(sold, "totalPurchased", "menuName")


def avg_order_by_employee(orders: DataFrame, employee: DataFrame) -> DataFrame:
    """Employees by their average order value."""
    handled = aggregate_by_attribute(
        orders, employee, "employeeID", ["employeeName"],
        {
            "total_orders": F.count("orderID"),
            "_priced": F.count("orderTotal"),
            "_sum": F.sum("orderTotal"),
        },
    )
    averages = handled.select(
        "employeeName", "total_orders", average2("_sum", "_priced").alias("avg_order_value")
    )
    return order_desc(averages, "avg_order_value", "employeeName")


def line_revenue(line_price_includes_qty: bool = True):
    """Revenue of a line. The contract multiplies by the quantity although the price of a
    generated line includes it already; pass False to leave that factor out."""
    if line_price_includes_qty:
        return sum_product("quantityPurchased", "priceAtPurchase")
    return F.sum("priceAtPurchase")


def revenue_by_category(lines: DataFrame, menu: DataFrame, line_price_includes_qty: bool = True) -> DataFrame:
    sales = aggregate_by_attribute(
        lines, menu, "menuID", ["category"],
        {
            "items_sold": F.count("orderItemID"),
            "total_revenue": line_revenue(line_price_includes_qty),
        },
    )
    return order_desc(sales, "total_revenue", "category")


def sales_by_weekday(orders: DataFrame) -> DataFrame:
    days = orders.groupBy(weekday_label("orderDate").alias("day_of_week"))
    sales = days.agg(
        F.count("orderID").alias("total_orders"), round2(F.sum("orderTotal")).alias("total_sales")
    )
    return order_desc(sales, "total_sales", "day_of_week")


def largest_orders(orders: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest orders, chosen by the exact total and shown rounded."""
    top = top_k(orders.select("orderID", "orderDate", "orderTotal"), "orderTotal", k, ["orderID", "orderDate"])
    return top.select(
        F.col("orderID").alias("orderid"),
        F.col("orderDate").alias("orderdate"),
        round2("orderTotal").alias("ordertotal"),
    )


def addon_revenue(mods: DataFrame, inventory: DataFrame) -> DataFrame:
    """Cost times quantity of the modifications, per inventory item name."""
    revenue = aggregate_by_attribute(
        mods, inventory, "inventoryID", ["inventoryName"],
        {"total_revenue_from_addon": sum_product("cost", "modificationQuantity")},
    )
    return order_desc(revenue, "total_revenue_from_addon", "inventoryName")


def revenue_by_employee(orders: DataFrame, employee: DataFrame) -> DataFrame:
    revenue = aggregate_by_attribute(
        orders, employee, "employeeID", ["employeeName"], {"total_revenue": F.sum("orderTotal")}
    )
    return order_desc(revenue, "total_revenue", "employeeName")


def top_orders_by_lines(orders: DataFrame, lines: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` orders with the highest revenue by their lines."""
    per_order = lines.groupBy("orderID").agg(
        line_revenue().alias("order_revenue"), F.count("orderItemID").alias("num_items")
    )
    joined = orders_with_lines(orders.select("orderID", "orderDate"), per_order)
    # Orders that repeat an id and a date count as one; no further shuffle is needed for it.
    priced = joined.groupBy("orderID", "orderDate").agg(
        F.sum("order_revenue").alias("order_revenue"), F.sum("num_items").alias("num_items")
    )
    return top_k(priced, "order_revenue", k, ["orderID", "orderDate"])


def avg_items_by_employee(orders: DataFrame, lines: DataFrame, employee: DataFrame) -> DataFrame:
    """Average number of items per order, by employee: a sum per order, then an average."""
    items = lines.groupBy("orderID").agg(F.sum("quantityPurchased").alias("total_items"))
    per_order = orders.select("orderID", "employeeID").join(items, "orderID")
    handled = aggregate_by_attribute(
        per_order, employee, "employeeID", ["employeeName"],
        {"_sum": F.sum("total_items"), "_orders": F.count("total_items")},
    )
    averages = handled.select("employeeName", average2("_sum", "_orders").alias("avg_items_per_order"))
    return order_desc(averages, "avg_items_per_order", "employeeName")


def mod_revenue_by_item(lines: DataFrame, mods: DataFrame, menu: DataFrame) -> DataFrame:
    """Modification cost per menu item name; the modification quantity does not count."""
    per_line = _mods_by_line(mods).join(lines.select("orderItemID", "menuID"), "orderItemID")
    revenue = aggregate_by_attribute(
        per_line, menu, "menuID", ["menuName"], {"total_modification_revenue": F.sum("extraCost")}
    )
    return order_desc(revenue, "total_modification_revenue", "menuName")
