"""Every registered query: the library's operators over the star schema tables.

are exact inside the library; here they leave as doubles, so that two engines can be compared.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions import dates, labels, numbers, predicates
from tillbook.operators import constraints, joins, mutations, ordering
from tillbook.plans import audit, cart, load, reports, rollups, rules, sales
from tillbook.schemas import FEED_FILES, FEED_HEADERS, LOAD_ORDER, MONEY, SCHEMAS
from tillbook.sources import blocks, colocated, display, feeds, star, tables
from tillbook.sources.workspace import scratch_path
from tillbook.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

MONTH = (dt.date(1998, 1, 1), dt.date(1998, 1, 31))
DAY = dt.date(2024, 1, 10)
SEASON_DAY = dt.date(2024, 11, 20)
FIRST_DAY = dt.date(1992, 1, 1)
ROTATION = tuple(range(30))

QUERIES: dict[str, Query] = {}


def _as_doubles(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _as_doubles(build(spark, folder))

    QUERIES[build.__name__] = run
    return run


# --- Q: sales queries -------------------------------------------------------------------


@query
def q01_weekly_orders(spark, d):
    return sales.weekly_orders(star.orders(spark, d))


@query
def q02_hourly_sales(spark, d):
    return sales.hourly_sales(star.ticks(spark, d))


@query
def q03_peak_days(spark, d):
    return sales.peak_days(star.orders(spark, d))


@query
def q04_recipe_size(spark, d):
    return sales.recipe_size(star.recipe(spark, d), star.menu(spark, d))


@query
def q05_worst_day_top_seller(spark, d):
    return sales.worst_day_top_seller(star.orders(spark, d), star.lines(spark, d), star.menu(spark, d))


@query
def q06_orders_with_employee(spark, d):
    return sales.orders_with_employee(star.orders(spark, d), star.employees(spark, d))


@query
def q07_orders_per_location(spark, d):
    return sales.orders_per_location(star.located_orders(spark, d), star.locations(spark, d))


@query
def q08_mods_per_line(spark, d):
    return sales.mods_per_line(star.lines(spark, d), star.modifications(spark, d), star.menu(spark, d))


@query
def q09_quantity_by_item(spark, d):
    return sales.quantity_by_item(star.lines(spark, d), star.menu(spark, d))


@query
def q10_avg_order_by_employee(spark, d):
    return sales.avg_order_by_employee(star.orders(spark, d), star.employees(spark, d))


@query
def q11_revenue_by_category(spark, d):
    return sales.revenue_by_category(star.lines(spark, d), star.menu(spark, d))


@query
def q12_sales_by_weekday(spark, d):
    return sales.sales_by_weekday(star.orders(spark, d))


@query
def q13_largest_orders(spark, d):
    return sales.largest_orders(star.orders(spark, d), 10)


@query
def q13_largest_orders_demo(spark, d):
    return sales.largest_orders(star.orders(spark, d), 5)


@query
def q14_addon_revenue(spark, d):
    return sales.addon_revenue(star.modifications(spark, d), star.inventory(spark, d))


@query
def q15_revenue_by_employee(spark, d):
    return sales.revenue_by_employee(star.orders(spark, d), star.employees(spark, d))


@query
def q16_top_orders_by_lines(spark, d):
    return sales.top_orders_by_lines(star.orders(spark, d), star.lines(spark, d))


@query
def q17_avg_items_by_employee(spark, d):
    return sales.avg_items_by_employee(
        star.orders(spark, d), star.lines(spark, d), star.employees(spark, d)
    )


@query
def q18_mod_revenue_by_item(spark, d):
    return sales.mod_revenue_by_item(
        star.lines(spark, d), star.modifications(spark, d), star.menu(spark, d)
    )


# --- R: reports -------------------------------------------------------------------------


@query
def r01_inventory_view(spark, d):
    return reports.inventory_view(star.inventory(spark, d))


@query
def r02_order_history(spark, d):
    return reports.order_history(star.located_orders(spark, d))


@query
def r03_employee_view(spark, d):
    return reports.employee_view(star.employees(spark, d))


@query
def r04_menu_view(spark, d):
    return reports.menu_view(star.menu(spark, d))


@query
def r05_restock_status(spark, d):
    return reports.restock_status(star.inventory(spark, d))


@query
def r06_range_totals(spark, d):
    return reports.range_totals(star.orders(spark, d), *MONTH)


@query
def r07_top_items(spark, d):
    return reports.top_items(star.lines(spark, d), star.menu(spark, d), star.orders(spark, d), *MONTH)


@query
def r08_window_top_items(spark, d):
    start, end = dt.datetime(1997, 3, 1, 6, 30), dt.datetime(1997, 9, 1, 18, 0)
    return reports.window_top_items(
        star.lines(spark, d), star.menu(spark, d), star.orders(spark, d), start, end
    )


@query
def r08_window_totals(spark, d):
    return reports.window_totals(
        star.ticks(spark, d), dt.datetime(2024, 1, 10, 9, 0), dt.datetime(2024, 1, 12, 17, 0)
    )


@query
def f13_reversed_range(spark, d):
    """A range that ends before it starts is allowed where the screen allows it, and holds nothing."""
    start, end = dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 10)
    predicates.check_range(start.date(), end.date())
    return reports.window_totals(star.ticks(spark, d), start, end)


def _rollups(spark: SparkSession, lines: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    folder = scratch_path(spark, "rollups")
    rollups.save_rollups(lines, orders, folder)
    return rollups.open_rollups(spark, folder)


@query
def r08_rollup_totals(spark, d):
    """As r08_window_totals, whole days out of a roll-up."""
    orders = star.ticks(spark, d)
    found = rollups.open_rollups(spark, _saved_sales(spark, orders))[0]
    return rollups.window_totals(found, orders, dt.datetime(2024, 1, 10, 9, 0), dt.datetime(2024, 1, 12, 17, 0))


def _saved_sales(spark: SparkSession, orders: DataFrame) -> str:
    """Roll-ups of orders that have no lines."""
    folder = scratch_path(spark, "rollups")
    none = spark.createDataFrame([], SCHEMAS["orderItem"])
    rollups.save_rollups(none, orders, folder)
    return folder


@query
def r08_rollup_top_items(spark, d):
    """As r08_window_top_items, whole days out of a roll-up."""
    start, end = dt.datetime(1997, 3, 1, 6, 30), dt.datetime(1997, 9, 1, 18, 0)
    lines, orders = star.lines(spark, d), star.orders(spark, d)
    _, items = _rollups(spark, lines, orders)
    return rollups.window_top_items(items, lines, star.menu(spark, d), orders, start, end)


@query
def r13_rollup_usage(spark, d):
    """As r13_ingredient_usage, whole days out of a roll-up."""
    lines, orders = star.lines(spark, d), star.orders(spark, d)
    _, items = _rollups(spark, lines, orders)
    return rollups.ingredient_usage(
        items, orders, lines, star.recipe(spark, d), star.inventory(spark, d), *MONTH
    )


@query
def r09_x_report_hourly(spark, d):
    return reports.x_report_hourly(star.ticks(spark, d), DAY)


@query
def r10_x_report_totals(spark, d):
    return reports.x_report_totals(star.ticks(spark, d), DAY)


@query
def r11_discards(spark, d):
    return reports.discards(star.inventory(spark, d))


@query
def r12_z_report(spark, d):
    return reports.z_report(star.ticks(spark, d), DAY)


@query
def r13_ingredient_usage(spark, d):
    return reports.ingredient_usage(
        star.orders(spark, d), star.lines(spark, d), star.recipe(spark, d), star.inventory(spark, d), *MONTH
    )


@query
def r14_available_menu(spark, d):
    return reports.available_menu(star.menu(spark, d), "PROMO", SEASON_DAY)


# --- F: predicates ----------------------------------------------------------------------


@query
def f02_order_flags(spark, d):
    """F2 to F7 on every order."""
    start, end = DAY, dt.date(2024, 1, 14)
    ts = "orderDate"
    return star.ticks(spark, d).select(
        "orderID",
        predicates.in_day_range(ts, start, end).alias("in_range"),
        predicates.in_closed_range(ts, start, end).alias("in_closed_range"),
        predicates.on_day(ts, DAY).alias("on_day"),
        predicates.in_iso_week(ts, 2).alias("in_week"),
        predicates.is_return("orderTotal").alias("is_return"),
        predicates.is_void("orderTotal").alias("is_void"),
    )


@query
def f03_closed_range_orders(spark, d):
    """Orders at midnight: the closed range has one day more than the half-open one."""
    both = star.orders(spark, d).select(
        "orderID",
        "orderDate",
        predicates.in_day_range("orderDate", *MONTH).alias("in_range"),
        predicates.in_closed_range("orderDate", *MONTH).alias("in_closed_range"),
    )
    return both


@query
def f09_rotation_cashiers(spark, d):
    duty = predicates.is_rotation_cashier("employeePosition", "employeeID", ROTATION)
    return star.employees(spark, d).select("employeeID", "employeePosition", duty.alias("on_rotation"))


@query
def f10_in_season(spark, d):
    days = {"jan": dt.date(2023, 1, 1), "may": dt.date(2024, 5, 15), "nov": SEASON_DAY}
    return star.menu(spark, d).select(
        "menuID",
        predicates.in_category("category", "PROMO").alias("is_promo"),
        *[
            predicates.in_season("seasonalStart", "seasonalEnd", day).alias(f"in_season_{name}")
            for name, day in days.items()
        ],
    )


@query
def f11_stock_flags(spark, d):
    """F8 and F11 on every inventory item."""
    return star.inventory(spark, d).select(
        "inventoryID",
        predicates.has_pending_restock("restockOrdered").alias("pending"),
        predicates.needs_restock("quantityAvailable", "restockMin").alias("low"),
    )


def _login_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Each customer tries the own passcode, or the one after it if the balance is negative."""
    wrong = (F.col("c_acctbal") < 0).cast("int")
    return star.read(spark, d, "customer").select(
        F.col("c_custkey").alias("attempt_id"),
        star.position().alias("role"),
        star.passcode(wrong).alias("passcode"),
    )


@query
def f12_login_audit(spark, d):
    return audit.login_audit(_login_attempts(spark, d), star.employees(spark, d))


# --- J: joins ---------------------------------------------------------------------------


@query
def j02_orders_with_location(spark, d):
    joined = joins.with_location(star.located_orders(spark, d), star.locations(spark, d))
    return joined.select("orderID", "locationID", "locationName", "orderTotal")


@query
def j03_lines_with_menu(spark, d):
    joined = joins.with_menu(star.lines(spark, d), star.menu(spark, d))
    return joined.select("orderItemID", "menuName", "category", "quantityPurchased")


@query
def j04_lines_with_mods(spark, d):
    joined = joins.lines_with_mods(
        star.lines(spark, d), star.modifications(spark, d), star.menu(spark, d)
    )
    return joined.select("modificationID", "orderItemID", "orderID", "menuName", "cost")


@query
def j05_mods_with_inventory(spark, d):
    joined = joins.mods_with_inventory(star.modifications(spark, d), star.inventory(spark, d))
    return joined.select("modificationID", "inventoryName", "unit", "modificationQuantity", "cost")


@query
def j06_recipe_with_menu(spark, d):
    joined = joins.recipe_with_menu(star.recipe(spark, d), star.menu(spark, d))
    return joined.select("menuID", "inventoryID", "menuName", "menuInfoQuantity")


@query
def j07_orders_with_lines(spark, d):
    joined = joins.orders_with_lines(star.orders(spark, d), star.lines(spark, d))
    return joined.select("orderID", "orderItemID", "orderDate", "priceAtPurchase")


def _colocated(spark: SparkSession, shop: dict[str, DataFrame], layout: str) -> dict[str, DataFrame]:
    root, name = scratch_path(spark, "colocated"), f"t{uuid.uuid4().hex}"
    colocated.save_colocated(shop, root, name, buckets=8, layouts=[layout])
    return colocated.open_colocated(spark, root, name)


@query
def j07_colocated(spark, d):
    """As j07_orders_with_lines, from tables in buckets."""
    shop = _colocated(spark, {"ordertest": star.orders(spark, d), "orderItem": star.lines(spark, d)}, "order")
    joined = joins.orders_with_lines(shop["ordertest"], shop["orderItem"])
    return joined.select("orderID", "orderItemID", "orderDate", "priceAtPurchase")


@query
def q18_colocated(spark, d):
    """As q18_mod_revenue_by_item, from tables in buckets."""
    shop = _colocated(spark, {"orderItem": star.lines(spark, d), "modification": star.modifications(spark, d)}, "line")
    return sales.mod_revenue_by_item(shop["orderItem_by_line"], shop["modification"], star.menu(spark, d))


@query
def j08_orders_with_item_counts(spark, d):
    joined = joins.orders_with_item_counts(
        star.orders(spark, d), star.lines(spark, d), star.employees(spark, d)
    )
    return joined.select("orderID", "employeeName", "total_items")


@query
def j09_sold_items(spark, d):
    joined = joins.sold_items(star.lines(spark, d), star.menu(spark, d), star.orders(spark, d))
    return joined.select("orderItemID", "orderDate", "menuName", "priceAtPurchase")


@query
def j10_used_ingredients(spark, d):
    joined = joins.used_ingredients(
        star.orders(spark, d), star.lines(spark, d), star.recipe(spark, d), star.inventory(spark, d)
    )
    return joined.select("menuID", "inventoryID", "inventoryName", "quantitySold", "menuInfoQuantity")


@query
def j11_orders_on_best_days(spark, d):
    orders = star.orders(spark, d)
    days = sales.peak_days(orders).select(F.col("sales_day").alias("sale_day"))
    return joins.on_same_day(orders, days).select("orderID", "sale_day", "orderTotal")


@query
def j12_best_and_worst_day(spark, d):
    daily = sales.daily_sales(star.orders(spark, d), "best_day").withColumnRenamed("total_sales", "best_sales")
    best = ordering.top_k(daily, "best_sales", 1, ["best_day"])
    worst = ordering.top_k(daily, "best_sales", 1, ["best_day"], descending=False)
    return joins.pair_single_rows(best, worst.toDF("worst_day", "worst_sales"))


# --- A: aggregates ----------------------------------------------------------------------


def _order_stats(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.col("orderTotal") != 0, F.col("orderTotal"))).alias("n_nonzero"),
        F.sum("orderTotal").alias("sum_total"),
        numbers.sum0("orderTotal").alias("sum_or_zero"),
        numbers.sum_product("orderTotal", "orderTotal").alias("sum_square"),
        numbers.avg2("orderTotal").alias("avg_total"),
        numbers.round2(F.sum("orderTotal")).alias("sum_rounded"),
        *numbers.first_last("orderDate", "first_order", "last_order"),
        numbers.sum_if(predicates.is_return("orderTotal"), "orderTotal").alias("returns"),
        numbers.count_if(predicates.is_void("orderTotal")).alias("voids"),
    )


@query
def a01_order_stats(spark, d):
    """A1 to A8 and A15 over all orders with a positive or zero total and those of each kind."""
    return _order_stats(star.ticks(spark, d))


@query
def a05_empty_order_stats(spark, d):
    """The same over a range without orders: sums are NULL or 0 as their kind says."""
    empty = predicates.in_day_range("orderDate", dt.date(2030, 1, 1), dt.date(2030, 1, 31))
    return _order_stats(star.ticks(spark, d).where(empty))


@query
def a09_next_id(spark, d):
    return cart.next_id(star.orders(spark, d), "orderID")


@query
def a10_sales_by_period(spark, d):
    """Groups by week, day and weekday name at once."""
    periods = star.ticks(spark, d).groupBy(
        dates.iso_week("orderDate").alias("week_number"),
        dates.day_of("orderDate").alias("sales_day"),
        labels.weekday_label("orderDate").alias("day_of_week"),
    )
    return periods.agg(F.count("*").alias("total_orders"), F.sum("orderTotal").alias("total_sales"))


@query
def a12_item_counts_by_key(spark, d):
    """A group key together with the columns that depend on it."""
    counts = star.lines(spark, d).groupBy("menuID").agg(F.count("*").alias("n_lines"))
    menu = star.menu(spark, d).select("menuID", "menuName", "category")
    return counts.join(menu, "menuID").select("menuID", "menuName", "category", "n_lines")


@query
def a14_grand_total(spark, d):
    return reports.grand_total(reports.hourly_totals(star.ticks(spark, d), DAY), "totalSales")


# --- O: order ---------------------------------------------------------------------------


@query
def o05_nth_employee(spark, d):
    """The employee at the place that the number of orders gives, modulo the employees."""
    employee = star.employees(spark, d).select("employeeID", "employeeName")
    n_orders, n_employees = (df.select(F.count("*")).scalar() for df in (star.orders(spark, d), employee))
    place = n_orders % n_employees
    return ordering.nth_row(employee, "employeeID", place)


# --- X: scalar functions ----------------------------------------------------------------


@query
def x01_time_parts(spark, d):
    ts = "orderDate"
    return star.ticks(spark, d).select(
        "orderID",
        dates.iso_week(ts).alias("week"),
        dates.hour_of(ts).alias("hour"),
        dates.day_of(ts).alias("day"),
        labels.weekday_label(ts).alias("weekday"),
        labels.day_month_label(dates.day_of(ts)).alias("day_month"),
        dates.add_days(dates.day_of(ts), -7).alias("week_before"),
        dates.month_day(ts).alias("month_day"),
        labels.time_label(F.when(F.col("orderTotal") != 0, F.date_trunc("minute", ts).cast("timestamp_ntz")))
        .alias("minute_label"),
    )


@query
def x08_money_labels(spark, d):
    total = F.col("orderTotal")
    return star.ticks(spark, d).select(
        "orderID",
        labels.money_label(total).alias("money"),
        labels.total_label(total).alias("total"),
        labels.hour_label(dates.hour_of("orderDate")).alias("hour"),
        labels.items_label(F.col("orderID")).alias("items"),
        F.abs(total).alias("absolute"),
        numbers.round2(total * F.lit("1.075").cast("decimal(4,3)")).alias("with_tax"),
        F.coalesce(F.when(total != 0, total), F.lit(-1).cast(MONEY)).alias("non_zero"),
    )


@query
def x13_text_labels(spark, d):
    label = labels.line_label("menuName", "price")
    return star.menu(spark, d).select(
        "menuID",
        labels.unit_label("menuName", F.when(F.col("menuImage") > 25, F.col("category"))).alias("unit"),
        label.alias("line"),
        labels.label_price(label).alias("price_again"),
        labels.trimmed(F.concat(F.lit("  "), F.col("menuName"), F.lit(" \t"))).alias("trimmed"),
    )


def _dates_as_text() -> Column:
    """Order dates in the three accepted spellings, and in some that are not."""
    kind = F.col("orderID") % 7
    ts = F.col("orderDate")
    return (
        F.when(kind == 0, F.date_format(ts, "yyyy MM dd"))
        .when(kind == 1, F.date_format(ts, "yyyy/MM/dd"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 3, F.date_format(ts, "dd.MM.yyyy"))
        .when(kind == 4, F.date_format(ts, "yyyy-13-dd"))
        .when(kind == 5, F.concat(F.lit(" "), F.date_format(ts, "yyyy-MM-31"), F.lit(" ")))
        .otherwise(F.lit("   "))
    )


@query
def x16_normalise_dates(spark, d):
    text = _dates_as_text()
    return star.orders(spark, d).select("orderID", dates.normalise_date(text).alias("day"))


@query
def x17_iso_dates(spark, d):
    return star.orders(spark, d).select("orderID", dates.iso_date(_dates_as_text()).alias("day"))


@query
def x18_parsed_numbers(spark, d):
    kind = F.col("orderID") % 4
    whole = F.col("employeeID").cast("string")
    text = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.concat(F.lit("-"), whole))
        .when(kind == 2, F.col("orderTotal").cast("string"))
        .otherwise(F.concat(whole, F.lit("x")))
    )
    return star.orders(spark, d).select(
        "orderID", numbers.to_int(text).alias("number"), numbers.to_money(text).alias("amount")
    )


def _some_bad(value: Column, key: str, bad: str) -> Column:
    """A form field as text; every third one is spoilt."""
    return F.when(F.col(key) % 3 == 0, F.lit(bad)).otherwise(value.cast("string"))


@query
def x18_employee_form(spark, d):
    key = "employeeID"
    form = star.employees(spark, d).select(
        _some_bad(F.col(key), key, "12a").alias(key),
        F.when(F.col(key) % 5 == 0, F.lit(" ")).otherwise(F.col("employeeName")).alias("employeeName"),
        "employeePosition",
        F.when(F.col(key) % 7 != 0, F.lit("0000")).alias("employeePasscode"),
    )
    return mutations.employee_form_violations(form).drop("employeePasscode")


@query
def x18_menu_change_form(spark, d):
    form = star.menu(spark, d).select(
        (F.col("menuID") + F.lit(3_000_000_000)).cast("string").alias("menuID"),
        "menuName",
        F.when(F.col("menuID") % 5 == 0, F.lit("")).otherwise(F.col("category")).alias("category"),
        _some_bad(F.col("price"), "menuID", "$4").alias("price"),
    )
    return mutations.menu_change_violations(form)


@query
def x18_restock_form(spark, d):
    amount = _some_bad(F.col("restockOrdered"), "inventoryID", "1.5")
    form = star.inventory(spark, d).select("inventoryName", amount.alias("addAmount"))
    return mutations.restock_violations(form)


# --- S: sources and sinks ---------------------------------------------------------------


@query
def s01_order_feed(spark, d):
    """Orders written as a CSV feed and read back."""
    path = scratch_path(spark, "order-feed")
    feeds.write_feed(star.located_orders(spark, d), "ordertest", path)
    return feeds.read_feed(spark, "ordertest", path)


@query
def s02_menu_feed(spark, d):
    """Menu rows with commas and quotes in their text and seasons in the US spelling."""
    path = scratch_path(spark, "menu-feed")
    season = "M/d/yyyy H:mm"
    values = (
        F.col("menuID"),
        F.concat(F.col("menuName"), F.lit(', "'), F.col("menuDescription"), F.lit('"')),
        F.col("category"),
        F.col("price"),
        F.col("menuImage"),
        F.lit("None"),
        F.date_format("seasonalStart", season),
        F.date_format("seasonalEnd", season),
    )
    star.menu(spark, d).select(
        *[value.alias(header) for value, header in zip(values, FEED_HEADERS["menu"], strict=True)]
    ).write.options(header=True, quote='"', escape='"').csv(path)
    return feeds.read_feed(spark, "menu", path)


def _shop(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The star tables in the schemas of the eight tables; columns that they lack are NULL, tables that they lack empty."""
    found = {
        "menu": star.menu(spark, d),
        "employee": star.employees(spark, d),
        "ordertest": star.located_orders(spark, d),
        "inventory": star.inventory(spark, d),
        "locationTable": star.locations(spark, d),
    }

    def fitted(name: str) -> DataFrame:
        if name not in found:
            return spark.createDataFrame([], SCHEMAS[name])
        table = found[name]
        return table.select(
            *[
                (F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in SCHEMAS[name].fields
            ]
        )

    return {name: fitted(name) for name in LOAD_ORDER}


def _older_shop(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """As the tables were before a load: every other order, employee and menu item is missing, other menu items have an old
    price."""
    shop = _shop(spark, d)
    known = {"menu": "menuID", "employee": "employeeID", "ordertest": "orderID"}
    older = {name: shop[name].where(F.col(key) % 2 == 0) for name, key in known.items()}
    older["menu"] = older["menu"].withColumn("price", F.lit("1.00").cast(MONEY))
    return {**shop, **older}


FEEDS = ("menu", "employee", "inventory", "locationTable", "ordertest")


def _loaded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The feeds of the shop's five filled tables, staged and loaded onto the older tables."""
    folder = scratch_path(spark, "feeds")
    shop = _shop(spark, d)
    for name in FEEDS:
        feeds.write_feed(shop[name], name, f"{folder}/{FEED_FILES[name]}")
    return load.load_tables(_older_shop(spark, d), load.stage_feeds(spark, folder, FEEDS))


@query
def s03_staged_load(spark, d):
    """Rows, keys and totals of every table after the load."""
    loaded = _loaded(spark, d)
    measures = {
        "menu": ("menuID", "price"), "employee": ("employeeID", "employeeID"), "ordertest": ("orderID", "orderTotal"),
        "inventory": ("inventoryID", "quantityAvailable"), "locationTable": ("locationID", "locationID"),
    }
    parts = [
        loaded[name].agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"),
            F.sum(F.col(measure).cast("decimal(38,2)")).cast("double").alias("total"),
        )
        for name, (key, measure) in measures.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def s04_table_versions(spark, d):
    """The menu after a load, written as a version and opened as the latest one."""
    root = scratch_path(spark, "versions")
    tables.save_tables(_older_shop(spark, d), root, "before")
    loaded = _loaded(spark, d)
    tables.save_tables({name: loaded[name] for name in FEEDS}, root, "after", base="before")
    return tables.open_tables(spark, root)["menu"]


@query
def s05_create_and_drop(spark, d):
    """Rows of each created table once it is filled, and whether it is left when all are dropped."""
    shop, before = _shop(spark, d), spark.catalog.currentDatabase()
    own = f"shop_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {own}")
    spark.catalog.setCurrentDatabase(own)
    try:
        tables.create_tables(spark)
        for name in FEEDS:
            shop[name].write.insertInto(name)
        counts = {name: spark.table(name).count() for name in LOAD_ORDER}
        tables.drop_all(spark)
        left = {table.name for table in spark.catalog.listTables()}
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {own} CASCADE")
    found = [(name, n, name.lower() in {x.lower() for x in left}) for name, n in counts.items()]
    return spark.createDataFrame(found, "table_name string, n_rows bigint, is_left boolean")


@query
def s08_display(spark, d):
    return display.as_display(star.ticks(spark, d).select("orderID", "employeeID", "orderTotal"))


# --- W: loads, mutations, constraints ---------------------------------------------------


def _new_menu_items(spark: SparkSession, d: str) -> DataFrame:
    """A second menu under negative keys, which nothing refers to."""
    return star.menu(spark, d).withColumn("menuID", -F.col("menuID") - 1)


def _new_employees(spark: SparkSession, d: str) -> DataFrame:
    return star.employees(spark, d).withColumn("employeeID", -F.col("employeeID") - 1)


@query
def w01_upsert_menu(spark, d):
    """Half of the staged rows replace an item, the others are new."""
    replaces = F.col("menuImage") % 2 == 0
    staged = star.menu(spark, d).select(
        F.when(replaces, F.col("menuID")).otherwise(-F.col("menuID") - 1).alias("menuID"),
        F.concat(F.lit("new "), F.col("menuName")).alias("menuName"),
        "category",
        (F.col("price") + 1).cast(MONEY).alias("price"),
        "menuImage", "menuDescription", "seasonalStart", "seasonalEnd",
    )
    return mutations.upsert(star.menu(spark, d), staged, "menuID")


@query
def w02_insert_employees(spark, d):
    added = mutations.insert_rows(star.employees(spark, d), _new_employees(spark, d), "employeeID")
    return added.drop("employeePasscode")


@query
def w03_insert_menu_items(spark, d):
    """Items from form text: some bounds are blank, and the image is not given."""
    blank = F.col("menuImage") % 2 == 0
    form = _new_menu_items(spark, d).select(
        F.col("menuID").cast("string").alias("menuID"),
        "menuName",
        "category",
        F.col("price").cast("string").alias("price"),
        "menuDescription",
        F.when(blank, F.lit("")).otherwise(F.lit("2024-03-01")).alias("seasonalStart"),
        F.when(blank, F.lit(" ")).otherwise(F.date_format("seasonalEnd", "yyyy-MM-dd")).alias("seasonalEnd"),
    )
    return mutations.insert_menu_items(star.menu(spark, d), form, SEASON_DAY)


@query
def w04_update_menu(spark, d):
    """Every other change names an item that is not there."""
    known = F.col("menuImage") % 2 == 0
    changes = star.menu(spark, d).select(
        F.when(known, F.col("menuID")).otherwise(-F.col("menuID") - 1).alias("menuID"),
        F.concat(F.lit("new "), F.col("menuName")).alias("menuName"),
        F.concat(F.lit("NEW "), F.col("category")).alias("category"),
        (F.col("price") * 2).cast(MONEY).alias("price"),
    )
    return mutations.update_by_key(star.menu(spark, d), changes, "menuID", ["menuName", "category", "price"])


def _restock_deltas(spark: SparkSession, d: str) -> DataFrame:
    return star.read(spark, d, "events").select(
        F.format_string("Supplier#%09d", F.col("user_id")).alias("inventoryName"),
        (F.col("event_id") % 7 - 2).cast("int").alias("addAmount"),
    )


@query
def w05_restock(spark, d):
    return mutations.apply_restock(star.inventory(spark, d), _restock_deltas(spark, d))


@query
def w05_restock_blocks(spark, d):
    """As w05_restock, on a table in blocks of which only those with a named item are written again."""
    inventory, folder = star.inventory(spark, d), scratch_path(spark, "blocks")
    blocks.save_blocks(inventory, folder, "inventoryID", size=100)
    deltas = _restock_deltas(spark, d)
    named = inventory.join(deltas, "inventoryName", "left_semi").select("inventoryID")
    blocks.change_blocks(
        spark, folder, named, "inventoryID", lambda rows: mutations.apply_restock(rows, deltas), size=100
    )
    return blocks.open_blocks(spark, folder).select(*inventory.columns)


@query
def w06_delete_employees(spark, d):
    """All are to go; those with orders stay."""
    everyone = star.employees(spark, d).unionByName(_new_employees(spark, d))
    left = mutations.delete_by_key(
        everyone, everyone, "employeeID", [(star.orders(spark, d), "employeeID")]
    )
    return left.drop("employeePasscode")


@query
def w07_delete_menu_items(spark, d):
    """All are to go; those with order lines or a recipe stay."""
    everything = star.menu(spark, d).unionByName(_new_menu_items(spark, d))
    children = [(star.lines(spark, d), "menuID"), (star.recipe(spark, d), "menuID")]
    return mutations.delete_by_key(everything, everything, "menuID", children)


def _tick_carts(spark: SparkSession, d: str) -> DataFrame:
    return star.ticks(spark, d).select(
        F.col("orderID").alias("order_id"), "orderDate", F.lit(1).alias("n_lines"),
        F.col("orderTotal").alias("total"),
    )


@query
def w08_append_orders(spark, d):
    """Every event becomes an order after the last one, with cashiers in turn."""
    return cart.append_orders(
        star.located_orders(spark, d), _tick_carts(spark, d), star.employees(spark, d), ROTATION
    )


@query
def w10_pk_violations(spark, d):
    return constraints.pk_violations(star.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def w11_fk_violations(spark, d):
    """Orders of customers who are no longer in credit."""
    in_credit = star.read(spark, d, "customer").where(F.col("c_acctbal") >= 0)
    return constraints.fk_violations(
        star.read(spark, d, "orders"), in_credit, "o_custkey", "c_custkey"
    )


# --- C: cashier operators ---------------------------------------------------------------


@query
def c01_customise(spark, d):
    """Drinks with every number of choices, taken from the bits of the keys."""
    def chosen(bits: Column, choices: tuple[str, ...]) -> Column:
        return F.array(
            *[F.when(F.shiftright(bits, i) % 2 == 1, F.lit(c)).otherwise("") for i, c in enumerate(choices)]
        )

    lines = star.read(spark, d, "lineitem").select(
        star.line_id().alias("line"),
        F.col("l_returnflag").alias("name"),
        F.col("l_quantity").cast(MONEY).alias("base"),
        chosen(F.col("l_partkey") % 16, cart.BASE_INGREDIENTS).alias("removed"),
        chosen(F.col("l_suppkey") % 16, cart.EXTRAS).alias("extras"),
    )
    return cart.customise(lines).select("line", "description", "price")


@query
def c02_order_totals(spark, d):
    lines = star.lines(spark, d).select(F.col("orderID").alias("order_id"), F.col("priceAtPurchase").alias("price"))
    return cart.order_totals(lines)


def _cart_events(spark: SparkSession, d: str) -> DataFrame:
    """Cart events of each user: errors remove one of five drinks, anything else adds one."""
    drink = (F.col("event_id") % 5).cast("int")
    price = (drink + F.lit("4.65").cast(MONEY)).cast(MONEY)
    return star.read(spark, d, "events").select(
        F.col("user_id").alias("order_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("orderDate"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"),
        labels.line_label(F.format_string("Drink %d []", drink), price).alias("label"),
        price.alias("price"),
    )


@query
def c03_cart_totals(spark, d):
    return cart.cart_totals(_cart_events(spark, d))


@query
def f14_non_empty_orders(spark, d):
    """Carts by user and drink, so that some end up empty."""
    events = _cart_events(spark, d)
    by_drink = events.withColumn("order_id", F.concat_ws("/", "order_id", "label"))
    return predicates.non_empty_orders(cart.cart_totals(by_drink))


@query
def c04_submit_orders(spark, d):
    events = _cart_events(spark, d)
    times = events.groupBy("order_id").agg(F.max("orderDate").alias("orderDate"))
    carts = cart.cart_totals(events).join(times, "order_id")
    return cart.submit_orders(star.located_orders(spark, d), carts, star.employees(spark, d), ROTATION)


# --- G: business rules ------------------------------------------------------------------


@query
def g01_price_on(spark, d):
    """Price of every line's item on the day of its order."""
    sold = joins.sold_items(star.lines(spark, d), star.menu(spark, d), star.orders(spark, d))
    price = rules.price_on("price", dates.day_of("orderDate"), FIRST_DAY)
    return sold.select("orderItemID", "menuID", price.alias("price_then"))


@query
def g02_peak_days(spark, d):
    days = [dt.date(1996, 2, 29), dt.date(1998, 1, 15), dt.date(1994, 7, 4)]
    return rules.flag_peak_days(star.orders(spark, d), days).select("orderID", "orderDate", "is_peak")


@query
def g03_line_price(spark, d):
    return rules.line_price(star.lines(spark, d), star.menu(spark, d), star.modifications(spark, d))


@query
def g04_reconcile_totals(spark, d):
    return rules.reconcile_totals(star.orders(spark, d), star.lines(spark, d))


@query
def g05_roster(spark, d):
    day = dates.day_of("orderDate")
    return star.orders(spark, d).select("orderID", rules.roster(day, 3, FIRST_DAY).alias("onDuty"))


@query
def g06_running_sales(spark, d):
    return rules.running_sales(star.orders(spark, d))


# --- T: streams -------------------------------------------------------------------------

#: The events come in so many parts, each with events of the whole time range.
PARTS = 4


def _event_part(spark: SparkSession, d: str, part: int) -> DataFrame:
    return star.read(spark, d, "events").where(F.col("event_id") % PARTS == part)


def _ticks_stream(spark: SparkSession, d: str, folder: str, **options) -> DataFrame:
    schema = star.read(spark, d, "events").schema
    return star.ticks_of(spark.readStream.schema(schema).options(**options).parquet(folder))


@query
def t01_order_intake(spark, d):
    """Part after part arrives, and the intake is started anew for each: most orders are older than the newest before."""
    path = scratch_path(spark, "intake")
    for part in range(PARTS):
        _event_part(spark, d, part).write.mode("append").parquet(f"{path}/source")
        carts = _ticks_stream(spark, d, f"{path}/source").select(
            F.col("orderID").alias("order_id"), "orderDate", F.lit(1).alias("n_lines"),
            F.col("orderTotal").alias("total"),
        )
        live.start_intake(
            carts, star.orders(spark, d), star.employees(spark, d), path, f"{path}/checkpoint", ROTATION
        ).awaitTermination()
    return live.accepted_orders(spark, path)


def _run_report(spark: SparkSession, d: str, partials: live.Partials, name: str) -> str:
    """Run a report over the parts, one file to a micro-batch."""
    path = scratch_path(spark, name)
    for part in range(PARTS):
        _event_part(spark, d, part).write.mode("append").parquet(f"{path}/source")
    orders = _ticks_stream(spark, d, f"{path}/source", maxFilesPerTrigger=1)
    live.start_report(orders, partials, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return f"{path}/rows"


@query
def t02_live_hourly_sales(spark, d):
    return live.hourly_sales(spark, _run_report(spark, d, live.hour_partials, "hourly"))


@query
def t03_live_day_totals(spark, d):
    return live.day_totals(spark, _run_report(spark, d, live.day_partials, "days"))
