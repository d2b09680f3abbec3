import datetime as dt

import pytest

from tests.conftest import at, money, rows
from tillbook.plans import reports, sales

DAY = dt.date(2025, 6, 23)


def test_items_merge_by_name(shop):
    assert rows(sales.quantity_by_item(shop["orderItem"], shop["menu"])) == [
        ("Mint Tea", money("4")), ("Plum Fizz", money("3")),
    ]
    assert rows(sales.recipe_size(shop["menuInfo"], shop["menu"])) == [("Mint Tea", 2), ("Plum Fizz", 2)]
    assert rows(sales.revenue_by_category(shop["orderItem"], shop["menu"])) == [
        ("Fruity Beverage", 2, money("27.50")), ("Fresh Brew", 3, money("26.00")),
    ]
    plain = sales.revenue_by_category(shop["orderItem"], shop["menu"], line_price_includes_qty=False)
    assert rows(plain) == [("Fresh Brew", 3, money("17.00")), ("Fruity Beverage", 2, money("16.50"))]


def test_orders_by_employee(shop):
    assert rows(sales.avg_order_by_employee(shop["ordertest"], shop["employee"])) == [
        ("Bo", 2, money("4.75")), ("Cy", 3, money("4.67")),
    ]
    assert rows(sales.revenue_by_employee(shop["ordertest"], shop["employee"])) == [
        ("Cy", money("14.00")), ("Bo", money("9.50")),
    ]
    # Order 5 has no lines and order 3 none either: they do not count here.
    assert rows(sales.avg_items_by_employee(shop["ordertest"], shop["orderItem"], shop["employee"])) == [
        ("Cy", money("2.50")), ("Bo", money("2.00")),
    ]
    assert rows(sales.orders_with_employee(shop["ordertest"], shop["employee"]))[0] == (
        5, "Cy", at("2025-06-25T23:59:59"), money("7.00"),
    )


def test_location_joins_by_name(spark, shop):
    assert rows(sales.orders_per_location(shop["ordertest"], shop["locationTable"])) == [("Dock", 1), ("Main St", 3)]
    twice = shop["locationTable"].unionByName(shop["locationTable"])
    assert rows(sales.orders_per_location(shop["ordertest"], twice)) == [("Dock", 2), ("Main St", 6)]


def test_modifications(shop):
    tables = shop["orderItem"], shop["modification"], shop["menu"]
    assert rows(sales.mods_per_line(*tables)) == [
        (10, "Mint Tea", 2, money("1.25")), (13, "Plum Fizz", 1, money("0.25")),
    ]
    assert rows(sales.mod_revenue_by_item(*tables)) == [("Mint Tea", money("1.25")), ("Plum Fizz", money("0.25"))]
    assert rows(sales.addon_revenue(shop["modification"], shop["inventory"])) == [
        ("Plum", money("1.00")), ("Mint", money("0.75")),
    ]


def test_time_groups(shop):
    assert rows(sales.weekly_orders(shop["ordertest"])) == [(26, 5)]
    assert rows(sales.hourly_sales(shop["ordertest"])) == [
        (0, 1, money("11.00")), (9, 2, money("5.50")), (17, 1, money("0.00")), (23, 1, money("7.00")),
    ]
    assert rows(sales.peak_days(shop["ordertest"], 2)) == [
        (dt.date(2025, 6, 24), money("11.00")), (dt.date(2025, 6, 25), money("7.00")),
    ]
    assert rows(sales.sales_by_weekday(shop["ordertest"])) == [
        ("Tuesday  ", 1, money("11.00")), ("Wednesday", 1, money("7.00")), ("Monday   ", 3, money("5.50")),
    ]


def test_worst_day(spark, shop):
    found = sales.worst_day_top_seller(shop["ordertest"], shop["orderItem"], shop["menu"])
    assert rows(found) == [("23 June     ", money("5.50"), "Mint Tea", money("2.00"))]
    assert rows(sales.worst_day_top_seller(shop["ordertest"], shop["orderItem"], shop["menu"], week=1)) == []


def test_top_orders(shop):
    assert rows(sales.largest_orders(shop["ordertest"], 2)) == [
        (4, at("2025-06-24"), money("11.00")), (1, at("2025-06-23T09:15:00"), money("9.50")),
    ]
    assert rows(sales.top_orders_by_lines(shop["ordertest"], shop["orderItem"], 2)) == [
        (4, at("2025-06-24"), money("40.00"), 2), (1, at("2025-06-23T09:15:00"), money("9.50"), 2),
    ]


def test_rounded_total_does_not_decide_the_order(spark):
    orders = spark.createDataFrame(
        [(1, at("2025-01-01"), money("5.004")), (2, at("2025-01-01"), money("5.001"))],
        "orderID bigint, orderDate timestamp_ntz, orderTotal decimal(18,3)",
    )
    assert [r[0] for r in rows(sales.largest_orders(orders, 2))] == [1, 2]


def test_missing_sums_sort_first_and_ties_by_name(spark):
    orders = spark.createDataFrame(
        [(1, 1, None), (2, 2, money("5")), (3, 3, money("5"))],
        "orderID bigint, employeeID bigint, orderTotal decimal(18,2)",
    )
    staff = spark.createDataFrame([(1, "Zed"), (2, "Bo"), (3, "Al")], "employeeID bigint, employeeName string")
    assert rows(sales.revenue_by_employee(orders, staff)) == [("Zed", None), ("Al", money("5")), ("Bo", money("5"))]
    assert rows(sales.avg_order_by_employee(orders, staff))[0] == ("Zed", 1, None)


def test_views(shop):
    assert rows(reports.inventory_view(shop["inventory"]))[0] == ("Mint", money("5.00"), "oz")
    assert reports.employee_view(shop["employee"]).columns == ["ID", "Name", "Position"]
    assert [r[0] for r in rows(reports.menu_view(shop["menu"]))] == [0, 1, 2]
    assert [r[0] for r in rows(reports.order_history(shop["ordertest"], 2))] == [5, 4]
    assert [r[3] for r in rows(reports.restock_status(shop["inventory"]))] == ["Y", "N", "Y"]


def test_range_reports(shop):
    tables = shop["orderItem"], shop["menu"], shop["ordertest"]
    one_day = DAY, DAY
    assert rows(reports.range_totals(shop["ordertest"], *one_day)) == [(money("5.50"), 3)]
    assert rows(reports.range_totals(shop["ordertest"], DAY, dt.date(2025, 6, 22))) == [(money("0"), 0)]
    assert rows(reports.top_items(*tables, *one_day)) == [
        ("Mint Tea", money("8.00"), "$8.00"), ("Plum Fizz", money("5.50"), "$5.50"),
    ]
    assert rows(reports.top_items(*tables, DAY, dt.date(2025, 6, 30), k=1)) == [
        ("Plum Fizz", money("27.50"), "$27.50"),
    ]
    nine_to_half_past = dt.datetime(2025, 6, 23, 9), dt.datetime(2025, 6, 23, 9, 30)
    assert rows(reports.window_totals(shop["ordertest"], *nine_to_half_past)) == [(money("9.50"), 1)]
    with pytest.raises(ValueError):
        reports.range_totals(shop["ordertest"], None, DAY)


def test_usage_includes_the_next_midnight(shop):
    tables = shop["ordertest"], shop["orderItem"], shop["menuInfo"], shop["inventory"]
    # The order of June 24, 00:00 is in: 2 x 3.00 + 3 x 0.25 + 2 x 4.00 of mint, 3 x 1.50 of plum.
    assert rows(reports.ingredient_usage(*tables, DAY, DAY)) == [
        ("Mint", "oz", money("14.75"), "Mint (oz)"), ("Plum", "each", money("4.50"), "Plum (each)"),
    ]
    assert rows(reports.ingredient_usage(*tables, dt.date(2025, 6, 25), dt.date(2025, 6, 26))) == []
    with pytest.raises(ValueError):
        reports.ingredient_usage(*tables, DAY, dt.date(2025, 6, 22))


def test_day_reports(shop):
    orders = shop["ordertest"]
    assert rows(reports.x_report_hourly(orders, DAY)) == [("09:00", money("5.50")), ("17:00", money("0.00"))]
    assert rows(reports.x_report_totals(orders, DAY)) == [(money("5.50"), money("4.00"), 1)]
    zero = money("0.00")
    assert rows(reports.z_report(orders, DAY)) == [
        (money("5.50"), 3, at("2025-06-23T09:15:00"), at("2025-06-23T17:00:00"), zero, zero, zero),
    ]
    quiet = dt.date(2025, 7, 1)
    assert rows(reports.x_report_hourly(orders, quiet)) == []
    assert rows(reports.x_report_totals(orders, quiet)) == [(zero, zero, 0)]
    assert rows(reports.z_report(orders, quiet)) == [(zero, 0, None, None, zero, zero, zero)]
    assert rows(reports.discards(shop["inventory"])) == [(3, "Discards: 3 items")]


def test_hours_add_up_to_the_day(shop):
    for day in (DAY, dt.date(2025, 6, 24), dt.date(2025, 7, 1)):
        hours = reports.grand_total(reports.hourly_totals(shop["ordertest"], day), "totalSales").first()[0]
        assert hours == reports.z_report(shop["ordertest"], day).first()["totalSales"]


def test_available_menu(shop):
    tea = [("Mint Tea", money("4.00"), 0), ("Mint Tea", money("4.50"), 2)]
    assert sorted(rows(reports.available_menu(shop["menu"], "Fresh Brew", dt.date(2025, 4, 1)))) == tea
    assert rows(reports.available_menu(shop["menu"], "Fresh Brew", dt.date(2025, 7, 1))) == tea[:1]
    assert rows(reports.available_menu(shop["menu"], "Fruity Beverage", dt.date(2030, 1, 15)))[0][0] == "Plum Fizz"
