"""The tables as SQL views: what a user writes in SQL equals the functions."""

import pytest

from tests.conftest import money, rows
from tillbook.plans import sales
from tillbook.schemas import LOAD_ORDER
from tillbook.sources import tables


@pytest.fixture(scope="module")
def sql(spark, shop):
    tables.register_views(shop)
    tables.register_functions(spark)
    yield spark.sql
    for name in LOAD_ORDER:
        spark.catalog.dropTempView(name)


def same(left, right):
    return sorted(map(repr, rows(left))) == sorted(map(repr, rows(right)))


def test_weekday_sales(sql, shop):
    found = sql(
        """SELECT weekday_label(orderDate) AS day_of_week, COUNT(orderID) AS total_orders,
                  ROUND(SUM(orderTotal), 2) AS total_sales
           FROM ordertest GROUP BY 1 ORDER BY total_sales DESC"""
    )
    assert same(found, sales.sales_by_weekday(shop["ordertest"]))


def test_category_revenue(shop):
    found = rows(sales.revenue_by_category(shop["orderItem"], shop["menu"]))
    assert found == [("Fruity Beverage", 2, money("27.50")), ("Fresh Brew", 3, money("26.00"))]


def test_two_level_average(shop):
    found = rows(sales.avg_items_by_employee(shop["ordertest"], shop["orderItem"], shop["employee"]))
    # Bo: two items in one order. Cy: one item and four items in two orders.
    assert sorted(found) == [("Bo", money("2.00")), ("Cy", money("2.50"))]


def test_worst_day(shop):
    found = rows(sales.worst_day_top_seller(shop["ordertest"], shop["orderItem"], shop["menu"]))
    assert found == [("23 June     ", money("5.50"), "Mint Tea", money("2.00"))]
    none = sales.worst_day_top_seller(shop["ordertest"], shop["orderItem"], shop["menu"], week=1)
    assert rows(none) == []


def test_money_label(sql):
    assert rows(sql("SELECT money_label(MIN(orderTotal)), money_label(1234.5) FROM ordertest")) == [
        ("$-4.00", "$1,234.50"),
    ]
