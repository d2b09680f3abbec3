import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, money, rows
from tillbook.operators.joins import on_same_day, pair_single_rows, used_ingredients
from tillbook.operators.sequence import number_rows
from tillbook.plans import audit, cart, rules
from tillbook.sources.workspace import shared_folder

LINES = "order_id bigint, name string, base decimal(18,2), removed array<string>, extras array<string>"
EVENTS = "order_id bigint, op string, label string, price decimal(18,2)"


def test_customise(spark):
    lines = spark.createDataFrame(
        [
            (1, "Tea", money("4.00"), [], None),
            (1, "Tea", money("4.00"), ["Ice", "Milk", "Tin"], ["Jelly"]),
            (1, " Tea", money("4.00"), ["Milk", "Sugar", "Boba", "Ice"], ["Extra Boba", "Jelly", "Pudding", "Aloe"]),
        ],
        LINES,
    )
    assert rows(cart.customise(lines).select("description", "price")) == [
        ("Tea []", money("4.00")),
        ("Tea [-Milk -Ice +Jelly ]", money("4.50")),
        ("Tea [-Milk -Sugar -Boba -Ice +Aloe +Pudding +Jelly +Extra Boba ]", money("6.00")),
    ]


def test_cart_totals(spark):
    tea, fig = "Tea [] - $4.00", "Fig [] - $5.50"
    events = spark.createDataFrame(
        [
            (1, "add", tea, money("4.00")), (1, "add", tea, money("4.00")), (1, "add", fig, money("5.50")),
            (1, "remove", tea, None), (2, "add", fig, money("5.50")), (2, "remove", fig, None),
            (3, "remove", fig, None), (3, "add", tea, money("4.00")),
        ],
        EVENTS,
    )
    totals = cart.cart_totals(events)
    assert sorted(rows(totals)) == [(1, 2, money("9.50")), (2, 0, money("0.00")), (3, 1, money("4.00"))]
    lines = events.where("op = 'add'").select("order_id", "price")
    assert sorted(rows(cart.order_totals(lines)))[0] == (1, money("13.50"), "Total: $13.50")


def test_number_rows_is_dense_with_one_hot_key(spark):
    hot = F.when(F.col("id") % 3 == 0, at("2025-01-01")).otherwise(F.lit(at("2025-01-02")))
    df = spark.range(5000).select(hot.cast("timestamp_ntz").alias("t"), (F.col("id") * 7919 % 5000).alias("k"))
    numbered = number_rows(df, ["t", "k"])
    found = [tuple(r) for r in numbered.orderBy("seq").collect()]
    assert [r[2] for r in found] == list(range(5000))
    assert [r[:2] for r in found] == sorted(r[:2] for r in found)
    assert number_rows(df.limit(0), ["t", "k"]).count() == 0


def carts(spark):
    return spark.createDataFrame(
        [
            (501, at("2025-07-01T10:00:00"), 1, money("4.00")), (502, at("2025-07-01T09:00:00"), 2, money("9.00")),
            (503, at("2025-07-01T09:00:00"), 0, money("0.00")), (504, at("2025-07-01T11:00:00"), 1, money("5.00")),
        ],
        "order_id bigint, orderDate timestamp_ntz, n_lines int, total decimal(18,2)",
    )


def test_submit_orders(spark, shop):
    appended = cart.submit_orders(shop["ordertest"], carts(spark), shop["employee"])
    assert appended.schema.simpleString() == shop["ordertest"].schema.simpleString()
    # Five orders so far: the next turn is the one at place 5 % 2 = 1, employee 3.
    assert sorted(rows(appended))[5:] == [
        (6, 3, "College Station", at("2025-07-01T09:00:00"), money("9.00")),
        (7, 2, "College Station", at("2025-07-01T10:00:00"), money("4.00")),
        (8, 3, "College Station", at("2025-07-01T11:00:00"), money("5.00")),
    ]
    assert rows(cart.next_id(appended, "orderID")) == [(9,)]


def test_first_order_ever_and_one_cashier(spark, shop):
    none = shop["ordertest"].limit(0)
    assert rows(cart.next_id(none, "orderID")) == [(1,)]
    one = cart.submit_orders(none, carts(spark), shop["employee"], rotation=(2,))
    assert [r[:2] for r in sorted(rows(one))] == [(1, 2), (2, 2), (3, 2)]
    with pytest.raises(ZeroDivisionError):
        cart.submit_orders(none, carts(spark), shop["employee"], rotation=(1,))


def test_submitted_orders_reconcile(spark, shop):
    lines = shop["orderItem"].select("orderID", "priceAtPurchase")
    orders = lines.groupBy("orderID").agg(F.sum("priceAtPurchase").alias("orderTotal"))
    assert rows(rules.reconcile_totals(orders, lines)) == []
    # Header and lines of the shop differ where an order has a return, no lines, or 5.50 x 2 and 4.50 x 2.
    assert sorted(rows(rules.reconcile_totals(shop["ordertest"], shop["orderItem"]))) == [
        (2, money("-4.00"), money("4.00"), money("-8.00")),
        (4, money("11.00"), money("20.00"), money("-9.00")),
        (5, money("7.00"), money("0.00"), money("7.00")),
    ]


def test_price_steps(spark):
    days = [(dt.date(2024, 6, 29),), (dt.date(2024, 6, 30),), (dt.date(2024, 9, 28),), (dt.date(2024, 9, 29),),
            (dt.date(2025, 9, 27),)]
    df = spark.createDataFrame(days, "day date")
    assert [r[0] for r in rows(df.select(rules.price_on(F.lit(money("5.80")), "day")))] == [
        money("5.80"), money("6.05"), money("6.05"), money("6.30"), money("7.05"),
    ]
    assert [r[0] for r in rows(df.select(rules.roster("day", 3)))] == [3, 1, 1, 2, 2]


def test_line_price_is_cut_to_cents(spark, shop):
    # Line 10: 4.00 + 0.25 + 1.00; line 11: 5.50 + 0.50; line 12: 4.00 - 0.50; line 13: 2 x 5.75; line 14: 2 x 4.50.
    priced = rules.line_price(shop["orderItem"], shop["menu"], shop["modification"])
    assert sorted((r[0], r[2]) for r in rows(priced)) == [
        (10, money("5.25")), (11, money("6.00")), (12, money("3.50")), (13, money("11.50")), (14, money("9.00")),
    ]
    thirds = shop["orderItem"].withColumn("quantityPurchased", F.lit("0.33").cast("decimal(18,2)"))
    priced = rules.line_price(thirds, shop["menu"], shop["modification"])
    assert sorted((r[0], r[2]) for r in rows(priced))[0] == (10, money("1.73"))


def test_peak_days_and_running_sales(shop):
    flagged = rules.flag_peak_days(shop["ordertest"], [dt.date(2025, 6, 24)])
    assert [r[0] for r in rows(flagged.where("is_peak"))] == [4]
    assert not rows(rules.flag_peak_days(shop["ordertest"], []).where("is_peak"))
    assert rows(rules.running_sales(shop["ordertest"])) == [
        (dt.date(2025, 6, 23), money("5.50"), money("5.50")),
        (dt.date(2025, 6, 24), money("11.00"), money("16.50")),
        (dt.date(2025, 6, 25), money("7.00"), money("23.50")),
    ]


def test_login_audit(spark, shop):
    attempts = spark.createDataFrame(
        [(1, "Manager", "1111"), (2, "Cashier", "1111"), (3, "Cashier", "3333"), (4, "Cashier", None), (5, "cashier", "3333")],
        "attempt_id bigint, role string, passcode string",
    )
    twins = shop["employee"].unionByName(shop["employee"].withColumn("employeeID", F.col("employeeID") + 10))
    checked = audit.login_audit(attempts, twins)
    assert checked.columns == ["attempt_id", "role", "granted"]
    assert [r[2] for r in sorted(rows(checked))] == [True, False, True, False, False]


def test_days_and_pairs(spark, shop):
    days = spark.createDataFrame([(dt.date(2025, 6, 24),)], "sale_day date")
    assert [r[0] for r in rows(on_same_day(shop["ordertest"], days).select("orderID"))] == [4]
    one, none = days.toDF("a"), days.toDF("b").limit(0)
    assert rows(pair_single_rows(one, days.toDF("b"))) == [(dt.date(2025, 6, 24),) * 2]
    assert rows(pair_single_rows(one, none)) == [] == rows(pair_single_rows(none, one))


def test_used_ingredients_keeps_one_row_per_recipe_row(shop):
    used = used_ingredients(shop["ordertest"], shop["orderItem"], shop["menuInfo"], shop["inventory"])
    assert sorted(rows(used.select("menuID", "inventoryID", "quantitySold"))) == [
        (0, 1, money("2")), (1, 1, money("3")), (1, 2, money("3")), (2, 3, money("2")),
    ]


def fake_session(master, checkpoint_dir):
    return SimpleNamespace(
        conf={"spark.checkpoint.dir": checkpoint_dir} if checkpoint_dir else {},
        sparkContext=SimpleNamespace(master=master, applicationId="app"),
    )


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert shared_folder(fake_session("yarn", "hdfs://shared/check/")) == "hdfs://shared/check"
    with pytest.raises(ValueError):
        shared_folder(fake_session("yarn", None))
