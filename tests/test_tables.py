"""Feeds, catalog tables, constraints and mutations."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import at, money, rows
from tillbook.operators import constraints, mutations, ordering
from tillbook.operators.constraints import ConstraintError
from tillbook.plans import load
from tillbook.schemas import FEED_FILES, FEED_HEADERS, LOAD_ORDER, PRIMARY_KEYS, SCHEMAS
from tillbook.sources import feeds, tables
from tillbook.sources.display import as_display
from tillbook.sources.jdbc import read_jdbc


def write_text(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_feed_binds_by_position(spark, tmp_path):
    path = write_text(
        tmp_path / "inventory.csv",
        "A,B,C,D,E,F,G,Allegery,H\n"
        '1,"Mint, fresh",2.00,0.5,1,0,oz,None,40\n'
        '2,"The ""hot"" one é",13.049999999999999,1,,0,,Dairy,60\n',
    )
    assert rows(feeds.read_feed(spark, "inventory", path)) == [
        (1, "Mint, fresh", money("2.00"), money("0.50"), money("1.00"), 0, "oz", "None", 40),
        (2, 'The "hot" one é', money("13.05"), money("1.00"), None, 0, None, "Dairy", 60),
    ]


def test_read_feed_reads_both_timestamps(spark, tmp_path):
    path = write_text(
        tmp_path / "menu.csv",
        "a,b,c,d,e,f,g,h\n7,Tea,Brew,5.8,0,x,1/1/2025 0:00,12/31/2025 23:59\n8,Tea,Brew,6,,,2025-03-01 00:00:00,\n",
    )
    assert [r[-2:] for r in rows(feeds.read_feed(spark, "menu", path))] == [
        (at("2025-01-01"), at("2025-12-31T23:59:00")), (at("2025-03-01"), None),
    ]


@pytest.mark.parametrize("line", ["x,Ada,Manager,1", "1,Ada", "1,Ada,Manager,1,extra"])
def test_read_feed_fails_on_a_bad_row(spark, tmp_path, line):
    path = write_text(tmp_path / "employee.csv", f"a,b,c,d\n2,Bo,Cashier,2222\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED"):
        feeds.read_feed(spark, "employee", path).select("employeeName").collect()


@pytest.mark.parametrize("name", LOAD_ORDER)
def test_feed_round_trip(spark, shop, tmp_path, name):
    path = str(tmp_path / name)
    feeds.write_feed(shop[name], name, path)
    again = feeds.read_feed(spark, name, path)
    assert again.schema.simpleString() == SCHEMAS[name].simpleString()
    assert sorted(map(repr, rows(again))) == sorted(map(repr, rows(shop[name])))
    part = next((tmp_path / name).glob("part-*.csv"))
    assert part.read_text().splitlines()[0] == ",".join(FEED_HEADERS[name])


def test_load_of_a_folder_twice_is_the_same(spark, shop, tmp_path):
    for name in LOAD_ORDER:
        feeds.write_feed(shop[name], name, str(tmp_path / FEED_FILES[name]))
    staged = load.stage_feeds(spark, str(tmp_path))
    once = load.load_tables(tables.empty_tables(spark), staged)
    twice = load.load_tables(once, staged)
    for name in LOAD_ORDER:
        assert sorted(map(repr, rows(twice[name]))) == sorted(map(repr, rows(shop[name])))
    orphan = shop["orderItem"].withColumn("orderID", F.lit(99).cast("bigint"))
    with pytest.raises(ConstraintError, match="orderItem.orderID"):
        load.load_tables(once, {"orderItem": orphan})
    # A staged child may point to a parent that is staged with it.
    parent = shop["ordertest"].where("orderID = 1").withColumn("orderID", F.lit(99).cast("bigint"))
    both = load.load_tables(once, {"ordertest": parent, "orderItem": orphan})
    assert both["ordertest"].count() == 6
    assert rows(both["orderItem"].select("orderID").distinct()) == [(99,)]


def test_versions_and_views(spark, shop, tmp_path):
    tables.save_tables(shop, str(tmp_path), "v1")
    opened = tables.open_tables(spark, str(tmp_path), "v1")
    assert sorted(map(repr, rows(opened["menu"]))) == sorted(map(repr, rows(shop["menu"])))
    with pytest.raises(PySparkException):
        tables.save_tables(shop, str(tmp_path), "v1")
    tables.register_views(opened)
    total = spark.sql("SELECT SUM(orderTotal) FROM ordertest WHERE orderID >= :first", args={"first": 4})
    assert rows(total) == [(money("18.00"),)]
    for name in LOAD_ORDER:
        spark.catalog.dropTempView(name)


def test_catalog_tables(spark):
    tables.create_tables(spark)
    tables.create_tables(spark)
    assert all(spark.catalog.tableExists(name) for name in LOAD_ORDER)
    assert spark.table("menu").schema.simpleString() == SCHEMAS["menu"].simpleString()
    tables.drop_all(spark)
    assert not any(spark.catalog.tableExists(name) for name in LOAD_ORDER)
    with pytest.raises(PySparkException):
        tables.drop_all(spark)


def test_display(shop):
    shown = as_display(shop["menu"].select("menuID", "price", "seasonalStart"))
    assert rows(shown)[:2] == [("0", "4.00", None), ("1", "5.50", "2025-11-01 00:00:00")]


def test_jdbc_needs_bounds(spark):
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:x", "t", {}, partition_column="id")


def test_key_checks(spark, shop):
    keys = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert sorted(rows(constraints.pk_violations(keys, "k")), key=repr) == [(1, 2), (None, 1)]
    children = spark.createDataFrame([(1,), (9,), (9,), (None,)], "k int")
    assert rows(constraints.fk_violations(children, keys, "k")) == [(9, 2)]
    for name, key in PRIMARY_KEYS.items():
        assert rows(constraints.pk_violations(shop[name], key)) == []
    with pytest.raises(ConstraintError):
        constraints.require_unique(keys, "k", "table")


def test_upsert(spark):
    schema = "k int, a string, b string"
    target = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], schema)
    staging = spark.createDataFrame([(2, "x", None), (3, "y", "z")], schema)
    merged = [(1, "a", "b"), (2, "x", None), (3, "y", "z")]
    assert sorted(rows(mutations.upsert(target, staging, "k"))) == merged
    assert sorted(rows(mutations.upsert(mutations.upsert(target, staging, "k"), staging, "k"))) == merged
    for bad in ([(2, "x", "y"), (2, "x", "y")], [(None, "x", "y")]):
        with pytest.raises(ConstraintError):
            mutations.upsert(target, spark.createDataFrame(bad, schema), "k")


def test_insert_rows(spark, shop):
    new = spark.createDataFrame([(4, "Di", "Cashier", "4444")], SCHEMAS["employee"])
    assert mutations.insert_rows(shop["employee"], new, "employeeID").count() == 4
    with pytest.raises(ConstraintError, match="already in use"):
        mutations.insert_rows(shop["employee"], new.withColumn("employeeID", F.lit(2).cast("bigint")), "employeeID")


FORM = "menuID string, menuName string, category string, price string, menuDescription string, " \
       "seasonalStart string, seasonalEnd string"


def test_insert_menu_items(spark, shop):
    form = spark.createDataFrame(
        [("7", "Lime", "Fresh Brew", "5.25", "d", " ", None), ("8", "Fig", "Fresh Brew", "6", "d", "2025-02-03", "2025-02-04")],
        FORM,
    )
    added = mutations.insert_menu_items(shop["menu"], form, dt.date(2031, 5, 6)).where("menuID > 6")
    assert sorted(rows(added)) == [
        (7, "Lime", "Fresh Brew", money("5.25"), None, "d", at("2031-01-01"), at("2031-12-31")),
        (8, "Fig", "Fresh Brew", money("6.00"), None, "d", at("2025-02-03"), at("2025-02-04")),
    ]


@pytest.mark.parametrize("change", [{"menuID": "x"}, {"price": "free"}, {"seasonalStart": "2025-02-30"}, {"menuID": "1"}])
def test_bad_menu_form(spark, shop, change):
    good = {"menuID": "7", "menuName": "n", "category": "c", "price": "5", "menuDescription": "d",
            "seasonalStart": "", "seasonalEnd": ""}
    form = spark.createDataFrame([tuple({**good, **change}.values())], FORM)
    with pytest.raises(ConstraintError):
        mutations.insert_menu_items(shop["menu"], form, dt.date(2025, 1, 1))


def test_update_by_key(spark, shop):
    changes = spark.createDataFrame(
        [(1, "Fizz", None, money("9.00")), (77, "No", "No", money("1.00"))],
        "menuID bigint, menuName string, category string, price decimal(18,2)",
    )
    updated = mutations.update_by_key(shop["menu"], changes, "menuID", ["menuName", "category", "price"])
    assert updated.columns == shop["menu"].columns
    assert [r[:4] for r in sorted(rows(updated), key=lambda r: r[0])] == [
        (0, "Mint Tea", "Fresh Brew", money("4.00")), (1, "Fizz", None, money("9.00")),
        (2, "Mint Tea", "Fresh Brew", money("4.50")),
    ]


def test_restock_goes_by_name(spark, shop):
    deltas = spark.createDataFrame([("Mint", 10), ("Mint", -3), ("Gone", 5)], "inventoryName string, addAmount int")
    raised = mutations.apply_restock(shop["inventory"], deltas)
    assert raised.schema == shop["inventory"].schema
    assert sorted(r[:3] for r in rows(raised)) == [
        (1, "Mint", money("12.00")), (2, "Plum", money("9.00")), (3, "Mint", money("8.00")),
    ]


def test_delete_refuses_referenced_keys(spark, shop):
    keys = spark.createDataFrame([(1,), (2,), (9,)], "employeeID bigint")
    children = [(shop["ordertest"], "employeeID")]
    left = mutations.delete_by_key(shop["employee"], keys, "employeeID", children)
    assert sorted(r[0] for r in rows(left)) == [2, 3]
    with pytest.raises(ConstraintError, match="referenced"):
        mutations.delete_by_key(shop["employee"], keys, "employeeID", children, strict=True)
    menu_children = [(shop["orderItem"], "menuID"), (shop["menuInfo"], "menuID")]
    extra = shop["menu"].unionByName(shop["menu"].where("menuID = 0").withColumn("menuID", F.lit(50).cast("bigint")))
    left = mutations.delete_by_key(extra, extra.select("menuID"), "menuID", menu_children)
    assert sorted(r[0] for r in rows(left)) == [0, 1, 2]
    assert mutations.delete_by_key(shop["menu"], keys.toDF("menuID"), "menuID").count() == 1


def test_order_and_nth_row(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 5)], "k int, v int")
    assert [r[0] for r in rows(ordering.order_asc(df, "v", "k"))] == [1, 4, 3, 2]
    assert [r[0] for r in rows(ordering.order_desc(df, "v", "k"))] == [2, 3, 1, 4]
    assert [r[0] for r in rows(ordering.top_k(df, "v", 3, ["k"]))] == [2, 3, 1]
    assert [rows(ordering.nth_row(df, "k", n)) for n in (0, 3, 4)] == [[(1, 5)], [(4, 5)], []]
