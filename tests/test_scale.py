"""Plans and results under skew: what has to hold on large tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tests.conftest import rows
from tillbook.operators import joins, mutations
from tillbook.operators.sequence import number_rows
from tillbook.plans import audit, reports, sales
from tillbook.sources import star

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_points.QUERIES
STREAMS = {"t01_order_intake", "t02_live_hourly_sales", "t03_live_day_totals"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_windows_without_partition_see_aggregated_rows_only(spark, name):
    windows = "Window [" in plan_of(QUERIES[name](spark, FOLDER))
    assert windows == (name in {"g06_running_sales", "w08_append_orders", "c04_submit_orders", "o05_nth_employee"})


@pytest.mark.parametrize("name", ["r06_range_totals", "r07_top_items", "r13_ingredient_usage", "r12_z_report"])
def test_date_ranges_reach_the_scan(spark, conf, name):
    conf(spark__sql__maxMetadataStringLength="2000")
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\((o_orderdate|ts),", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan(OrEqual)?\((o_orderdate|ts),", plan)


def test_scans_read_the_needed_columns_only(spark):
    plan = plan_of(QUERIES["q09_quantity_by_item"](spark, FOLDER))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def hot_orders(spark, n=30000):
    """A third of the orders belong to employee 1, on one day."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.col("id").alias("orderID"),
        F.when(hot, 1).otherwise(F.col("id") % 5000 + 2).alias("employeeID"),
        F.when(hot, F.lit("2025-06-23")).otherwise(
            F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 300).cast("int")).cast("string")
        ).cast("timestamp_ntz").alias("orderDate"),
        (F.col("id") % 97).cast("decimal(18,2)").alias("orderTotal"),
    )


def staff(spark, n=5002):
    return spark.range(1, n).select(
        F.col("id").alias("employeeID"),
        F.concat(F.lit("E"), F.col("id").cast("string")).alias("employeeName"),
        F.lit("Cashier").alias("employeePosition"),
        F.col("id").cast("string").alias("employeePasscode"),
    )


@pytest.fixture
def shuffled(conf):
    """Joins that shuffle, and thresholds at which small partitions count as skewed."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4k",
        spark__sql__shuffle__partitions="16",
    )


def test_row_level_join_splits_a_hot_key(spark, shuffled, tmp_path):
    path = str(tmp_path / "orders")
    hot_orders(spark).repartition(8).write.parquet(path)
    joined = sales.orders_with_employee(spark.read.parquet(path), staff(spark))
    joined.collect()
    assert "SortMergeJoin(skew=true)" in plan_of(joined)
    assert joined.count() == 30000
    attempts = spark.read.parquet(path).select(
        F.col("orderID").alias("attempt_id"), F.when(F.col("orderID") >= 0, "Cashier").alias("role"),
        F.col("employeeID").cast("string").alias("passcode"),
    )
    checked = audit.login_audit(attempts, staff(spark))
    assert len(checked.collect()) == 30000
    assert "skew=true" in plan_of(checked)
    assert checked.where("granted").count() == 30000


def test_hot_recipe_and_hot_name_are_spread(spark, shuffled, conf, tmp_path):
    """A third of the recipe rows belong to one menu item, a third of the stock has one name."""
    conf(
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__skewJoin__enabled="false",
        spark__sql__shuffle__partitions="64",
    )
    n = 9000
    hot = F.col("id") % 3 == 0
    recipe = spark.range(n).select(
        F.when(hot, 0).otherwise(F.col("id") % 500 + 1).alias("menuID"),
        F.col("id").alias("inventoryID"),
        F.lit(2).cast("decimal(18,2)").alias("menuInfoQuantity"),
    )
    stock = spark.range(n).select(
        F.col("id").alias("inventoryID"),
        F.when(hot, "Ice").otherwise(F.concat(F.lit("I"), F.col("id").cast("string"))).alias("inventoryName"),
        F.lit("oz").alias("unit"),
        F.lit(1).cast("decimal(18,2)").alias("quantityAvailable"),
    )
    for name, table in (("recipe", recipe), ("stock", stock)):
        table.repartition(8).write.parquet(str(tmp_path / name))
    recipe, stock = (spark.read.parquet(str(tmp_path / name)) for name in ("recipe", "stock"))
    lines = spark.range(501).select(
        F.col("id").alias("menuID"), F.lit(3).cast("decimal(18,2)").alias("quantityPurchased")
    )
    used = joins.recipe_with_sales(recipe, lines)
    assert rows(used.agg(F.count("*"), F.sum(F.col("quantitySold") * F.col("menuInfoQuantity")))) == [(n, 6 * n)]
    raised = mutations.apply_restock(stock, spark.createDataFrame([("Ice", 5)], "inventoryName string, addAmount int"))
    assert rows(raised.agg(F.count("*"), F.sum("quantityAvailable"))) == [(n, n + 5 * n // 3)]
    for result in (used, raised):
        result.collect()
        plan = plan_of(result)
        assert "_salt" in plan and largest_task(result) < n / 6


def largest_task(df):
    """Rows of the largest partition of a result."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_reports_aggregate_before_they_join(spark, shuffled):
    """The join input is an aggregate, so the hot employee is one row in it."""
    plan = plan_of(sales.revenue_by_employee(hot_orders(spark), staff(spark)))
    above, below = plan.split("SortMergeJoin", 1)
    assert below.count("partial_sum(orderTotal") == 1 and "partial_sum(orderTotal" not in above
    assert "skew=true" not in plan


def test_reports_on_hot_keys_are_right(spark, shuffled):
    orders = hot_orders(spark)
    found = {r[0]: (r[1], r[2]) for r in rows(sales.avg_order_by_employee(orders, staff(spark)))}
    hot = [i % 97 for i in range(0, 30000, 3)]
    count, average = found["E1"]
    assert count == 10000 and float(average) == pytest.approx(sum(hot) / 10000, abs=0.005)
    assert sum(n for n, _ in found.values()) == 30000
    day = dt.date(2025, 6, 23)
    on_day = 10000 + sum(1 for i in range(30000) if i % 3 and i % 300 == 173)
    assert reports.range_totals(orders, day, day).first()["totalOrders"] == on_day


def test_numbering_shares_a_hot_day_over_the_tasks(spark, conf, tmp_path):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="8")
    numbered = number_rows(hot_orders(spark), ["orderDate", "orderID"])
    assert rows(numbered.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq"))) == [(0, 29999, 30000)]
    folder = numbered.inputFiles()
    sizes = [spark.read.parquet(f).count() for f in folder]
    assert max(sizes) < 30000 / 8 * 2


def test_numbering_survives_a_second_read(spark):
    """The numbers are data in a table: another evaluation cannot change them."""
    numbered = number_rows(hot_orders(spark, 3000).repartition(7), ["orderDate", "orderID"])
    assert sorted(rows(numbered)) == sorted(rows(numbered.repartition(3)))


def test_line_keys_are_unique_in_the_driver_tables(spark):
    lines = star.lines(spark, FOLDER)
    assert lines.select("orderItemID").distinct().count() == lines.count()
