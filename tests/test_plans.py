"""What the physical plans must and must not hold."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import money, rows
from tillbook.operators import constraints, mutations, ordering
from tillbook.operators.constraints import ConstraintError
from tillbook.operators.sequence import number_rows
from tillbook.plans import sales
from tillbook.sources import tables
from tillbook.sources.workspace import check_shared, in_one_process


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(plan):
    """The lines of an adaptive plan without what it was planned as at first, at any depth."""
    skipped = None
    for line in plan.split("\n"):
        depth = re.search(r"[^\s:|]", line)
        depth = depth.start() if depth else 0
        if skipped is not None and depth > skipped:
            continue
        skipped = depth if "== Initial Plan ==" in line else None
        if skipped is None:
            yield line


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A large and a small table as files, so that Spark knows their sizes."""
    root = str(tmp_path_factory.mktemp("sides"))
    spark.range(400_000).selectExpr("id as k", "id * 7 as v").write.parquet(f"{root}/big")
    spark.createDataFrame([(5,), (6,), (-1,)], "k long").write.parquet(f"{root}/small")
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("big", "small")}


def test_small_keys_are_broadcast_to_the_large_table(files, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="100k", spark__sql__adaptive__enabled="false")
    for df in (
        constraints.used_keys(files["big"], files["small"], "k"),
        mutations.referenced_keys(files["small"], "k", [(files["big"], "k")]),
        constraints.fk_violations(files["small"], files["big"], "k"),
    ):
        plan = plan_of(df)
        side = plan[: plan.index("/big")]
        # Between the scan of the large table and the join with its keys nothing is exchanged.
        assert "BroadcastHashJoin" in side
        assert "Exchange" not in side[side.rindex("BroadcastHashJoin") :]
    assert sorted(rows(constraints.used_keys(files["big"], files["small"], "k"))) == [(5,), (6,)]
    assert rows(constraints.fk_violations(files["small"], files["big"], "k")) == [(-1, 1)]


def test_key_checks_with_two_large_sides(files, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    big = files["big"]
    shifted = big.select((F.col("k") + 399_990).alias("k"))
    assert constraints.used_keys(big, shifted, "k").count() == 10
    assert constraints.fk_violations(shifted, big, "k").count() == 399_990
    with pytest.raises(ConstraintError):
        mutations.insert_rows(big, shifted.withColumn("v", F.lit(0)), "k")


def test_worst_day_scans_the_orders_twice(spark, shop, tmp_path):
    for name in ("ordertest", "orderItem", "menu"):
        shop[name].write.parquet(str(tmp_path / name))
    own = {name: spark.read.parquet(str(tmp_path / name)) for name in ("ordertest", "orderItem", "menu")}
    df = sales.worst_day_top_seller(own["ordertest"], own["orderItem"], own["menu"])
    assert rows(df)
    scans = [line for line in executed(plan_of(df)) if re.search(r"FileScan parquet \[[^]]*orderDate", line)]
    assert len(scans) == 2


def test_nth_row_gathers_no_rows(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_000 / 2).cast("int").alias("v"), "id")
    found = ordering.nth_row(df, "v", 500_001, ["id"])
    assert "TakeOrderedAndProject" not in plan_of(found) and "Limit" not in plan_of(found)
    ((v, i),) = rows(found)
    assert v == 250_000 and i * 7919 % 1_000_000 // 2 == v
    # Two rows share each value: the smaller id comes first.
    ((v0, i0),) = rows(ordering.nth_row(df, "v", 500_000, ["id"]))
    assert v0 == v and i0 < i


def test_numbering_replaces_a_given_table(spark, tmp_path):
    path = str(tmp_path / "numbered")
    for n in (5, 3):
        found = number_rows(spark.range(n), ["id"], path=path)
        assert sorted(rows(found)) == [(i, i) for i in range(n)]
    assert spark.read.parquet(path).count() == 3


def test_folders_that_machines_do_not_share_are_refused():
    assert in_one_process("local") and in_one_process("local[4]")
    assert not in_one_process("local-cluster[3,2,1024]") and not in_one_process("yarn")
    for folder, master, local_paths in (
        ("file:///tmp/x", "yarn", False), ("/tmp/x", "yarn", True), ("/tmp/x", "local-cluster[2,1,512]", True),
        ("FILE:/tmp/x", "spark://host:7077", False),
    ):
        with pytest.raises(ValueError):
            check_shared(folder, master, lambda: local_paths)  # noqa: B023
    for folder, master, local_paths in (
        ("hdfs://n/x", "yarn", True), ("/x", "yarn", False), ("/x", "local[2]", True),
        ("file:///tmp/x", "local-cluster[2,1,512]", True),
    ):
        check_shared(folder, master, lambda: local_paths)  # noqa: B023


def test_a_half_written_version_is_not_opened(spark, shop, tmp_path):
    root = str(tmp_path)
    tables.save_tables(shop, root, "one")
    shop["menu"].write.parquet(f"{root}/two/menu")
    with pytest.raises(ValueError):
        tables.open_tables(spark, root, "two")
    assert tables.latest_version(spark, root) == "one"
    tables.save_tables(shop, root, "three")
    assert tables.latest_version(spark, root) == "three"
    assert sorted(rows(tables.open_tables(spark, root)["ordertest"])) == sorted(rows(shop["ordertest"]))


def test_wide_ids_and_form_violations(spark, shop):
    form = spark.createDataFrame(
        [("3000000000", "Big", "Fresh Brew", "1.00", "x", "", "")],
        "menuID string, menuName string, category string, price string, menuDescription string, "
        "seasonalStart string, seasonalEnd string",
    )
    assert rows(mutations.form_violations(form)) == []
    added = mutations.insert_menu_items(shop["menu"], form, dt.date(2025, 1, 1))
    assert added.where("menuID = 3000000000").select("price").first()[0] == money("1.00")
    assert added.schema["menuID"].dataType.simpleString() == "bigint"

    staff = spark.createDataFrame(
        [("7", "A", "Cashier", "1"), ("x", None, " ", "2"), ("99999999999999999999", "B", "C", "")],
        "employeeID string, employeeName string, employeePosition string, employeePasscode string",
    )
    problems = [r[-1] for r in rows(mutations.employee_form_violations(staff))]
    assert problems == ["employeeID, employeeName, employeePosition", "employeeID, employeePasscode"]
    changes = spark.createDataFrame(
        [("1", "n", "c", "2.5"), (None, "", "c", "two")], "menuID string, menuName string, category string, price string"
    )
    assert [r[-1] for r in rows(mutations.menu_change_violations(changes))] == ["menuID, menuName, price"]
    restock = spark.createDataFrame([("a", "5"), ("b", "-2"), ("c", "1.5"), ("d", None)], "inventoryName string, addAmount string")
    assert [r[0] for r in rows(mutations.restock_violations(restock))] == ["c", "d"]
