"""A shared folder that is named without a scheme, in sessions whose executors run on the driver's machine."""

from types import SimpleNamespace

import pytest
from pyspark.sql.conf import RuntimeConfig

import __spark_entry__ as entry_points
from tests.conftest import at, rows
from tillbook.sources.workspace import scratch_path, shared_folder

QUERIES = entry_points.QUERIES


def session_on(spark, master, folder, default_store=None):
    named = {"fs.defaultFS": default_store} if default_store else {}
    hadoop = SimpleNamespace(hadoopConfiguration=lambda: named)
    return SimpleNamespace(
        conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master, applicationId="app", _jsc=hadoop)
    )


def test_a_bare_path_is_shared_by_executors_of_one_machine(spark):
    assert shared_folder(session_on(spark, "local-cluster[3,2,1024]", "/tmp/x/")) == "file:///tmp/x"
    assert shared_folder(session_on(spark, "local-cluster[3,2,1024]", "/x", "hdfs://n")) == "/x"
    assert shared_folder(session_on(spark, "local[4]", "/tmp/x")) == "/tmp/x"
    for master in ("spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(session_on(spark, master, "/tmp/x"))
    with pytest.raises(ValueError):
        shared_folder(session_on(spark, "local-cluster[3,2,1024]", "x"))


@pytest.fixture(scope="module")
def star_folder(spark, tmp_path_factory):
    """A few rows of each table that the queries below read."""
    folder = str(tmp_path_factory.mktemp("star"))
    of = {
        "nation": ([(n, f"NATION {n}") for n in range(25)], "n_nationkey int, n_name string"),
        "customer": ([(c, f"Customer {c}", "FURNITURE") for c in range(1, 9)], "c_custkey bigint, c_name string, c_mktsegment string"),
        "supplier": (
            [(s, f"Supplier {s}", s % 25, 100.0 * s) for s in range(1, 5)],
            "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        ),
        "part": (
            [(p, f"Part {p}", f"Brand {p}", "TIN", p % 50, 900.0 + p) for p in range(1, 13)],
            "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        ),
        "orders": (
            [(o, o % 8 + 1, 10.5 * o, at(f"199{7 + o % 2}-0{o % 9 + 1}-03")) for o in range(1, 31)],
            "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
        ),
        "lineitem": (
            [
                (o, (o + n) % 12 + 1, (o + n) % 4 + 1, n, 1.0 * n, 9.25 * n, 0.05, at(f"1997-0{o % 9 + 1}-05"))
                for o in range(1, 31) for n in range(1, o % 4 + 2)
            ],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_discount double, l_shipdate timestamp_ntz",
        ),
        "events": (
            [
                (e, at(f"2024-01-{8 + e % 6:02d}T{e % 24:02d}:15"), e % 8 + 1, ("purchase", "error", "view")[e % 3], 2.5 * e)
                for e in range(1, 61)
            ],
            "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
        ),
    }
    for name, (held, schema) in of.items():
        spark.createDataFrame(held, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", [
    "c04_submit_orders", "j07_colocated", "q18_colocated", "r08_rollup_top_items", "r08_rollup_totals", "s01_order_feed",
    "r13_rollup_usage", "s03_staged_load", "s02_menu_feed", "s04_table_versions", "t01_order_intake",
    "t02_live_hourly_sales", "t03_live_day_totals", "w05_restock_blocks", "w08_append_orders",
])
def test_queries_run_with_a_bare_path_on_local_cluster(spark, star_folder, tmp_path, monkeypatch, name):
    expected = sorted(rows(QUERIES[name](spark, star_folder)), key=repr)
    get = RuntimeConfig.get
    monkeypatch.setattr(
        RuntimeConfig, "get", lambda self, key, *default: str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *default)
    )
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,512]")
    assert scratch_path(spark, "x").startswith(f"file://{tmp_path}/x-")
    assert expected and sorted(rows(QUERIES[name](spark, star_folder)), key=repr) == expected
    assert any(tmp_path.iterdir())
