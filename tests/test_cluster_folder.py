"""A local ``spark.checkpoint.dir`` on a cluster: taken where all machines share it, refused where they don't."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql.conf import RuntimeConfig

import __spark_entry__ as entry_points
from tests.conftest import rows
from tests.test_shared_folder import star_folder  # noqa: F401
from tillbook.sources import workspace

QUERIES = entry_points.QUERIES
CLUSTER = "spark://host:7077"


@pytest.fixture
def on_cluster(spark, tmp_path, monkeypatch):
    """From its call on, the session shows a cluster's master and has a folder that its tasks share, named without a scheme."""

    def begin(master=CLUSTER):
        get, folder = RuntimeConfig.get, str(tmp_path / "shared")
        monkeypatch.setattr(
            RuntimeConfig, "get", lambda self, key, *default: folder if key == "spark.checkpoint.dir" else get(self, key, *default)
        )
        monkeypatch.setattr(spark.sparkContext, "master", master)
        return folder

    return begin


@pytest.mark.parametrize("master", [CLUSTER, "yarn", "k8s://https://host:443"])
def test_a_folder_that_tasks_share_is_tried_once_and_taken(spark, on_cluster, tmp_path, master):
    folder = on_cluster(master)
    assert workspace.shared_folder(spark) == f"file://{folder}"
    assert workspace.scratch_path(spark, "x").startswith(f"file://{folder}/x-")
    assert len([path for path in (tmp_path / "shared").iterdir() if path.name.startswith("shared-")]) == 1


def test_a_disk_of_its_own_is_refused(spark, on_cluster, monkeypatch):
    on_cluster()
    write = DataFrameWriter.parquet
    # What a commit leaves on the driver's disk when tasks have written to theirs: all, or some of the rows missing.
    for kept in (0, 1):
        monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: write(spark.range(kept).write, path))  # noqa: B023
        with pytest.raises(ValueError, match="own disk"):
            workspace.shared_folder(spark)


def test_a_folder_that_tasks_cannot_write_is_refused(spark, on_cluster, tmp_path):
    on_cluster()
    (tmp_path / "shared").write_text("a file")
    with pytest.raises(ValueError, match="could not write"):
        workspace.shared_folder(spark)


@pytest.mark.parametrize("name", [
    "c04_submit_orders", "j07_colocated", "q18_colocated", "r08_rollup_top_items", "r08_rollup_totals",
    "r13_rollup_usage", "s01_order_feed", "s02_menu_feed", "s03_staged_load", "s04_table_versions", "t01_order_intake",
    "t02_live_hourly_sales", "t03_live_day_totals", "w05_restock_blocks", "w08_append_orders",
])
def test_queries_run_with_a_bare_path_on_a_cluster(spark, star_folder, on_cluster, name):  # noqa: F811
    expected = sorted(rows(QUERIES[name](spark, star_folder)), key=repr)
    on_cluster()
    assert expected and sorted(rows(QUERIES[name](spark, star_folder)), key=repr) == expected
