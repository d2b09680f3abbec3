"""Orders, lines and modifications in buckets, so that their joins and groups on the order or the line need no shuffle.

Lines are kept twice, by order and by line: each join finds both its sides dealt alike. A bucket is read by one task and can't be split,
so a table of which one key holds more than ``HOT_SHARE`` is opened without its buckets, as are those it is joined with: Spark then shuffles
both sides, and adaptive execution splits the hot key.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.schemas import SCHEMAS
from tillbook.sources import files

#: Name in the result: table and bucket key. Both sides of a join belong to one layout.
LAYOUTS: dict[str, dict[str, tuple[str, str]]] = {
    "order": {"ordertest": ("ordertest", "orderID"), "orderItem": ("orderItem", "orderID")},
    "line": {"orderItem_by_line": ("orderItem", "orderItemID"), "modification": ("modification", "orderItemID")},
}
BUCKETS, HOT_SHARE = 64, 0.02


def _hot(table: DataFrame, key: str) -> bool:
    counts = table.groupBy(key).agg(F.count("*").alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    return bool(most and most > 1000 and most > HOT_SHARE * total)


def save_colocated(
    tables: Mapping[str, DataFrame], root: str, name: str, buckets: int = BUCKETS, layouts: Sequence[str] = tuple(LAYOUTS)
) -> None:
    """Write the tables of the layouts in buckets below ``root/name``, sorted within them.

    ``buckets`` should make buckets of some hundred MB; each is one task of a join. A last small file says that all is there.
    """
    spark = next(iter(tables.values())).sparkSession
    hot = []
    for layout in layouts:
        for part, (table, key) in LAYOUTS[layout].items():
            if _hot(tables[table], key):
                hot.append(layout)
            dealt = tables[table].repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
            dealt.mode("overwrite").option("path", f"{root}/{name}/{part}").saveAsTable(_catalog_name(name, part))
    kinds = {part: tables[table].schema.simpleString() for layout in layouts for part, (table, _) in LAYOUTS[layout].items()}
    said = {"layouts": list(layouts), "buckets": buckets, "hot": hot, "schemas": kinds}
    files.write_text(spark, f"{root}/{name}/layout.json", json.dumps(said))


def _catalog_name(name: str, part: str) -> str:
    return f"colocated_{name}_{part}".lower()


def open_colocated(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """The tables, with the lines under ``orderItem`` (by order) and ``orderItem_by_line``. They are entered in the session's catalog under
    names of their own where they aren't yet, since only the catalog knows buckets."""
    said = json.loads(files.read_text(spark, f"{root}/{name}/layout.json"))
    opened = {}
    for layout in said["layouts"]:
        for part, (table, key) in LAYOUTS[layout].items():
            folder, entry = f"{root}/{name}/{part}", _catalog_name(name, part)
            if layout in said["hot"]:
                opened[part] = spark.read.parquet(folder)
                continue
            if not spark.catalog.tableExists(entry):
                columns = said["schemas"][part].removeprefix("struct<").removesuffix(">")
                spark.sql(
                    f"CREATE TABLE {entry} ({_sql_columns(columns)}) USING parquet "
                    f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {said['buckets']} BUCKETS LOCATION '{folder}'"
                )
            opened[part] = spark.table(entry)
    return opened


def _sql_columns(columns: str) -> str:
    """``a:bigint,b:decimal(18,2)`` as SQL columns."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return ", ".join("`{}` {}".format(*column.split(":", 1)) for column in out)


def drop_colocated(spark: SparkSession, name: str) -> None:
    """Take the tables out of the session's catalog; their files stay."""
    for parts in LAYOUTS.values():
        for part in parts:
            spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(name, part)}")
