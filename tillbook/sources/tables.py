"""Catalog tables, Parquet versions and SQL views of the eight tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.schemas import LOAD_ORDER, SCHEMAS
from tillbook.sources import files


def create_tables(spark: SparkSession) -> None:
    """Create the tables that do not exist yet, as managed tables below ``spark.sql.warehouse.dir``. On a cluster that must be a
    folder that all executors share."""
    for name in LOAD_ORDER:
        if not spark.catalog.tableExists(name):
            spark.catalog.createTable(name, source="parquet", schema=SCHEMAS[name])


def drop_all(spark: SparkSession) -> None:
    """Drop every table, children before parents; a missing one is an error."""
    for name in reversed(LOAD_ORDER):
        spark.sql(f"DROP TABLE {name}")


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], SCHEMAS[name]) for name in LOAD_ORDER}


# Orders are kept in time order, so that a date range skips most of their row groups. The
# id splits a day or a moment that holds very many orders over several files.
CLUSTERING: dict[str, tuple[str, ...]] = {"ordertest": ("orderDate", "orderID")}


_VERSIONS = "version string, base string, written timestamp"


def save_tables(tables: Mapping[str, DataFrame], root: str, version: str, base: str | None = None) -> str:
    """Write one Parquet version of the tables; an existing version is an error.

    With a complete version as ``base``, ``tables`` needs to hold only what changed: the others are those of the base, and
    nothing of them is written again. The version is listed in ``root/versions`` when all its tables are there, so none is
    opened half-written.
    """
    spark = next(iter(tables.values())).sparkSession
    if base is not None:
        _lineage(spark, root, base)
    elif set(tables) != set(LOAD_ORDER):
        raise ValueError("a version without a base needs all tables")
    for name, table in tables.items():
        keys = CLUSTERING.get(name)
        if keys:
            table = table.repartitionByRange(*keys).sortWithinPartitions(*keys)
        table.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    listed = spark.createDataFrame([(version, base)], "version string, base string").withColumn("written", F.current_timestamp())
    listed.write.mode("append").parquet(f"{root}/versions")
    return f"{root}/{version}"


def latest_version(spark: SparkSession, root: str) -> str:
    """The version that was completed last."""
    return spark.read.schema(_VERSIONS).parquet(f"{root}/versions").agg(F.max_by("version", "written")).first()[0]


def _lineage(spark: SparkSession, root: str, version: str) -> list[str]:
    """The version, its base, the base's base, .. up to one that holds all tables."""
    bases = {row.version: row.base for row in spark.read.schema(_VERSIONS).parquet(f"{root}/versions").collect()}
    line = [version]
    while line[-1] is not None:
        if line[-1] not in bases:
            raise ValueError(f"version {line[-1]} under {root} is not complete")
        line.append(bases[line[-1]])
    return line[:-1]


def open_tables(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the latest if none is named. A version that is not complete is an error."""
    line = _lineage(spark, root, version or latest_version(spark, root))
    held = {v: set(files.names(spark, f"{root}/{v}")) for v in line}
    where = {name: next(v for v in line if name in held[v]) for name in LOAD_ORDER}
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{where[name]}/{name}") for name in LOAD_ORDER}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make the tables available to ``spark.sql`` under their names."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


# SQL spelling of the expressions that SQL users would otherwise miss. Catalyst inlines them.
SQL_FUNCTIONS: dict[str, str] = {
    "weekday_label": "(ts TIMESTAMP_NTZ) RETURNS STRING RETURN rpad(date_format(ts, 'EEEE'), 9, ' ')",
    "day_month_label": (
        "(day DATE) RETURNS STRING "
        "RETURN concat(date_format(day, 'dd '), rpad(date_format(day, 'MMMM'), 9, ' '))"
    ),
    "money_label": "(amount DECIMAL(38, 4)) RETURNS STRING RETURN format_string('$%,.2f', double(amount))",
}


def register_functions(spark: SparkSession) -> None:
    """Make the label functions available to ``spark.sql``."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
