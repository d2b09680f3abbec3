"""A relational database as a source. Needs the database's driver jar on the class path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A table over JDBC.

    With a numeric or time column, its bounds and a number of partitions, that many tasks
    read it in parallel; without, one task reads all of it.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its bounds")
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=partitions,
        )
    return reader.load()
