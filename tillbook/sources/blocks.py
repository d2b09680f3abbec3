"""Tables in blocks of keys, of which a change rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys to a block: some hundred thousand rows make a file of a sensible size.
BLOCK = 250_000
_BLOCK = "key_block"


def _block(key: str, size: int) -> Column:
    return F.floor(F.col(key) / F.lit(size)).cast("long")


def save_blocks(table: DataFrame, folder: str, key: str, size: int = BLOCK) -> None:
    """Write a table with a numeric key as one folder for each block of ``size`` keys. Keys are unique, so a block's rows are bounded."""
    dealt = table.withColumn(_BLOCK, _block(key, size)).repartition(_BLOCK).sortWithinPartitions(key)
    dealt.write.mode("errorifexists").partitionBy(_BLOCK).parquet(folder)


def open_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop(_BLOCK)


def change_blocks(
    spark: SparkSession,
    folder: str,
    keys: DataFrame,
    key: str,
    change: Callable[[DataFrame], DataFrame],
    size: int = BLOCK,
) -> int:
    """Replace the blocks that hold any of ``keys`` by what ``change`` makes of their rows, and give their number.

    ``change`` is any of the row changes (an upsert, an update by key, an insert) that only touches those keys. Spark's dynamic
    partition overwrite moves the new blocks into place when all are written; files of other blocks stay as they are. A block that loses all
    its rows is an error, as the overwrite would leave it alone.
    """
    touched = sorted(row[0] for row in keys.where(F.col(key).isNotNull()).select(_block(key, size)).distinct().collect())
    if not touched:
        return 0
    old = spark.read.parquet(folder).where(F.col(_BLOCK).isin(touched)).drop(_BLOCK)
    new = change(old).withColumn(_BLOCK, _block(key, size))
    left = {row[0] for row in new.select(_BLOCK).distinct().collect()}
    if not left >= {row[0] for row in old.select(_block(key, size)).distinct().collect()}:
        raise ValueError("a block would be left without rows; write the table anew")
    if not left <= set(touched):
        raise ValueError(f"rows outside the blocks of the named {key}s")
    dealt = new.repartition(_BLOCK).sortWithinPartitions(key)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BLOCK).parquet(folder)
    return len(touched)
