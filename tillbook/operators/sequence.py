"""Dense numbering of a distributed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.sources.workspace import scratch_path

# monotonically_increasing_id() keeps the partition number above this bit and the row's
# place in its partition below it.
_PLACE_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str], name: str = "seq", path: str | None = None) -> DataFrame:
    """Add ``name`` = 0, 1, 2, ... in the order of ``order``, which should be unique.

    The rows are range-sorted, so all tasks share the work even when many rows have the same
    leading key. Each row's place in its partition is written out with the sorted
    rows to a table in the shared folder: a lost executor can then not renumber some of them.
    The partition sizes, one small row per partition, give the offset of each partition.

    The table goes to ``path``, replacing what is there; without one it gets a new folder, which stays as long
    as the result is in use and is the caller's to clear.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "numbered")
    ordered = df.orderBy(*[F.col(key).asc_nulls_last() for key in order])
    ordered.withColumn("_place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)

    placed = (
        spark.read.parquet(path)
        .withColumn("_part", F.shiftright("_place", _PLACE_BITS))
        .withColumn("_place", F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per partition of the sort: this window and this broadcast stay small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_offset")
    )
