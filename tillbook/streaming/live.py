"""Live versions of the day reports, and order intake from a stream.

No order is ever dropped for being late: nothing here has a watermark or keeps state in memory. What batches have to know of
earlier ones, and the partial sums of the reports, are tables of few parts (:mod:`tillbook.streaming.generations`).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillbook.functions.predicates import non_empty_orders
from tillbook.operators.sequence import number_rows
from tillbook.plans.cart import LOCATION, ORDER_OF_CARTS, ROTATION_IDS, orders_from, rotation_cashiers
from tillbook.schemas import MONEY, SCHEMAS
from tillbook.sources import files
from tillbook.streaming.generations import Generations

Partials = Callable[[DataFrame], DataFrame]

_PARTIAL_SUMS = [T.StructField("totalSales", T.DecimalType(38, 2)), T.StructField("totalOrders", T.LongType())]
HOURS = T.StructType([T.StructField("hourStart", T.TimestampNTZType()), *_PARTIAL_SUMS])
DAYS = T.StructType(
    [
        T.StructField("day", T.DateType()),
        *_PARTIAL_SUMS,
        T.StructField("firstOrder", T.TimestampNTZType()),
        T.StructField("lastOrder", T.TimestampNTZType()),
    ]
)
#: Where the ids of carts without a time are kept.
_NO_DAY = dt.date(1970, 1, 1)


def hour_partials(orders: DataFrame) -> DataFrame:
    """Sales and orders of each hour among these orders. An hour's orders are combined in the map tasks first, so the
    current hour is no hot spot."""
    hour = F.date_trunc("hour", "orderDate").cast("timestamp_ntz").alias("hourStart")
    return orders.groupBy(hour).agg(
        F.sum("orderTotal").cast("decimal(38,2)").alias("totalSales"), F.count("*").alias("totalOrders")
    )


def day_partials(orders: DataFrame) -> DataFrame:
    """Sales, orders, first and last order of each day among these orders."""
    return orders.groupBy(F.to_date("orderDate").alias("day")).agg(
        F.sum("orderTotal").cast("decimal(38,2)").alias("totalSales"),
        F.count("orderID").alias("totalOrders"),
        F.min("orderDate").alias("firstOrder"),
        F.max("orderDate").alias("lastOrder"),
    )


def merge_hours(partials: DataFrame) -> DataFrame:
    return partials.groupBy("hourStart").agg(
        F.sum("totalSales").cast("decimal(38,2)").alias("totalSales"), F.sum("totalOrders").alias("totalOrders")
    )


def merge_days(partials: DataFrame) -> DataFrame:
    return partials.groupBy("day").agg(
        F.sum("totalSales").cast("decimal(38,2)").alias("totalSales"),
        F.sum("totalOrders").alias("totalOrders"),
        F.min("firstOrder").alias("firstOrder"),
        F.max("lastOrder").alias("lastOrder"),
    )


_MERGES: dict[Partials, Partials] = {hour_partials: merge_hours, day_partials: merge_days}


def start_report(orders: DataFrame, partials: Partials, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the partial results of the micro-batches of ``orders`` below ``path``; a reader merges what is there.

    They are tables of :mod:`generations`: partials of neighbouring batches are merged, so a report that has run for long is read from few
    parts, with about as many rows as it has hours or days. A late order counts like any other.
    """
    spark, merge = orders.sparkSession, _MERGES[partials]

    def write(batch: DataFrame, batch_id: int) -> None:
        def own(folder: str) -> None:
            partials(batch).write.mode("overwrite").parquet(folder)

        def merged(folders: list[str], folder: str) -> None:
            merge(spark.read.parquet(*folders)).write.mode("overwrite").parquet(folder)

        Generations(spark, path, _owner(spark, checkpoint)).add(batch_id, own, merged)

    return _start(orders, write, checkpoint, trigger)


def _partials(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all parts that make up the table now."""
    parts = Generations(spark, path)
    folders = parts.folders(parts.latest())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def hourly_sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales and orders per hour from the partials so far; no rows before the first batch."""
    merged = merge_hours(_partials(spark, path, HOURS))
    return merged.select("hourStart", F.col("totalSales").cast(MONEY).alias("totalSales"), "totalOrders")


def day_totals(spark: SparkSession, path: str) -> DataFrame:
    """Sales, orders, first and last order of each day from the partials so far; no rows before the first batch."""
    merged = merge_days(_partials(spark, path, DAYS))
    sales = F.coalesce("totalSales", F.lit(0)).cast(MONEY).alias("totalSales")
    return merged.select("day", sales, "totalOrders", "firstOrder", "lastOrder")


def accepted_orders(spark: SparkSession, path: str) -> DataFrame:
    """All orders that an intake has written below ``path`` so far; no rows before the first batch."""
    return _written(spark, f"{path}/orders", SCHEMAS["ordertest"])


def _day() -> Column:
    return F.coalesce(F.to_date("orderDate"), F.lit(_NO_DAY)).alias("day")


def distinct_carts(carts: DataFrame) -> DataFrame:
    """One row per ``order_id`` and day of the order: the earliest, then the smallest. Carts without an id can't repeat, so all stay.

    Repeats are combined in the map tasks, so one cart that is sent again and again is not gathered.
    """
    fields = [c for c in carts.columns if c != "order_id"]
    first = F.struct("orderDate", *[c for c in fields if c != "orderDate"])
    known = carts.where("order_id is not null").groupBy("order_id", _day()).agg(F.min(first).alias("_first"))
    kept = known.select("order_id", *[F.col(f"_first.{c}").alias(c) for c in fields])
    return kept.unionByName(carts.where("order_id is null").select("order_id", *fields))


def start_intake(
    carts: DataFrame,
    orders: DataFrame,
    employee: DataFrame,
    path: str,
    checkpoint: str,
    rotation: Sequence[int] = ROTATION_IDS,
    location: str = LOCATION,
    **trigger,
) -> StreamingQuery:
    """Number the carts of a stream as orders that follow ``orders``. Every cart with lines becomes one order, whatever its time.

    A cart that comes again, in the same batch or a later one, is known by its id and the day of its order. The ids of accepted carts are
    a table of :mod:`generations` in ``path/accepted``, by day: a batch looks in few parts, at its own days there, however many batches
    came before. Orders go to ``path/orders/batch=n``; the next free id and the number of orders are noted with the ids.
    A micro-batch that runs again before it was done starts from the same note, does not see its own ids and replaces its own
    output, so ids stay dense and unique; one that was done is left alone.

    The numbering needs the batch once more as a table: ``path/numbered``, which the next batch replaces.
    """
    spark = carts.sparkSession
    cashiers = rotation_cashiers(employee, rotation)
    n_before, largest = orders.agg(F.count("*"), F.max("orderID")).first()
    kind = {f.name: f.dataType for f in SCHEMAS["ordertest"]}
    known = T.StructType([carts.schema["order_id"], T.StructField("day", T.DateType()), T.StructField("span", T.StringType())])
    day = _day()

    def read_ids(folders: list[str]) -> DataFrame:
        return spark.read.schema(known).option("basePath", f"{path}/accepted").parquet(*folders).select("order_id", "day")

    def merged(folders: list[str], folder: str) -> None:
        # A day that holds very many orders is split over several files.
        ids = read_ids(folders).repartitionByRange("day", "order_id").sortWithinPartitions("day", "order_id")
        ids.write.mode("overwrite").partitionBy("day").parquet(folder)

    def append(batch: DataFrame, batch_id: int) -> None:
        ids = Generations(spark, f"{path}/accepted", _owner(spark, checkpoint))
        if ids.done(batch_id):
            return
        before = ids.latest()
        first_id, n_existing = before.note.get("first_id", (largest or 0) + 1), before.note.get("n_orders", n_before)
        new = distinct_carts(non_empty_orders(batch).select("order_id", "orderDate", "total")).select("*", day)
        if before.spans:
            # A day of the calendar is one row here, however many orders it has.
            days = [row[0] for row in batch.select(day).distinct().collect()]
            looked = [f"{part}/day={d}" for part in ids.folders(before) for d in days]
            looked = [folder for folder in looked if files.exists(spark, folder)]
            if looked:
                new = new.join(read_ids(looked), ["order_id", "day"], "left_anti")
        numbered = number_rows(new, ORDER_OF_CARTS, path=f"{path}/numbered")
        rows = orders_from(numbered, cashiers, first_id, n_existing, location)
        count = Observation()
        rows = rows.select([F.col(name).cast(kind[name]) for name in kind]).observe(count, F.count("*").alias("n"))
        rows.write.mode("overwrite").parquet(f"{path}/orders/batch={batch_id}")

        def own(folder: str) -> dict:
            accepted = numbered.where("order_id is not null").select("order_id", "day")
            accepted.write.mode("overwrite").partitionBy("day").parquet(folder)
            added = count.get["n"]
            return {"first_id": first_id + added, "n_orders": n_existing + added}

        ids.add(batch_id, own, merged)

    return _start(carts, append, checkpoint, trigger)


def _owner(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps over restarts from its checkpoint."""
    return json.loads(files.read_text(spark, f"{checkpoint}/metadata"))["id"]


def _start(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What batches have written below ``path``: empty if there are none yet."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").select(schema.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
