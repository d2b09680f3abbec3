"""The point-of-sale tables, read out of a TPC-H-like star schema in Parquet.

All of it is projection, but for the two small-table joins named below, and the recipe,
which is a distinct list. Whole tables are read, in the columns that the query asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tillbook.schemas import MONEY, QUANTITY


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A raw table."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without a location."""
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderID"),
        F.col("o_custkey").alias("employeeID"),
        F.col("o_orderdate").alias("orderDate"),
        F.col("o_totalprice").cast(MONEY).alias("orderTotal"),
    )


def locations(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select(
        F.col("n_nationkey").alias("locationID"), F.col("n_name").alias("locationName")
    )


def located_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the name of their location: one of the 25 nations, by employee number."""
    names = locations(spark, folder).select("locationID", F.col("locationName").alias("orderLocation"))
    numbered = orders(spark, folder).withColumn("locationID", (F.col("employeeID") % 25).cast("int"))
    return numbered.join(names, "locationID").drop("locationID")


def tick_total(event_type: str = "event_type", value: str = "value") -> Column:
    """Errors are returns and views are voids; anything else is a sale."""
    amount = F.when(F.col(event_type) == "error", -F.col(value)).when(F.col(event_type) == "view", F.lit(0.0))
    return amount.otherwise(F.col(value)).cast(MONEY)


def ticks_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("orderID"),
        F.col("user_id").alias("employeeID"),
        F.col("ts").alias("orderDate"),
        tick_total().alias("orderTotal"),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a time of day, returns and voids."""
    return ticks_of(read(spark, folder, "events"))


def position() -> Column:
    segment = F.col("c_mktsegment")
    return F.when(segment == "FURNITURE", "Cashier").when(segment == "MACHINERY", "Manager").otherwise(segment)


def passcode(shift: Column | int = 0) -> Column:
    """Four digits made from the customer key; ``shift`` gives another code."""
    return F.lpad(((F.col("c_custkey") * 7919 + shift) % 10000).cast("string"), 4, "0")


def employees(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("employeeID"),
        F.col("c_name").alias("employeeName"),
        position().alias("employeePosition"),
        passcode().alias("employeePasscode"),
    )


def line_id() -> Column:
    """Line key from the columns that tell lines of one order apart; no row needs another."""
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate")),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        line_id().alias("orderItemID"),
        F.col("l_partkey").alias("menuID"),
        F.col("l_extendedprice").cast(MONEY).alias("priceAtPurchase"),
        F.col("l_quantity").cast(QUANTITY).alias("quantityPurchased"),
        F.col("l_orderkey").alias("orderID"),
        (F.col("l_linenumber") % 3 - 1).alias("orderSize"),
    )


def modifications(spark: SparkSession, folder: str) -> DataFrame:
    """None, one or two modifications per line."""
    count = F.col("l_linenumber") % 3
    numbered = read(spark, folder, "lineitem").select(
        line_id().alias("orderItemID"),
        F.col("l_suppkey").alias("inventoryID"),
        F.col("l_discount").cast(MONEY).alias("cost"),
        F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias("n"),
    )
    return numbered.select(
        F.concat_ws("-", "orderItemID", "n").alias("modificationID"),
        "inventoryID",
        "orderItemID",
        F.col("n").cast(QUANTITY).alias("modificationQuantity"),
        "cost",
    )


def menu(spark: SparkSession, folder: str) -> DataFrame:
    """Menu items, with missing, plain and year-wrapping seasons among them."""
    start = F.make_date(F.lit(2024), F.col("p_size") % 12 + 1, F.lit(1)).cast("timestamp_ntz")
    end_month = ((F.col("p_size") + F.col("p_partkey")) % 12 + 1).cast("int")
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("menuID"),
        F.col("p_name").alias("menuName"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        F.col("p_size").alias("menuImage"),
        F.col("p_brand").alias("menuDescription"),
        F.when(F.col("p_partkey") % 10 != 0, start).alias("seasonalStart"),
        F.make_date(F.lit(2024), end_month, F.lit(15)).cast("timestamp_ntz").alias("seasonalEnd"),
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory items; the unit is the name of one of the 25 nations."""
    nations = read(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return read(spark, folder, "supplier").join(nations, "s_nationkey").select(
        F.col("s_suppkey").alias("inventoryID"),
        F.col("s_name").alias("inventoryName"),
        F.col("s_acctbal").cast(QUANTITY).alias("quantityAvailable"),
        (F.col("s_suppkey") % 7 - 3).cast("int").alias("restockOrdered"),
        F.col("n_name").alias("unit"),
        F.lit(2000).alias("restockMin"),
    )


def recipe(spark: SparkSession, folder: str) -> DataFrame:
    """Which inventory items a menu item uses: the part and supplier pairs of the lines."""
    pairs = read(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("menuID"), F.col("l_suppkey").alias("inventoryID")
    )
    quantity = (F.col("inventoryID") % 5 + 1).cast(QUANTITY)
    return pairs.distinct().withColumn("menuInfoQuantity", quantity)
