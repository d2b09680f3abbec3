"""Cashier operators: drink customisation, cart totals, order intake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.labels import label_price, total_label
from tillbook.functions.numbers import sum_if
from tillbook.functions.predicates import is_rotation_cashier, non_empty_orders
from tillbook.operators.sequence import number_rows
from tillbook.schemas import MONEY

# Ingredients that can be left out and extras that can be added, in label
# order; the price of an extra; the rotation and the location of submitted orders.
BASE_INGREDIENTS = ("Milk", "Sugar", "Boba", "Ice")
EXTRAS = ("Aloe", "Pudding", "Jelly", "Extra Boba")
EXTRA_PRICE = "0.50"
ROTATION_IDS = (2, 3)
LOCATION = "College Station"


def _picked(column: str, choice: str) -> Column:
    return F.coalesce(F.array_contains(column, choice), F.lit(False))


def customise(lines: DataFrame) -> DataFrame:
    """Label and price of customised drinks, from ``name``, ``base`` and the lists ``removed``
    and ``extras``. Choices print in a fixed order; no choice gives ``name []``."""
    parts = [F.when(_picked("removed", c), F.lit(f"-{c} ")).otherwise("") for c in BASE_INGREDIENTS]
    parts += [F.when(_picked("extras", c), F.lit(f"+{c} ")).otherwise("") for c in EXTRAS]
    n_extras = sum((_picked("extras", c).cast("int") for c in EXTRAS), F.lit(0))
    price = F.col("base") + F.lit(EXTRA_PRICE).cast(MONEY) * n_extras
    return lines.select(
        "*",
        F.concat(F.ltrim("name"), F.lit(" ["), *parts, F.lit("]")).alias("description"),
        price.cast(MONEY).alias("price"),
    )


def order_totals(lines: DataFrame) -> DataFrame:
    """Total and label of each cart."""
    totals = lines.groupBy("order_id").agg(F.sum("price").alias("total"))
    return totals.select("order_id", "total", total_label("total").alias("label"))


def cart_totals(events: DataFrame) -> DataFrame:
    """Lines left and total of each cart, from its 'add' and 'remove' events.

    A remove drops one equal line and takes off the price in its label. The screen removes
    only lines that are there, so counts per label decide; removes beyond the adds of
    their label do nothing.
    """
    adding = F.col("op") == "add"
    per_label = events.groupBy("order_id", "label").agg(
        F.count(F.when(adding, 1)).alias("_adds"),
        F.count(F.when(F.col("op") == "remove", 1)).alias("_removes"),
        sum_if(adding, "price").alias("_added"),
    )
    dropped = F.least("_adds", "_removes")
    removed = F.coalesce(label_price("label"), F.lit(0)) * dropped
    return per_label.groupBy("order_id").agg(
        F.sum(F.col("_adds") - dropped).alias("n_lines"),
        F.sum(F.col("_added") - removed).cast(MONEY).alias("total"),
    )


def next_id(table: DataFrame, key: str) -> DataFrame:
    """One row with ``next_id``: one more than the largest key, 1 for an empty table."""
    return table.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def rotation_cashiers(employee: DataFrame, ids: Sequence[int] = ROTATION_IDS) -> list[int]:
    """Ids of the cashiers who take turns, ascending: at most ``len(ids)`` values."""
    on_duty = employee.where(is_rotation_cashier("employeePosition", "employeeID", ids))
    return sorted(row[0] for row in on_duty.select("employeeID").distinct().collect())


def assign_round_robin(numbered: DataFrame, cashiers: Sequence[int], start: int, seq: str = "seq") -> DataFrame:
    """Give row ``seq`` the cashier at place ``(start + seq) % n``; no cashier is an error."""
    if not cashiers:
        raise ZeroDivisionError("no cashier is on rotation")
    turn = ((F.col(seq) + F.lit(start)) % len(cashiers)).cast("int")
    ids = F.array(*[F.lit(c).cast("bigint") for c in cashiers])
    return numbered.withColumn("employeeID", F.get(ids, turn))


#: Carts become orders oldest first.
ORDER_OF_CARTS = ("orderDate", "order_id", "total")


def orders_from(
    numbered: DataFrame, cashiers: Sequence[int], first_id: int, n_existing: int, location: str = LOCATION
) -> DataFrame:
    """Orders from carts numbered by ``seq`` from 0: ids from ``first_id`` and cashiers in turn after ``n_existing`` earlier
    orders."""
    return assign_round_robin(numbered, cashiers, n_existing).select(
        (F.col("seq") + F.lit(first_id)).alias("orderID"),
        "employeeID",
        F.lit(location).alias("orderLocation"),
        "orderDate",
        F.col("total").alias("orderTotal"),
    )


def append_orders(
    orders: DataFrame, new: DataFrame, employee: DataFrame, rotation: Sequence[int] = ROTATION_IDS,
    location: str = LOCATION,
) -> DataFrame:
    """All orders with the new ones after them. One writer at a time may do this."""
    cashiers = rotation_cashiers(employee, rotation)
    count, largest = orders.agg(F.count("*"), F.max("orderID")).first()
    numbered = number_rows(new.select("order_id", "orderDate", "total"), ORDER_OF_CARTS)
    added = orders_from(numbered, cashiers, (largest or 0) + 1, count, location)
    casts = [F.col(f.name).cast(f.dataType) for f in orders.schema if f.name in added.columns]
    return orders.unionByName(added.select(*casts), allowMissingColumns=True)


def submit_orders(
    orders: DataFrame, carts: DataFrame, employee: DataFrame, rotation: Sequence[int] = ROTATION_IDS,
    location: str = LOCATION,
) -> DataFrame:
    """Append the carts (``order_id``, ``orderDate``, ``n_lines``, ``total``) that have lines."""
    return append_orders(orders, non_empty_orders(carts), employee, rotation, location)
