"""The joins of the model. All are inner.

No join carries a broadcast hint. Spark broadcasts a side only when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both otherwise; adaptive
execution then splits a shuffle partition that one hot key has filled. Reports that
aggregate do so before they join (:func:`aggregate_by_attribute`), so a hot key is
one row by the time it is shuffled. Adaptive execution does not split a join whose other side
is an aggregate on the same key; those joins use :func:`spread_join`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_by_attribute(
    facts: DataFrame,
    dimension: DataFrame,
    on: str,
    by: Sequence[str],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Count or sum ``facts`` per attribute of a dimension they point to.

    ``measures`` maps an output name to a count or sum. Facts are combined per key first,
    inside the map tasks, so the join sees one row per key. Counts and sums both merge by
    adding, hence the result equals that of joining first.
    """
    per_key = facts.groupBy(on).agg(*[measure.alias(name) for name, measure in measures.items()])
    joined = per_key.join(dimension.select(on, *by), on)
    return joined.groupBy(*by).agg(*[F.sum(name).alias(name) for name in measures])


# Tasks that share the rows of one key in a spread join.
SPREAD = 8


def spread_join(
    many: DataFrame, single: DataFrame, on: Sequence[str], spread: str, how: str = "inner", tasks: int = SPREAD
) -> DataFrame:
    """Join rows (inner or left) to a side that has one row per key, such as an aggregate.

    The rows of every key are spread over ``tasks`` tasks by the column ``spread``, and the
    single side, which is the smaller one, is repeated that often. A task that still gets
    too much can be split further by adaptive execution.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(tasks)).cast("int"))
    repeated = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def with_employee(orders: DataFrame, employee: DataFrame) -> DataFrame:
    return orders.join(employee, "employeeID")


def with_location(orders: DataFrame, location: DataFrame) -> DataFrame:
    """Orders name their location; two locations of one name both match."""
    return orders.join(location, orders["orderLocation"] == location["locationName"])


def with_menu(lines: DataFrame, menu: DataFrame) -> DataFrame:
    return lines.join(menu, "menuID")


def lines_with_mods(lines: DataFrame, mods: DataFrame, menu: DataFrame) -> DataFrame:
    """One row per modification, with its line and menu item.

    The modification's own ``inventoryID`` is the one kept.
    """
    line = lines.select("orderItemID", "menuID", "orderID", "quantityPurchased", "priceAtPurchase")
    return mods.join(line, "orderItemID").join(menu, "menuID")


def mods_with_inventory(mods: DataFrame, inventory: DataFrame) -> DataFrame:
    return mods.join(inventory, "inventoryID")


def recipe_with_menu(recipe: DataFrame, menu: DataFrame) -> DataFrame:
    return recipe.join(menu, "menuID")


def orders_with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return orders.join(lines, "orderID")


def orders_with_item_counts(orders: DataFrame, lines: DataFrame, employee: DataFrame) -> DataFrame:
    """One row per order that has lines: its employee and its number of items."""
    counts = lines.groupBy("orderID").agg(F.sum("quantityPurchased").alias("total_items"))
    per_order = orders.select("orderID", "employeeID").join(counts, "orderID")
    return with_employee(per_order, employee)


def sold_lines(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines of the given (mostly filtered) orders."""
    return lines.join(orders.select("orderID", "orderDate"), "orderID")


def sold_items(lines: DataFrame, menu: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with their menu item and order time."""
    return with_menu(sold_lines(lines, orders), menu)


def used_ingredients(
    orders: DataFrame, lines: DataFrame, recipe: DataFrame, inventory: DataFrame
) -> DataFrame:
    """Per recipe row: the quantity sold of its menu item and the ingredient's attributes.

    Sold quantities are summed per menu item before the recipe fans them out, so the result
    has one row per recipe row, however many lines were sold.
    """
    return recipe_with_sales(recipe, sold_lines(lines, orders)).join(inventory, "inventoryID")


def recipe_with_sales(recipe: DataFrame, sold: DataFrame) -> DataFrame:
    """Recipe rows of the items sold, with the item's total ``quantitySold``. The rows of an
    item with a very long recipe are spread over several tasks."""
    per_item = sold.groupBy("menuID").agg(F.sum("quantityPurchased").alias("quantitySold"))
    return spread_join(recipe, per_item, ["menuID"], spread="inventoryID")


def on_same_day(orders: DataFrame, days: DataFrame, day: str = "sale_day") -> DataFrame:
    """Orders placed on one of the given days."""
    return orders.join(days, F.to_date(orders["orderDate"]) == days[day])


def pair_single_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both one-row inputs side by side; no row if either is empty.

    ``right`` is read as a scalar, so more than one row there is an error.
    """
    paired = left.withColumn("_right", right.select(F.struct("*")).scalar())
    return paired.where(F.col("_right").isNotNull()).select(
        *left.columns, *[F.col("_right")[name].alias(name) for name in right.columns]
    )
