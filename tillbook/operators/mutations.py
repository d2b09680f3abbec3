"""Row changes as functions from the old table to the new one.

The caller writes the result to a new path or version; a file that is being read cannot be
overwritten.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.columns import col
from tillbook.functions.dates import date_literal, iso_date
from tillbook.functions.numbers import to_int, to_long, to_money
from tillbook.operators.constraints import require_none, require_unique, used_keys
from tillbook.operators.joins import spread_join


def upsert(target: DataFrame, staging: DataFrame, key: str, checked: bool = False) -> DataFrame:
    """Replace the rows whose key is staged, keep the others, add the new ones.

    A missing or repeated staged key is an error; ``checked`` says that there is none.
    """
    if not checked:
        require_unique(staging, key, "staging")
    kept = target.join(staging.select(key), key, "left_anti")
    return kept.select(*target.columns).unionByName(staging.select(*target.columns))


def insert_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Add rows; a missing, repeated or already used key is an error.

    Columns that the new rows lack become NULL.
    """
    require_unique(new, key, "inserted rows")
    require_none(used_keys(table, new, key), f"{key} already in use")
    return table.unionByName(new, allowMissingColumns=True)


def season_bound(text: str | Column, default: Column) -> Column:
    """Start of the day in ``text``, or of ``default`` when the text is blank.

    Text that is no ISO date fails.
    """
    raw = col(text)
    bad = F.raise_error(F.concat(F.lit("not a yyyy-MM-dd date: "), raw)).cast("date")
    blank = raw.isNull() | (F.trim(raw) == "")
    return F.when(blank, default).otherwise(F.coalesce(iso_date(raw), bad)).cast("timestamp_ntz")


def menu_rows(form: DataFrame, as_of: dt.date) -> DataFrame:
    """Menu rows from form text: menuID, menuName, category, price, menuDescription,
    seasonalStart, seasonalEnd. Blank bounds give the whole year of ``as_of``; a bad number
    or date fails."""

    def number(column: str, parse) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"{column} must be a number: "), F.coalesce(column, F.lit("NULL"))))
        parsed = parse(column)
        return F.coalesce(parsed, bad.cast("bigint") if column == "menuID" else bad.cast("decimal(18,2)"))

    return form.select(
        number("menuID", to_long).alias("menuID"),
        "menuName",
        "category",
        number("price", to_money).alias("price"),
        "menuDescription",
        season_bound("seasonalStart", date_literal(dt.date(as_of.year, 1, 1))).alias("seasonalStart"),
        season_bound("seasonalEnd", date_literal(dt.date(as_of.year, 12, 31))).alias("seasonalEnd"),
    )


def _violations(form: DataFrame, problems: dict[str, Column]) -> DataFrame:
    """Rows with a problem, and the names of the fields that have one."""
    named = F.concat_ws(", ", *[F.when(bad, F.lit(field)) for field, bad in problems.items()])
    return form.select("*", named.alias("problems")).where(F.col("problems") != "")


def _blank(field: str) -> Column:
    return F.coalesce(F.trim(field), F.lit("")) == ""


def form_violations(form: DataFrame) -> DataFrame:
    """Rows of the form for new menu items with a number or date that cannot be read, and what is wrong with them."""

    def bad_bound(field: str) -> Column:
        return ~_blank(field) & iso_date(field).isNull()

    return _violations(
        form,
        {
            "menuID": to_long("menuID").isNull(),
            "price": to_money("price").isNull(),
            "seasonalStart": bad_bound("seasonalStart"),
            "seasonalEnd": bad_bound("seasonalEnd"),
        },
    )


def employee_form_violations(form: DataFrame) -> DataFrame:
    """Rows of the form for new employees whose id is no whole number, or that leave a name, position or passcode out."""
    texts = ("employeeName", "employeePosition", "employeePasscode")
    return _violations(form, {"employeeID": to_long("employeeID").isNull(), **{field: _blank(field) for field in texts}})


def menu_change_violations(form: DataFrame) -> DataFrame:
    """Rows of the form that changes menu items whose id or price cannot be read, or that leave the name or category out."""
    problems = {"menuID": to_long("menuID").isNull(), "menuName": _blank("menuName"), "category": _blank("category")}
    return _violations(form, {**problems, "price": to_money("price").isNull()})


def restock_violations(form: DataFrame) -> DataFrame:
    """Rows of the restock form whose amount is no whole number."""
    return _violations(form, {"addAmount": to_int("addAmount").isNull()})


def insert_menu_items(menu: DataFrame, form: DataFrame, as_of: dt.date) -> DataFrame:
    """Add menu items from form text; columns the form lacks (the image) become NULL."""
    require_none(form_violations(form), "menu form")
    return insert_rows(menu, menu_rows(form, as_of), "menuID")


def update_by_key(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Set ``columns`` on the rows whose key has a change; other changes do nothing."""
    require_unique(changes, key, "changes")
    new = changes.select(key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, key, "left")
    changed = F.col("_changed").isNotNull()
    return joined.select(
        *[
            F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in table.columns
        ]
    )


def apply_restock(inventory: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add each delta's ``addAmount`` to every item of its ``inventoryName``.

    Amounts are whole numbers and may be negative; names not in stock do nothing. Items that
    share a name are spread over several tasks.
    """
    per_name = deltas.groupBy("inventoryName").agg(F.sum("addAmount").alias("_delta"))
    kind = inventory.schema["quantityAvailable"].dataType
    raised = F.col("quantityAvailable") + F.coalesce("_delta", F.lit(0))
    joined = spread_join(inventory, per_name, ["inventoryName"], spread="inventoryID", how="left")
    return joined.withColumn("quantityAvailable", raised.cast(kind)).select(*inventory.columns)


def referenced_keys(keys: DataFrame, key: str, children: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Those of ``keys`` that some child table still points to."""
    found = keys.select(key).limit(0)
    for child, column in children:
        found = found.unionByName(used_keys(child, keys, key, column))
    return found.distinct()


def delete_by_key(
    table: DataFrame, keys: DataFrame, key: str, children: Sequence[tuple[DataFrame, str]] = (),
    strict: bool = False,
) -> DataFrame:
    """Remove the rows with the given keys.

    A key that a child table still points to is refused: its row stays, and with
    ``strict`` the call fails. Keys that are not in the table do nothing.
    """
    refused = referenced_keys(keys, key, children)
    if strict:
        require_none(refused, f"{key} is still referenced")
    doomed = keys.select(key).distinct().join(refused, key, "left_anti")
    return table.join(doomed, key, "left_anti").select(*table.columns)
