"""Key checks. Parquet enforces none, so loads and mutations run these first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A key rule is broken; the message says which one and shows some offending keys."""


def pk_violations(table: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that are missing or not unique, with their number of rows."""
    columns = [key] if isinstance(key, str) else list(key)
    missing = F.lit(False)
    for column in columns:
        missing = missing | F.col(column).isNull()
    return table.groupBy(*columns).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | missing)


def used_keys(table: DataFrame, keys: DataFrame, key: str, column: str | None = None) -> DataFrame:
    """Those of the few ``keys`` that occur in a ``column`` of a large table.

    The table is filtered by the keys, not the keys by the table: Spark broadcasts the keys if they are small, and then no row of
    the table is shuffled but those that match, which are combined first. Keys that are many but filtered from a stored table become a Bloom
    filter at run time (``spark.sql.optimizer.runtime.bloomFilter.enabled``, on by default), again before the table is shuffled.
    """
    own = table.select(F.col(column or key).alias(key))
    return own.join(keys.select(key), key, "left_semi").distinct()


def fk_violations(child: DataFrame, parent: DataFrame, column: str, parent_key: str | None = None) -> DataFrame:
    """Keys without a parent, with their number of child rows. A NULL key is allowed.

    Children are counted per key before the join: a hot key is a single row there. Parents are first cut down to the
    children's keys.
    """
    counts = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    return counts.join(used_keys(parent, counts, column, parent_key), column, "left_anti")


def require_none(violations: DataFrame, rule: str, shown: int = 5) -> None:
    """Raise :class:`ConstraintError` if there is any violation; shows ``shown`` of them."""
    found = violations.limit(shown).collect()
    if found:
        raise ConstraintError(f"{rule}: {[row.asDict() for row in found]}")


def require_all(checks: Mapping[str, DataFrame], shown: int = 5) -> None:
    """Like :func:`require_none` for many rules at once, in one job: the first rules that are broken, with some offending keys."""
    found = None
    for rule, violations in checks.items():
        keys = F.to_json(F.struct(*violations.columns))
        some = violations.limit(shown).select(F.lit(rule).alias("rule"), keys.alias("keys"))
        found = some if found is None else found.unionByName(some)
    broken = found.collect() if found is not None else []
    if broken:
        raise ConstraintError("; ".join(f"{row.rule}: {row['keys']}" for row in broken))


def require_unique(table: DataFrame, key: str, what: str) -> None:
    require_none(pk_violations(table, key), f"{what} has a missing or repeated {key}")
