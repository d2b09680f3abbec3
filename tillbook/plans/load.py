"""Load of the CSV feeds into the tables: stage, check, upsert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillbook.operators.constraints import ConstraintError, fk_violations, pk_violations, require_all
from tillbook.operators.mutations import upsert
from tillbook.schemas import FEED_FILES, FOREIGN_KEYS, LOAD_ORDER, PRIMARY_KEYS, SCHEMAS
from tillbook.sources.feeds import read_feed
from tillbook.sources.workspace import scratch_path


#: Feeds that are staged at the same time.
STAGED_AT_ONCE = 4


class Facts(NamedTuple):
    """What the write of a feed found on its way."""

    n_rows: int
    n_missing_keys: int
    least_key: int | None
    largest_key: int | None


def stage_with_facts(spark: SparkSession, table: str, path: str) -> tuple[DataFrame, Facts]:
    """A feed as a typed Parquet table in the shared folder, and its facts.

    One job: the text is parsed once, all of it is checked and counted as it is written, before any later step reads it.
    """
    staged, key = scratch_path(spark, f"staged-{table}"), PRIMARY_KEYS[table]
    seen = Observation()
    measures = (F.count("*"), F.count_if(F.col(key).isNull()), F.min(key), F.max(key))
    feed = read_feed(spark, table, path).observe(seen, *[m.alias(name) for m, name in zip(measures, Facts._fields)])
    feed.write.parquet(staged)
    return spark.read.schema(SCHEMAS[table]).parquet(staged), Facts(**seen.get)


def stage_feed(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A feed as a typed Parquet table in the shared folder. A row without its key is an error."""
    staged, facts = stage_with_facts(spark, table, path)
    if facts.n_missing_keys:
        raise ConstraintError(f"{table} has {facts.n_missing_keys} rows without {PRIMARY_KEYS[table]}")
    return staged


def stage_feeds(spark: SparkSession, folder: str, names: Sequence[str] = LOAD_ORDER) -> dict[str, DataFrame]:
    """The feeds of a folder, a few at the same time: small ones don't wait for the large ones' last tasks."""
    with ThreadPoolExecutor(STAGED_AT_ONCE) as pool:
        staged = pool.map(lambda name: stage_feed(spark, name, f"{folder}/{FEED_FILES[name]}"), names)
        return dict(zip(names, staged))


def load_tables(current: Mapping[str, DataFrame], staged: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """New version of every table after upserting the staged rows.

    A broken primary or foreign key fails the load before anything is written; one job checks all of them. An upsert
    removes no row, so only staged rows can break a foreign key, and each may point to an old or
    a staged parent.
    """
    checks = {f"{name} has a missing or repeated {PRIMARY_KEYS[name]}": pk_violations(staged[name], PRIMARY_KEYS[name]) for name in staged}
    for key in FOREIGN_KEYS:
        if key.child in staged:
            parent_key = PRIMARY_KEYS[key.parent]
            parents = current[key.parent].select(parent_key)
            if key.parent in staged:
                parents = parents.unionByName(staged[key.parent].select(parent_key))
            broken = fk_violations(staged[key.child], parents, key.column, parent_key)
            checks[f"{key.child}.{key.column} has no {key.parent}"] = broken
    require_all(checks)
    return {
        name: upsert(current[name], staged[name], PRIMARY_KEYS[name], checked=True) if name in staged else current[name]
        for name in LOAD_ORDER
    }
