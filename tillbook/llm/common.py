"""What the operators of this subpackage share: reading tables, stored intermediates, row functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillbook.sources.workspace import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there.

    What depends on it is then neither computed twice nor changed by a lost executor, and Spark knows its size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_function(returns: T.DataType, prepare: Callable[[], Callable]) -> Callable[..., Column]:
    """A function of one column that runs in Arrow batches. ``prepare`` builds, once in a task, the function of one value.

    It counts as nondeterministic, which keeps Spark from evaluating it for a filter and once more for the output.
    """
    arrow = to_arrow_type(returns)

    def batches(parts):
        of = prepare()
        for values in parts:
            yield pa.array([of(value) for value in values.to_pylist()], type=arrow)

    batches.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, returns).asNondeterministic()


def words_of(text: str | None) -> list[bytes]:
    """The words between white space (space, x09 to x0D) as UTF-8, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


_PLACES = 1 << 40


def hash_place(key: str) -> Column:
    """A place for each key that spreads evenly whatever the keys are; samples take the first places."""
    return F.pmod(F.xxhash64(key), F.lit(_PLACES))


def among_first(key: str, rows: int, n: Column) -> Column:
    """True for about twice ``rows`` of ``n`` rows, those with the first places: among them the first ``rows`` are then sought by a
    sort that is no larger in a large corpus. Of up to twice ``rows`` all are taken."""
    return hash_place(key) * n.cast("double") <= F.lit(2.0 * rows * _PLACES)


#: Bits of a filter of ids: 4 MB, whatever their number.
FILTER_BITS = 25


def likely_members(rows: DataFrame, ids: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Those of ``rows`` whose ``column`` may be among the ``ids``, and few others: for a semi-join to follow.

    A Bloom filter of fixed size, so the join shuffles little but its result while the ids are up to a few millions. With more ids
    more rows pass, all of them in the end; none that belongs is ever lost. Null is never a member.
    """

    def places(name: str) -> list[Column]:
        return [F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(1 << bits)) for seed in range(3)]

    place = ids.where(F.col(column).isNotNull()).select(F.explode(F.array(*places(column))).alias("place"))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("set")).toArrow()
    filled = np.zeros(1 << bits >> 6, np.int64)
    filled[words.column("word").to_numpy()] = words.column("set").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(filled)

    def may_be(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        found = True
        for at in (a, b, c):
            at = at.to_numpy()
            found = found & (sent.value[at >> 6] >> (at & 63) & 1 == 1)
        return pa.array(found)

    may_be.__annotations__ = dict.fromkeys((*"abc", "return"), pa.Array)
    known = F.arrow_udf(may_be, T.BooleanType())(*places(column))
    return rows.where(F.col(column).isNotNull() & known)
