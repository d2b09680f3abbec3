"""CSV feeds with a header line, bound to the table columns by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions.dates import parse_feed_timestamp
from tillbook.schemas import FEED_HEADERS, SCHEMAS

# Fixed value: how feeds spell timestamps when written.
FEED_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def read_feed(spark: SparkSession, table: str, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of a feed in the schema of its table; any malformed row fails the read.

    An empty field is NULL; the text ``None`` is text. ``multi_line`` allows line breaks inside
    quotes, at the price of one task per file.
    """
    schema = SCHEMAS[table]
    is_time = {f.name: isinstance(f.dataType, T.TimestampNTZType) for f in schema}
    raw_schema = T.StructType(
        [T.StructField(f.name, T.StringType() if is_time[f.name] else f.dataType) for f in schema]
    )
    raw = (
        spark.read.schema(raw_schema)
        .options(header=True, quote='"', escape='"', encoding="UTF-8", mode="FAILFAST",
                 enforceSchema=True, columnPruning=False, multiLine=multi_line)
        .csv(path)
    )
    # Always true, but it needs every column: a bad field is found whatever the caller selects.
    whole_rows = raw.where(F.hash(*raw.columns).between(-(2**31), 2**31 - 1))
    return whole_rows.select(
        *[parse_feed_timestamp(f.name).alias(f.name) if is_time[f.name] else F.col(f.name) for f in schema]
    )


def write_feed(df: DataFrame, table: str, path: str, mode: str = "errorifexists") -> None:
    """Write a table as a feed: one CSV file per partition, each with the feed's header."""
    fields = SCHEMAS[table]
    header = FEED_HEADERS[table]
    (
        df.select(*[F.col(f.name).alias(title) for f, title in zip(fields, header)])
        .write.mode(mode)
        .options(header=True, quote='"', escape='"', encoding="UTF-8",
                 timestampNTZFormat=FEED_TIMESTAMP, timestampFormat=FEED_TIMESTAMP)
        .csv(path)
    )
