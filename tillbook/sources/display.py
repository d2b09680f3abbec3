"""Results as text tables."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_display(df: DataFrame) -> DataFrame:
    """Every column as text; labels stay, and NULL stays NULL."""
    return df.select(*[F.col(f"`{name}`").cast("string").alias(name) for name in df.columns])
