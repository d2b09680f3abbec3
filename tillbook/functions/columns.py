"""Column arguments: a name or an expression."""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Union[Column, str]


def col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value
