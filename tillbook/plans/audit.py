"""Batch check of login attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.operators.joins import spread_join


def login_audit(attempts: DataFrame, employee: DataFrame) -> DataFrame:
    """Whether each attempt's passcode is that of some employee of its role.

    The match is exact. Passcodes do not appear in the result. The credentials are made
    distinct, so an attempt stays one row; the attempts with one passcode share several tasks.
    """
    known = (
        employee.select(F.col("employeePosition").alias("role"), F.col("employeePasscode").alias("passcode"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    checked = spread_join(attempts, known, ["role", "passcode"], spread="attempt_id", how="left")
    return checked.select("attempt_id", "role", F.col("_known").isNotNull().alias("granted"))
