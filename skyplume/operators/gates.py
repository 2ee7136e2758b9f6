"""Checks that stop a job, or only warn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gated(df: DataFrame, holds: Column, message: str, required: bool = True) -> DataFrame:
    """``df`` with ``warned``, true where ``holds`` is not; a row that fails ends the job with ``message`` if ``required``."""
    fails = ~F.coalesce(holds, F.lit(False))
    return df.withColumn("warned", F.when(fails, F.raise_error(F.lit(message)).cast("boolean") if required else F.lit(True)).otherwise(F.lit(False)))
