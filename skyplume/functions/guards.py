"""What counts as a measurement: neither null nor NaN nor infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """False for null, NaN and infinite values; never null. Spark holds NaN above every number, so comparisons need this."""
    # 0 times NaN or infinity is NaN, which is not 0; one use of ``x`` keeps plans small.
    return F.coalesce(x.cast("double") * 0 == 0, F.lit(False))


def finite(x: Column) -> Column:
    """``x`` as a double where it is finite, else null: aggregates then skip it."""
    x = x.cast("double")
    return F.when(x * 0 == 0, x)


def above(x: Column, threshold: Column | float) -> Column:
    """x > threshold; false for null and NaN."""
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (x > threshold), F.lit(False))


def below(x: Column, threshold: Column | float) -> Column:
    """x < threshold; false for null and NaN."""
    return F.coalesce(x.cast("double") < threshold, F.lit(False))
