"""Numbers that have a default where there is nothing to measure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_or(values: Column, q: float, default: float = float("nan")) -> Column:
    """Percentile (0 to 100, interpolated) of a group's values; the default for none."""
    return F.coalesce(F.percentile(values, q / 100), F.lit(default))


def ratio_or(top: Column, bottom: Column, default: float = float("nan")) -> Column:
    """top / bottom; the default where there is no top, or bottom is 0 within 1e-12."""
    return F.when(top.isNull() | (F.abs(bottom) < 1e-12), F.lit(default)).otherwise(F.try_divide(top, bottom))
