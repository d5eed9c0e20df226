"""Guarded arithmetic shared by the feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den rounded half-even to six places; 0.0 when den is not positive."""
    quotient = F.bround(num.cast("double") / den.cast("double"), 6)
    return F.when(den > 0, quotient).otherwise(F.lit(0.0))


def log_count(x: Column) -> Column:
    return F.bround(F.log1p(F.greatest(x, F.lit(0)).cast("double")), 6)


def flag(condition: Column) -> Column:
    """Null-safe boolean to 0/1."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def total(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out
