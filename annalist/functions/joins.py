"""Joins whose keys may be null: null equals null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on `keys` with null equal to null and keeps the left's key columns; `<=>` stays an equi-join for Spark.

    The right side's keys are renamed first, so frames derived from one another can be joined.
    """
    r = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on: Column | None = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = eq if on is None else on & eq
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])
