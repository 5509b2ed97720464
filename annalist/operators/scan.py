"""Running sums and row numbers over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from annalist.functions.joins import null_safe_join
from annalist.session import Scratch


def running_sum(scratch: Scratch, df: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before this one in its group, 0 for the first. `order` must be unique in a group.

    Rows are ranged by (group, order), so a large group spreads over neighbouring ranges; each range sums its own rows
    and takes what the earlier ranges of the group hold from a table of one row per group and range. Null group keys form
    a group, null values count as 0.
    """
    ranged = scratch.cut(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    v = F.coalesce(F.col(value), F.lit(0))
    inner = W.partitionBy(*group, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "__range").agg(F.sum(v).alias("__own"))
    outer = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.sum("__own").over(outer)).filter(F.col("__before").isNotNull()).drop("__own")
    rows = ranged.withColumn(name, F.coalesce(F.sum(v).over(inner), F.lit(0)))
    out = null_safe_join(rows, before, (*group, "__range"), "left")
    return out.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__before", "__range")


def row_numbers(scratch: Scratch, df: DataFrame, order: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """Adds dense numbers from 0 in the order of `order` over the whole frame."""
    one = df.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1).cast("long"))
    return running_sum(scratch, one, ["__all"], order, "__one", name).drop("__all", "__one")


#: Values of an order column that one slice covers; where they are unique, a slice holds no more rows.
SLICE = 1_000_000


def previous(df: DataFrame, group: Sequence[str], order: str, what: Column, name: str, width: int = SLICE) -> DataFrame:
    """Adds `name`: `what` of the row before in the group, null for the first. `order`: whole numbers, unique in a group.

    A group is worked on in slices of `width` numbers; the first row of a slice gets its neighbour from a table of one row
    per group and slice. `what` must not be null itself, or it counts as missing.
    """
    rows = df.withColumn("__slice", F.floor(F.col(order) / F.lit(width)).cast("long"))
    last = rows.groupBy(*group, "__slice").agg(F.max_by(what, F.col(order)).alias("__last"))
    carry = last.select(*group, "__slice", F.lag("__last").over(W.partitionBy(*group).orderBy("__slice")).alias("__carry")).filter(F.col("__carry").isNotNull())
    rows = rows.withColumn(name, F.lag(what).over(W.partitionBy(*group, "__slice").orderBy(order)))
    out = null_safe_join(rows, carry, (*group, "__slice"), "left")
    return out.withColumn(name, F.coalesce(name, "__carry")).drop("__carry", "__slice")


def numbered(df: DataFrame, group: Sequence[str], order: str, name: str, newest_first: bool = False, width: int = SLICE) -> DataFrame:
    """Adds `name`: 1, 2, ... within the group in order of `order` (whole numbers, unique in a group), by slices as `previous`."""
    rows = df.withColumn("__slice", F.floor(F.col(order) / F.lit(width)).cast("long"))
    way = (lambda c: F.col(c).desc()) if newest_first else (lambda c: F.col(c).asc())
    n = rows.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    outer = W.partitionBy(*group).orderBy(way("__slice")).rowsBetween(W.unboundedPreceding, -1)
    before = n.select(*group, "__slice", F.sum("__n").over(outer).alias("__before")).filter(F.col("__before").isNotNull())
    rows = rows.withColumn(name, F.row_number().over(W.partitionBy(*group, "__slice").orderBy(way(order))))
    out = null_safe_join(rows, before, (*group, "__slice"), "left")
    return out.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__before", "__slice")
