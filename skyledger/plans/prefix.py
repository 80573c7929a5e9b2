"""Running totals and exact ranks over a whole order, by ranges that tasks work on side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import stage_table


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the total of ``value`` over all rows up to each in the order of the columns ``order``.

    Rows are dealt by ranges of the order; a window runs within each range, and only the ranges' sums, a row each, go
    through one of their own. Rows that are equal in the order stay in one range and come in any order. Nulls of
    ``value`` count as 0; nulls of the order come first.
    """
    held = stage_table(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = held.groupBy(F.col("__range").alias("__of")).agg(F.sum(value).alias("__sum"))
    earlier = F.sum("__sum").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("__of", F.coalesce(earlier, F.lit(0)).alias("__before"))
    own = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("__own", own).join(before, F.col("__range") == F.col("__of"))
    return found.withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__of", "__before", "__own")


def value_counts(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, n, of, upto)``: how often each group has each value, how many values it has, and how many up to this
    one. Equal values are counted before anything is ordered. Null values don't count, a null group is a group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    total = running_total(counts, [group, value], "n", "upto")
    groups = total.groupBy(F.col(group).alias("__group")).agg(F.sum("n").alias("of"), F.min(F.col("upto") - F.col("n")).alias("__start"))
    joined = total.join(groups, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn("upto", F.col("upto") - F.col("__start")).drop("__group", "__start")


def at_rank(place: Column) -> Column:
    """True for the row of ``value_counts`` whose value has the place ``place``, from 0, in its group."""
    return (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
