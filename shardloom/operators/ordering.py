"""Running numbers and totals within groups, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add the sum of `value`, a whole number, over the rows of the same group that come before this one.

    Rows are range-partitioned and sorted by group and order, and written out with their partition; the total
    within it is a window of that partition's rows alone, and a group that goes on from earlier partitions adds their
    sums. Rows alike in group and order get some order among themselves, by their place in the input, so that no partition grows
    with them. A null group is a group like any other; an empty table gives an empty one.
    """
    keys = [*group, *order, "_tie"]
    held = materialize(df.withColumn("_value", value.cast("long")).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("_local", F.coalesce(F.sum("_value").over(here), F.lit(0)))
    # One row for each group and partition that has any of it.
    sums = held.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return local.join(before, same).select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def number_in_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Number the rows of each group from 0 in the given order."""
    return running_total(df, group, order, F.lit(1), name)
