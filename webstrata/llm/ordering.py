"""Positions and running totals in groups of any size, over tables from `operators.ordered.lay_out`.

A group may span many partitions of the layout, but only the first and the last group of a
partition can: what is broadcast has two rows per partition at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(laid: DataFrame, group: str, order: list[str], value: str | None = None,
            before: str = "before", total: str = "total") -> DataFrame:
    """Append the sum of ``value`` over earlier rows of the group, and over the whole group.

    Without ``value`` rows are counted. ``group`` must not be null; ``order`` is that of the layout.
    """
    amount = F.lit(1).cast("bigint") if value is None else F.col(value)
    parts = laid.groupBy(group, "_part").agg(F.sum(amount).alias("_sum"))
    whole = Window.partitionBy(group)
    spanning = parts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_at"),
        F.sum("_sum").over(whole.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)).alias("_earlier"),
        F.sum("_sum").over(whole).alias("_all"), F.count("*").over(whole).alias("_parts")
    ).where("_parts > 1").drop("_parts")
    within = Window.partitionBy("_part", group)
    local = laid.withColumns({
        before: F.coalesce(F.sum(amount).over(within.orderBy(*order).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)),
        total: F.sum(amount).over(within)})
    joined = local.join(F.broadcast(spanning), (F.col("_part") == F.col("_at"))
                        & (F.col(group) == F.col("_group")), "left")
    return joined.withColumns({
        before: F.col(before) + F.coalesce("_earlier", F.lit(0)),
        total: F.coalesce("_all", total)}).select(*local.columns).drop("_part")
