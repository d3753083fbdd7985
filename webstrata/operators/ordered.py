"""Exact order-dependent results per group when a group may not fit in one task.

Rows are range-partitioned by (group, order), so a large group spans many partitions,
and the layout is materialised once. What a partition needs to know of those before it
is one row per partition, which bounds the two broadcasts made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.session import cut_lineage


def lay_out(df: DataFrame, group: list[str], order: list[str],
            partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by (group, order), with ``_part``, the partition number.

    Materialised, because range bounds come from a sample and would differ between two
    evaluations. The order must be total within a group.
    """
    keys = [*group, *order]
    ranged = (df.repartitionByRange(partitions, *keys) if partitions
              else df.repartitionByRange(*keys))
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    condition = F.lit(True)
    for column in columns:
        condition = condition & left[column].eqNullSafe(right[f"_o_{column}"])
    return condition


def rank_in_group(laid: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Append each row's 1-based position in its group; ``laid`` comes from `lay_out`."""
    sizes = laid.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1))
    # Only the first group of a partition can have rows in an earlier one.
    offsets = sizes.withColumn("_before", before).where(F.col("_before") > 0).select(
        "_before", *[F.col(c).alias(f"_o_{c}") for c in (*group, "_part")])
    local = laid.withColumn(name, F.row_number().over(
        Window.partitionBy("_part", *group).orderBy(*order)).cast("bigint"))
    joined = local.join(F.broadcast(offsets), _same(local, offsets, ["_part", *group]), "left")
    return joined.withColumn(
        name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*local.columns).drop("_part")


def previous_in_group(laid: DataFrame, group: list[str], order: list[str], value: str,
                      name: str) -> DataFrame:
    """Append ``value`` of the preceding row of the group; ``laid`` comes from `lay_out`."""
    row = [*group, value]
    tails = laid.groupBy("_part").agg(
        F.max_by(F.struct(*row), F.struct(*group, *order)).alias("_tail"))
    carried = tails.select(
        (F.lead("_part").over(Window.orderBy("_part"))).alias("_o__part"),
        F.col(f"_tail.{value}").alias("_carried"),
        *[F.col(f"_tail.{c}").alias(f"_o_{c}") for c in group]
    ).where(F.col("_o__part").isNotNull())
    within = Window.partitionBy("_part", *group).orderBy(*order)
    local = laid.withColumns({name: F.lag(value).over(within),
                              "_first": F.row_number().over(within) == 1})
    joined = local.join(F.broadcast(carried), _same(local, carried, ["_part", *group]), "left")
    return joined.withColumn(
        name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name))
    ).select(*local.columns).drop("_part", "_first")
