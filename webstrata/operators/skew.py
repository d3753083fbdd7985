"""Joins against one-row-per-key tables when a key may own a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot from one part in HOT_SHARE of all rows on: fewer than HOT_SHARE can be.
HOT_SHARE = 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys owning more than 1/HOT_SHARE of the rows: below HOT_SHARE rows, always.

    ``_salts`` is the number of tasks a key's rows deserve: twice its share of the shuffle's.

    Counted on the key column alone, with map-side partial sums; the total is summed from
    the same counts.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("_n") * F.lit(2 * width) / total).cast("int")
    return counts.where((F.col("_n") > 1) & (F.col("_n") * HOT_SHARE > total)).select(
        key, salts.alias("_salts"))


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread_by: list[str],
                  how: str = "left") -> DataFrame:
    """Join ``left`` with ``right`` (at most one row per key), spreading hot keys.

    Rows of a hot key are dealt over tasks by a hash of ``spread_by``, as many as its share
    of all rows asks for; only the right rows of hot keys are repeated. The hot list is broadcast: its size is
    bounded by HOT_SHARE whatever the data.
    """
    hot = F.broadcast(hot_keys(left, key))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_salts")
    repeated = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")
