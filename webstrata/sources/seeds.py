"""Seed lists: one URL per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.urls import url_host


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``seed_url`` per line, repeats kept."""
    return spark.read.text(path).select(F.col("value").alias("seed_url"))


def seed_refs(seeds: DataFrame) -> DataFrame:
    """Starting references: every seed, unchecked, with an empty click path."""
    return seeds.select(F.col("seed_url").alias("url"),
                        F.array().cast("array<string>").alias("click_path"))


def seed_hosts(seeds: DataFrame) -> DataFrame:
    """Hosts of the seeds that are valid URIs; letter case is kept."""
    return seeds.select(url_host("seed_url").alias("host")).where(F.col("host").isNotNull())
