"""Frontier waves over captured pages, and the set of pages reachable from seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import canonical_url, settle, url_host
from webstrata.operators.dedup import unvisited
from webstrata.operators.elements import clickable_elements
from webstrata.operators.filters import drop_unwanted_href, navigated
from webstrata.operators.lookups import fresh_navigations
from webstrata.operators.scope import in_scope
from webstrata.options import CaptureOptions
from webstrata.session import cut_lineage, work_path


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, url, link`` of every followable link, canonical, repeats kept."""
    wanted = drop_unwanted_href(clickable_elements(pages)).where(F.col("href").isNotNull())
    links = settle(wanted, link=canonical_url("href_abs"))
    return links.where(F.col("link").isNotNull()).select("page_id", "url", "link")


def next_frontier(pages: DataFrame, seed_hosts: DataFrame, visited: DataFrame,
                  opts: CaptureOptions | None = None) -> DataFrame:
    """References of the next wave: in-scope links of the pages that were never fetched.

    ``visited`` holds canonical URLs in ``url``.
    """
    opts = opts or CaptureOptions()
    links = page_links(pages).select(F.col("link").alias("url"))
    fresh = unvisited(in_scope(links, seed_hosts, opts), visited)
    return fresh.select("url", url_host("url").alias("host"),
                        F.array().cast("array<string>").alias("click_path"))


def navigation_refs(navigations: DataFrame, fetched: DataFrame, seed_hosts: DataFrame,
                    visited: DataFrame, opts: CaptureOptions | None = None) -> DataFrame:
    """References of pages that clicks led to: newly fetched, in scope and never visited.

    URLs stay as the browser shows them; ``visited`` holds canonical ones in ``url``.
    """
    moved = fresh_navigations(navigated(navigations), fetched)
    inside = in_scope(moved.select(F.col("current_url").alias("url")), seed_hosts,
                      opts or CaptureOptions())
    refs = settle(inside.distinct(), _key=canonical_url("url"))
    fresh = refs.join(visited.select(F.col("url").alias("_key")), "_key", "left_anti")
    return fresh.select("url", url_host("url").alias("host"),
                        F.array().cast("array<string>").alias("click_path"))


# Edges are laid out by a hash of their source: a wave that touches few of these
# directories reads no others (dynamic partition pruning).
BUCKETS = 32


def _bucket(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


def _next_wave(links: DataFrame, wave: DataFrame, visited: DataFrame) -> DataFrame:
    """Unvisited targets of the wave's edges."""
    sources = wave.select(F.col("node").alias("src"), _bucket("node").alias("bucket"))
    targets = links.join(sources, ["bucket", "src"], "left_semi")
    return unvisited(targets.select(F.col("dst").alias("node")), visited, "node").select("node")


# Hops taken one by one before chains are followed by jumps.
PLAIN_WAVES = 4


class _Chains:
    """Jumps of 1, 2, 4, ... hops along nodes that lead to one other node each, made as asked for."""

    def __init__(self, links: DataFrame) -> None:
        ends = links.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("_last"))
        self._jumps = [cut_lineage(ends.where(F.col("dst") == F.col("_last")).drop("_last"))]

    def jump(self, level: int) -> DataFrame:
        """``src, dst``: the node 2 to the power of ``level`` hops on, where only chains lie between."""
        while len(self._jumps) <= level:
            one = self._jumps[-1]
            on = one.select(F.col("src").alias("dst"), F.col("dst").alias("_on"))
            self._jumps.append(cut_lineage(
                one.join(on, "dst").select("src", F.col("_on").alias("dst"))))
        return self._jumps[level]


def reachable(edges: DataFrame, seeds: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from ``seeds(node)`` over ``edges(src, dst)``, seeds included.

    Each wave is written to the shared folder, so neither lineage nor recomputation grows
    with the number of waves, and a lost executor costs no earlier wave. A wave is one hop; where
    there are many, nodes of one target each are followed to the end by jumps that double, so that a
    chain or ring takes as many jobs as its length has binary digits. ``scope(node)`` limits where
    edges may lead.
    """
    spark = edges.sparkSession
    folder = work_path(spark, "reachable")
    links = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    if scope is not None:
        allowed = scope.select(F.col("node").alias("dst")).distinct()
        links = links.join(allowed, "dst", "left_semi").select("src", "dst")
    links = links.withColumn("bucket", _bucket("src"))
    links.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}-edges")
    links = spark.read.schema(links.schema).parquet(f"{folder}-edges")

    wave = seeds.select("node").where(F.col("node").isNotNull()).distinct()
    schema, paths, hops, chains = wave.schema, [], 0, None

    def written(nodes: DataFrame) -> DataFrame:
        paths.append(f"{folder}/step={len(paths)}")
        nodes.write.parquet(paths[-1])
        return spark.read.schema(schema).parquet(paths[-1])

    def visited() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/*")

    while True:
        first, found = len(paths), written(wave)
        if found.isEmpty():
            return visited()
        if hops >= PLAIN_WAVES:
            chains, level = chains or _Chains(links), 0
            # What lies less than 2 to the power of the level hops on is found; once a jump leads
            # to nothing new from there, nothing on the chains is left.
            while not found.isEmpty():
                wave = spark.read.schema(schema).parquet(*paths[first:])
                ahead = chains.jump(level).join(wave, F.col("src") == F.col("node"), "left_semi")
                found = written(unvisited(ahead.select(F.col("dst").alias("node")), visited(),
                                          "node").select("node"))
                level += 1
            found = spark.read.schema(schema).parquet(*paths[first:])
        hops, wave = hops + 1, _next_wave(links, found, visited())
