"""Scope of a crawl: seed hosts and their subdomains, external patterns, local files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import host_suffixes, settle, url_host, url_scheme
from webstrata.operators.filters import external_scope
from webstrata.operators.skew import salted_lookup
from webstrata.options import CaptureOptions


def topmost_hosts(seed_hosts: DataFrame, subdomains: bool) -> DataFrame:
    """``_seed``: the distinct seed hosts; with subdomains, none that lies below another one.

    So at most one of them matches a given host.
    """
    seeds = seed_hosts.select(F.col("host").alias("_seed")).where(
        F.col("_seed").isNotNull()).distinct()
    if not subdomains:
        return seeds
    dots = F.length("_seed") - F.length(F.replace("_seed", F.lit("."), F.lit("")))
    above = F.when(dots > 0, F.transform(F.sequence(F.lit(1), dots), lambda labels: F.call_function(
        "substring_index", F.col("_seed"), F.lit("."), -labels)))
    # Very many seeds may lie below one domain, a seed or not: their rows are dealt over tasks.
    below = salted_lookup(seeds.select("_seed", F.explode(above).alias("_above")),
                          seeds.select(F.col("_seed").alias("_above")), "_above", ["_seed"],
                          "left_semi")
    return seeds.join(below.select("_seed"), "_seed", "left_anti")


def _matching(df: DataFrame, seed_hosts: DataFrame, subdomains: bool, host: str,
              candidate: Column, anyway: Column) -> DataFrame:
    """Rows of ``candidate`` hosts that match a seed host, and those that stay ``anyway``.

    Each row is spread over its host and the domains above it, of which one at most is a
    topmost seed, so rows need not be brought together again. The same plan serves seed
    lists of any length: Spark broadcasts them by measured size, or splits hot hosts in a join.
    """
    keys = F.when(anyway, F.array(F.lit(None).cast("string"))).when(
        candidate, host_suffixes(host) if subdomains else F.array(F.col(host)))
    spread = df.select(*df.columns, F.explode(keys).alias("_scope_key"), anyway.alias("_anyway"))
    seeds = topmost_hosts(seed_hosts, subdomains)
    joined = spread.join(seeds, spread["_scope_key"] == seeds["_seed"], "left")
    return joined.where(F.col("_anyway") | F.col("_seed").isNotNull()).select(*df.columns)


def seed_scope(df: DataFrame, seed_hosts: DataFrame, subdomains: bool = True,
               host: str = "host") -> DataFrame:
    """Rows whose host equals a seed host or, with subdomains, lies below one; case-sensitive."""
    return _matching(df, seed_hosts, subdomains, host, F.col(host).isNotNull(), F.lit(False))


def in_scope(df: DataFrame, seed_hosts: DataFrame, opts: CaptureOptions,
             url: str = "url") -> DataFrame:
    """Rows whose URL may be crawled: web pages of seed or admitted hosts, local files.

    Seeds come first: exclude patterns only concern hosts an include pattern admitted.
    """
    parts = settle(df, _host=url_host(url), _scheme=url_scheme(url))
    web = F.coalesce(F.col("_scheme").startswith("http"), F.lit(False))
    local = F.col("_scheme").startswith("file") & F.lit(opts.include_local_files)
    admitted = web & external_scope("_host", opts.include_hosts, opts.exclude_hosts)
    return _matching(parts, seed_hosts, opts.include_seed_subdomains, "_host", web,
                     F.coalesce(local | admitted, F.lit(False))).select(*df.columns)
