"""Click sequences: expansion of observations and the re-click rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.operators.filters import wanted_href, within_click_depth
from webstrata.options import CaptureOptions


def _wanted(candidates: Column | str) -> Column:
    """Candidates whose link has no unwanted protocol, repeats kept."""
    return F.filter(candidates, lambda c: wanted_href(c["href"]))


def _first_load() -> Column:
    return F.size("click_path") == 0


def mutation_match(candidates: Column, mutated: Column | str) -> Column:
    """Candidates whose address is among the mutated ones, repeats kept.

    The intersection is hash-based and small, so the final test is cheap even where
    both lists are long.
    """
    hit = F.array_intersect(F.transform(candidates, lambda c: c["path"]), mutated)
    return F.filter(candidates, lambda c: F.array_contains(hit, c["path"]))


def _extend(rows: DataFrame, step: Column, distinct: bool) -> DataFrame:
    refs = rows.select(F.col("current_url").alias("url"),
                       F.array_append("click_path", step).alias("click_path"))
    return refs.distinct() if distinct else refs


def expand_clicks(dom_observations: DataFrame, opts: CaptureOptions | None = None,
                  distinct: bool = False) -> DataFrame:
    """New click sequences, one per viable candidate.

    After a first load every candidate starts a sequence. After clicks, those whose
    element was added or changed by the last click extend the current sequence, within
    the depth limit. Sequences start at the URL the browser shows now.
    """
    opts = opts or CaptureOptions()
    observed = within_click_depth(dom_observations, opts.max_click_depth)
    wanted = _wanted("candidates")
    viable = F.when(_first_load(), wanted).otherwise(mutation_match(wanted, "mutated_paths"))
    exploded = observed.select("current_url", "click_path", F.explode(viable).alias("one"))
    return _extend(exploded, F.col("one.path"), distinct)


def reclick(dom_observations: DataFrame, opts: CaptureOptions | None = None) -> DataFrame:
    """Sequences that repeat their last click: it changed something and is still possible."""
    opts = opts or CaptureOptions()
    last = F.try_element_at("click_path", F.lit(-1))
    viable = F.exists(_wanted("candidates"), lambda c: c["path"] == last)
    changed = F.col("attr_mutated") | (F.size("mutated_paths") > 0)
    observed = within_click_depth(dom_observations, opts.max_click_depth)
    return _extend(observed.where(~_first_load() & viable & changed), last, False)
