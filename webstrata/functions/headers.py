"""Operations on header lists: ``ARRAY<STRUCT<name, value>>``, names may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.keys import BODY_METHODS
from webstrata.functions.urls import as_column


def _header(name: str, value: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))


def override_headers(headers: Column | str, user_agent: str | None = None) -> Column:
    """Ask for unencoded bodies and, if configured, replace the user agent."""
    forced = [("Accept-Encoding", "")]
    if user_agent is not None:
        forced.append(("User-Agent", user_agent))
    names = [name.lower() for name, _ in forced]
    kept = F.filter(as_column(headers), lambda h: ~F.lower(h["name"]).isin(*names))
    return F.concat(kept, F.array(*[_header(name, value) for name, value in forced]))


def flatten_headers(multimap: Column | str) -> Column:
    """``ARRAY<STRUCT<name, values>>`` to a flat list; one content-length at most."""
    def spread(entry: Column) -> Column:
        values = F.when(F.lower(entry["name"]) == "content-length",
                        F.slice(entry["values"], 1, 1)).otherwise(entry["values"])
        return F.transform(values, lambda v: F.struct(entry["name"].alias("name"),
                                                      v.alias("value")))

    return F.flatten(F.transform(as_column(multimap), spread))


def single_content_length(headers: Column | str) -> Column:
    """Drop every content-length but the first."""
    headers = as_column(headers)
    names = F.transform(headers, lambda h: F.lower(h["name"]))
    first = F.array_position(names, "content-length") - 1
    return F.filter(headers, lambda h, i: (F.lower(h["name"]) != "content-length")
                    | (i == first))


def headers_table(calls: DataFrame, side: str = "resp_headers") -> DataFrame:
    """One row per recorded header: ``call_id, pos, name, value``."""
    exploded = calls.select("call_id", F.posexplode(single_content_length(side)))
    return exploded.select("call_id", "pos", F.col("col.name").alias("name"),
                           F.col("col.value").alias("value"))


def content_type(headers: Column | str) -> Column:
    """Last content-type value, any letter case; NULL if there is none."""
    matching = F.filter(as_column(headers), lambda h: F.lower(h["name"]) == "content-type")
    return F.try_element_at(matching, F.lit(-1))["value"]


def recorded_body(method: Column | str, body: Column | str) -> Column:
    """Request body as recorded: POST and PUT only."""
    return F.when(as_column(method).isin(*BODY_METHODS), as_column(body))
