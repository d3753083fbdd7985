"""Row predicates: unwanted links, host patterns, omission, depth, navigation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import as_column, canonical_url

# Link protocols that are never followed; matched whole, case-sensitive.
UNWANTED_PROTOCOLS = ("tel", "mailto", "ftp", "file", "sms", "geo", "callto", "sip")
_UNWANTED = rf"\A(?:{'|'.join(UNWANTED_PROTOCOLS)}):.+\z"


def wanted_href(href: Column | str) -> Column:
    """True unless the whole value is a link with an unwanted protocol; NULL is wanted."""
    return ~F.coalesce(as_column(href).rlike(_UNWANTED), F.lit(False))


def drop_unwanted_href(elements: DataFrame) -> DataFrame:
    """Drop elements whose link has an unwanted protocol.

    A browser reports the resolved link, which matters on local pages only: there a
    relative link is a ``file:`` link.
    """
    local_page = F.coalesce(F.col("url").startswith("file:"), F.lit(False))
    return elements.where(
        wanted_href("href") & (~local_page | wanted_href("href_abs")))


def _matches_any(host: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return host.rlike(r"\A(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z")


def external_scope(host: Column | str, include: Sequence[str],
                   exclude: Sequence[str]) -> Column:
    """Host fully matches an include pattern and no exclude pattern; NULL host is out."""
    host = as_column(host)
    inside = _matches_any(host, include) & ~_matches_any(host, exclude)
    return F.coalesce(inside, F.lit(False))


def omitted_status(status: Column | str) -> Column:
    """No response, or a status that is neither successful nor exactly 302."""
    status = as_column(status)
    return status.isNull() | ~(status.between(200, 299) | (status == 302))


def omissions(calls: DataFrame, visit: str = "call_id") -> DataFrame:
    """``visit_id, uri`` of calls whose page must not be expanded; URIs stay raw."""
    return calls.where(omitted_status("status")).select(F.col(visit).alias("visit_id"), "uri")


def recordable(calls: DataFrame) -> DataFrame:
    """Calls that got a response, whatever its status."""
    return calls.where(F.col("status").isNotNull())


def within_click_depth(refs: DataFrame, limit: int) -> DataFrame:
    """References that may be expanded: a path of exactly ``limit`` still is; 0 = no limit."""
    return refs if limit == 0 else refs.where(F.size("click_path") <= limit)


def navigated(df: DataFrame, current: str = "current_url", reference: str = "url") -> DataFrame:
    """Rows whose browser ended up on another page than the reference, fragments aside."""
    return df.where(canonical_url(current) != canonical_url(reference))
