"""Request identity and text labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.urls import as_column, canonical_url

# Methods whose body is part of the request.
BODY_METHODS = ("POST", "PUT")


def page_key(method: Column | str, uri: Column | str) -> Column:
    """Method and canonical URL; NULL where the URI has no canonical form."""
    return F.concat(as_column(method), F.lit("_"), canonical_url(uri))


def plain_base64(data: Column | str) -> Column:
    """Base64 on one line: the built-in breaks lines every 76 characters."""
    return F.translate(F.base64(as_column(data)), "\r\n", "")


def request_key(method: Column | str, uri: Column | str, body: Column | str) -> Column:
    """md5 and sha1 of the page key, then of the base64 body for POST and PUT."""
    method = as_column(method)
    identity = page_key(method, uri)
    text = plain_base64(F.coalesce(as_column(body), F.lit(b"")))
    body_part = F.when(method.isin(*BODY_METHODS),
                       F.concat(F.lit("_"), F.md5(text), F.lit("_"), F.sha1(text)))
    return F.concat(F.md5(identity), F.lit("_"), F.sha1(identity),
                    F.coalesce(body_part, F.lit("")))


def ref_label(url: Column | str, click_path: Column | str) -> Column:
    """Text identity of a click sequence: ``url @ [p1] [p2]``."""
    steps = F.transform(as_column(click_path), lambda p: F.concat(F.lit(" ["), p, F.lit("]")))
    return F.concat(as_column(url), F.lit(" @"), F.array_join(steps, ""))
