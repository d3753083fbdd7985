"""SQL surface: the URL and key functions as session functions, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from webstrata.functions.urls import CANONICAL_URL_SQL, let

_PAGE_KEY = "concat(method, '_', " + CANONICAL_URL_SQL + ")"
_BODY_DIGESTS = let(
    "translate(base64(coalesce(body, X'')), '\\r\\n', '')", "b",
    "concat('_', md5(b), '_', sha1(b))")
_REQUEST_KEY = let(_PAGE_KEY, "k", f"""concat(
    md5(k), '_', sha1(k),
    CASE WHEN method IN ('POST', 'PUT') THEN {_BODY_DIGESTS} ELSE '' END)""")

# Bodies are self-contained: session functions that call each other do not survive the
# optimizer when a query uses several of them.
_SQL_FUNCTIONS = {
    "canonical_url(url STRING)": CANONICAL_URL_SQL,
    "url_host(url STRING)": "try_parse_url(url, 'HOST')",
    "url_scheme(url STRING)": "try_parse_url(url, 'PROTOCOL')",
    "page_key(method STRING, url STRING)": _PAGE_KEY,
    "request_key(method STRING, url STRING, body BINARY)": _REQUEST_KEY,
}


def register_functions(spark: SparkSession) -> None:
    """Make the URL and key functions callable from SQL text on this session."""
    for signature, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING "
                  f"RETURN {body}")
