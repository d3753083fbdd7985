"""URL identity, parts and resolution as native column expressions.

``try_parse_url`` uses the JDK's strict URI parser, and its PATH part is NULL exactly
for invalid and for opaque URIs. Common URLs are handled by plain expressions inside
code generation; only rows with an escape, an empty authority or an unusual link take
the branches built from higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters each URI part may hold unescaped (RFC 2396 with RFC 2732).
# \x27 is the single quote.
_UNRESERVED = r"A-Za-z0-9\-_.!~*\x27()"
_AUTHORITY = _UNRESERVED + r"$,;:@&=+\[\]"
_PATH = _UNRESERVED + r":@&=+$,;/"
_QUERY = _UNRESERVED + r";/?:@&=+$,\[\]"

# What a browser escapes in the path, and in the query and fragment.
_BROWSER_PATH = r'[\x00-\x20"<>`{}\x7f-\x{10FFFF}]'
_BROWSER_QUERY = r'[\x00-\x20"<>\x7f-\x{10FFFF}]'

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_EMPTY_AUTHORITY = rf"^(?:{_SCHEME})?//(?:[/?#]|$)"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"
_PLAIN_BASE = r"^https?://[a-z0-9.\-]+(?:[/?#]|$)"
_PLAIN_ROOTED = r'^/(?!/)[^\x00-\x20"<>`{}\\?#\x7f-\x{10FFFF}]*$'


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: str, name: str, body: str) -> str:
    """SQL text that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def apply_sql(value: Column, name: str, body: str) -> Column:
    """Column form of `let`: ``body`` is parsed once, which keeps plan building fast."""
    return F.element_at(F.call_function("transform", F.array(value),
                                        F.expr(f"{name} -> {body}")), 1)


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Append costly columns that later filters read instead of recomputing.

    A filter on a projected column is pushed below the projection together with the
    whole expression; it is not pushed below a generator.
    """
    for name, value in columns.items():
        df = df.withColumn(name, F.explode(F.array(value)))
    return df


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def _escape_sql(text: str, illegal: str) -> str:
    """Percent-encode (as UTF-8) every character of a variable that matches ``illegal``."""
    return f"""CASE WHEN {text} RLIKE r'{illegal}' THEN array_join(transform(split({text}, ''),
            c -> CASE WHEN c = ' ' THEN '%20'
                      WHEN c RLIKE r'{illegal}' THEN url_encode(c) ELSE c END), '')
             ELSE {text} END"""


def _requote_sql(raw: str, legal: str) -> str:
    """Decode a raw URI part, then escape what that part may not hold."""
    illegal = rf"[^{legal}\x{{80}}-\x{{10FFFF}}]|[\p{{Z}}\x{{80}}-\x{{9f}}]"
    return let(f"try_url_decode(replace({raw}, '+', '%2B'))", "t", _escape_sql("t", illegal))


# Losing an empty authority or an escape can leave a text that no longer parses: NULL.
_REBUILD_SQL = let(let(
    """named_struct(
      'scheme', try_parse_url(url, 'PROTOCOL'), 'authority', try_parse_url(url, 'AUTHORITY'),
      'path', try_parse_url(url, 'PATH'), 'query', try_parse_url(url, 'QUERY'))""",
    "p", f"""concat(
      coalesce(concat(p.scheme, ':'), ''),
      CASE WHEN p.authority IS NULL THEN ''
           WHEN startswith(p.authority, '[') THEN concat('//', p.authority)
           ELSE concat('//', {_requote_sql('p.authority', _AUTHORITY)}) END,
      {_requote_sql('p.path', _PATH)},
      CASE WHEN p.query IS NULL THEN ''
           ELSE concat('?', {_requote_sql('p.query', _QUERY)}) END)"""),
    "r", """CASE WHEN coalesce(try_parse_url(r, 'PROTOCOL'), try_parse_url(r, 'PATH'))
                 IS NOT NULL THEN r END""")

CANONICAL_URL_SQL = rf"""
CASE WHEN try_parse_url(url, 'PATH') IS NULL THEN NULL
     WHEN contains(url, '%') OR url RLIKE r'{_EMPTY_AUTHORITY}' THEN {_REBUILD_SQL}
     ELSE split_part(url, '#', 1) END"""


def canonical_url(url: Column | str) -> Column:
    """URL without fragment, rebuilt from its decoded parts; NULL if it is no such URI."""
    url = as_column(url)
    rebuilt = apply_sql(url, "url", _REBUILD_SQL)
    return (F.when(_part(url, "PATH").isNull(), F.lit(None).cast("string"))
            .when(url.contains("%") | url.rlike(_EMPTY_AUTHORITY), rebuilt)
            .otherwise(F.split_part(url, F.lit("#"), F.lit(1))))


def url_host(url: Column | str) -> Column:
    return _part(as_column(url), "HOST")


def url_scheme(url: Column | str) -> Column:
    return _part(as_column(url), "PROTOCOL")


def host_suffixes(host: Column | str) -> Column:
    """The host and every dot-separated tail of it: a.b.c, b.c, c."""
    return apply_sql(F.split(as_column(host), r"\."), "labels", """transform(
        sequence(1, size(labels)), at -> array_join(slice(labels, at, size(labels)), '.'))""")


# Walk the segments of an absolute path. The text before the first slash is empty and
# stays as the root.
_DROP_DOT_SEGMENTS_SQL = rf"""CASE WHEN path RLIKE r'{_DOT_SEGMENT}' THEN """ + let(
    """aggregate(slice(split(path, '/'), 2, size(split(path, '/'))), array(''),
        (kept, one) -> CASE WHEN one = '.' THEN kept
                            WHEN one = '..' THEN slice(kept, 1, greatest(size(kept) - 1, 1))
                            ELSE array_append(kept, one) END)""",
    "kept", r"""concat(array_join(kept, '/'), CASE WHEN size(kept) = 1 OR path RLIKE r'/\.\.?$'
                       THEN '/' ELSE '' END)""") + " ELSE path END"

_LOWER_ORIGIN_SQL = r"""regexp_replace(concat(
      lower(regexp_extract(origin, r'^([^/]*//)', 1)), regexp_extract(origin, r'//(.*@)', 1),
      lower(regexp_extract(origin, r'//(?:.*@)?([^@]*)$', 1))),
    r'^(http:.*):80$|^(https:.*):443$|^(ftp:.*):21$|^([^:]*:.*):$', '$1$2$3$4')"""

# Escapes, origin and path as a browser reports them.
_BROWSER_FORM_SQL = let(
    let("regexp_extract(absolute, r'^([^?#]*)', 1)", "head",
        let("substr(absolute, length(head) + 1)", "tail",
            f"""named_struct('head', {_escape_sql('head', _BROWSER_PATH)},
                             'tail', {_escape_sql('tail', _BROWSER_QUERY)})""")),
    "e", "concat(CASE WHEN e.head RLIKE r'(?i)^(?:https?|ftp|file)://' THEN " + let(
        "regexp_extract(e.head, r'^([^/]*//[^/]*)', 1)", "origin", let(
            "concat(CASE WHEN length(e.head) = length(origin) THEN '/' ELSE '' END, "
            "substr(e.head, length(origin) + 1))", "path",
            f"concat({_LOWER_ORIGIN_SQL}, {_DROP_DOT_SEGMENTS_SQL})"))
    + " ELSE e.head END, e.tail)")

_RESOLVE_SQL = let(let(
    r"regexp_replace(regexp_replace(href, r'^[\x00-\x20]+|[\x00-\x20]+$', ''), "
    r"r'[\t\r\n]', '')", "ref", let(
        rf"""named_struct(
          'path', replace(regexp_extract(ref, r'^([^?#]*)', 1), r'\', '/'),
          'suffix', regexp_extract(ref, r'^[^?#]*(.*)$', 1),
          'scheme', regexp_extract(base, r'^({_SCHEME})', 1),
          'origin', regexp_extract(base, r'^({_SCHEME}(?://[^/?#]*)?)', 1),
          'folder', regexp_extract(base, r'^{_SCHEME}(?://[^/?#]*)?([^?#]*/)?', 1))""",
        "at", rf"""CASE
          WHEN ref RLIKE r'^{_SCHEME}' THEN ref
          WHEN at.scheme = '' THEN NULL
          WHEN startswith(at.path, '//') THEN concat(at.scheme, at.path, at.suffix)
          WHEN startswith(at.path, '/') THEN concat(at.origin, at.path, at.suffix)
          WHEN at.path != '' THEN concat(
              at.origin, CASE WHEN at.folder = '' THEN '/' ELSE at.folder END, at.path, at.suffix)
          WHEN startswith(at.suffix, '?')
               THEN concat(regexp_extract(base, r'^([^?#]*)', 1), at.suffix)
          ELSE concat(regexp_extract(base, r'^([^#]*)', 1), at.suffix) END""")),
    "absolute", f"CASE WHEN absolute IS NOT NULL THEN {_BROWSER_FORM_SQL} END")

_RESOLVE_WITH_BASE_SQL = let(
    "CASE WHEN row.declared IS NULL THEN row.page ELSE "
    + let("row.page", "base", let("row.declared", "href", _RESOLVE_SQL)) + " END",
    "base", let("row.href", "href", _RESOLVE_SQL))


def resolve_href(page_url: Column | str, base_href: Column | str | None,
                 href: Column | str) -> Column:
    """Absolute URL of an element's ``href`` on a page, honouring its ``<base>``."""
    page, href = as_column(page_url), as_column(href)
    declared = (F.lit(None).cast("string") if base_href is None else as_column(base_href))
    plain = (declared.isNull() & page.rlike(_PLAIN_BASE) & href.rlike(_PLAIN_ROOTED)
             & ~href.rlike(_DOT_SEGMENT))
    rooted = F.concat(F.regexp_extract(page, r"^([a-z]*://[^/?#]*)", 1), href)
    row = F.struct(page.alias("page"), declared.alias("declared"), href.alias("href"))
    return (F.when(href.isNull(), F.lit(None).cast("string"))
            .when(plain, rooted)
            .otherwise(apply_sql(row, "row", _RESOLVE_WITH_BASE_SQL)))


_SURT_SQL = r"""concat(
    array_join(reverse(split(regexp_replace(u.host, r'^www\d*\.', ''), r'\.')), ','),
    CASE WHEN regexp_extract(u.authority, r':(\d+)$', 1)
              IN ('', CASE WHEN u.scheme = 'https' THEN '443' ELSE '80' END) THEN ''
         ELSE regexp_extract(u.authority, r'(:\d+)$', 1) END,
    ')',
    CASE WHEN u.path = '' THEN '/' ELSE regexp_replace(u.path, r'(?<=.)/+$', '') END,
    CASE WHEN coalesce(u.query, '') = '' THEN ''
         ELSE concat('?', array_join(sort_array(split(u.query, '&')), '&')) END)"""


def surt_key(url: Column | str) -> Column:
    """Sort-friendly index key: reversed host labels, then port, path and query."""
    url = as_column(url)
    parts = F.struct(*[F.lower(_part(url, name.upper())).alias(name)
                       for name in ("authority", "host", "path", "query")],
                     F.lower(url_scheme(url)).alias("scheme"))
    return F.coalesce(apply_sql(parts, "u", _SURT_SQL), url)
