"""Start tags, attributes and character references of HTML text, as native columns.

Quantifiers are possessive throughout, so no page can make the matcher backtrack or
overflow its stack.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.urls import apply_sql, let

# Elements whose content is text, not markup, in a scripting browser.
RAW_TEXT_TAGS = ("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript",
                 "textarea", "title")

# \x22 and \x27 are the quotes.
ATTRIBUTES = (r"(?:[^>=]++|=\s*+(?:\x22[^\x22]*+\x22|\x27[^\x27]*+\x27"
              r"|[^\s>\x22\x27][^\s>]*+|(?=>)))*+")
ATTRIBUTE = (r"[^\s>/=][^\s/>=]*+(?:\s*+=\s*+(?:\x22[^\x22]*+\x22|\x27[^\x27]*+\x27"
             r"|[^\s>\x22\x27][^\s>]*+)?+)?+")
START_TAG = rf"(?s)^<[a-zA-Z][^\s/>]*+{ATTRIBUTES}>"
_RAW = "|".join(RAW_TEXT_TAGS)
MARKUP = (rf"(?is)<!--.*?(?:-->|\z)"
          rf"|<({_RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])|\z)"
          rf"|<[a-z][^\s/>]*+{ATTRIBUTES}>")

_REFERENCE = r"(?s)^&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def start_tags(html_text: Column, mentioning: str) -> Column:
    """Start tags that mention a pattern, in document order; no comments, no raw text.

    ``ARRAY<STRUCT<tag, name, attributes>>``, the attributes as written.
    """
    tokens = F.regexp_extract_all(html_text, F.lit(MARKUP), 0)
    return apply_sql(tokens, "tokens", rf"""transform(transform(
        filter(tokens, k -> k RLIKE r'(?i){mentioning}' AND NOT startswith(k, '<!--')),
        k -> regexp_extract(k, r'{START_TAG}', 0)),
        t -> named_struct(
          'tag', t, 'name', lower(regexp_extract(t, r'^<([^\s/>]+)', 1)),
          'attributes', regexp_extract_all(
              regexp_extract(t, r'(?s)^<[^\s/>]+(.*)>$', 1), r'{ATTRIBUTE}', 0)))""")


def named(attribute: str, *names: str) -> str:
    """SQL condition: an attribute, as written, has one of the names."""
    return (f"lower(regexp_extract({attribute}, r'^([^\\s=]+)', 1)) IN ("
            + ", ".join(f"'{name}'" for name in names) + ")")


def raw_value(attributes: str, name: str) -> str:
    """SQL text: undecoded value of the first such attribute.

    Empty if it has no value, NULL if there is none.
    """
    first = f"try_element_at(filter({attributes}, a -> {named('a', name)}), 1)"
    return let(rf"regexp_replace({first}, r'(?s)^[^=]*+(?:=\s*+)?+', '')", "v",
               r"""CASE WHEN v RLIKE r'(?s)^[\x22\x27].*[\x22\x27]$'
                        THEN substr(v, 2, length(v) - 2) ELSE v END""")


_CHARACTER_SQL = let(
    """lpad(CASE WHEN ref RLIKE '^#[xX]' THEN substr(ref, 3)
                 ELSE conv(substr(ref, 2), 10, 16) END, 8, '0')""",
    "code", r"""CASE WHEN code RLIKE r'(?i)^00(?:0[0-9a-f]|10)[0-9a-f]{4}$'
                      AND NOT code RLIKE r'(?i)^0000d[89a-f]|^00000000$'
                     THEN decode(unhex(code), 'UTF-32') ELSE '\ufffd' END""")

# Each piece starts with the ampersand of at most one reference.
_DECODE_SQL = "array_join(transform(split(row.value, '(?=&)'), piece -> " + let(
    f"regexp_extract(piece, r'{_REFERENCE}', 1)", "ref",
    f"""CASE WHEN ref = '' THEN piece ELSE concat(
          CASE WHEN startswith(ref, '#') THEN {_CHARACTER_SQL}
               WHEN ref = 'amp' THEN '&'
               ELSE coalesce(try_element_at(row.named, ref), concat('&', ref, ';')) END,
          substr(piece, length(ref) + 3)) END""") + "), '')"


def decode_references(value: Column) -> Column:
    """Replace character references in an attribute value, each exactly once."""
    row = F.struct(value.alias("value"), _named_references().alias("named"))
    return F.when(value.contains("&"), apply_sql(row, "row", _DECODE_SQL)).otherwise(value)


def _named_references() -> Column:
    """Named references of the HTML standard as one map constant."""
    named = {name[:-1]: text for name, text in html.entities.html5.items()
             if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(named)), "map<string,string>")
