"""Job options, read from a Java-style properties file."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class CaptureOptions:
    max_click_depth: int = 100
    submit_forms: bool = False
    one_request_per_host: bool = True
    include_local_files: bool = False
    include_seed_subdomains: bool = True
    include_hosts: tuple[str, ...] = ()
    exclude_hosts: tuple[str, ...] = ()
    user_agent: str | None = None
    page_load_timeout_ms: int = 20_000
    stability_interval_ms: int = 1_000
    store_path: str | None = None
    clear_store_on_init: bool = True
    recorder: str = "webstrata.sources.sinks:WarcSink"
    store: str = "webstrata.sources.sinks:ResponseStoreSink"
    warc_path: str | None = None
    cdx_path: str | None = None

    def with_(self, **changes) -> CaptureOptions:
        return replace(self, **changes)


# Property names of the public configuration format.
PROPERTY_NAMES = {
    "MAX_ANCESTOR_CLICK_DEPTH": "max_click_depth",
    "SUBMIT_FORMS": "submit_forms",
    "LIMIT_TO_SINGLE_CONCURRENT_HIT_PER_DOMAIN": "one_request_per_host",
    "INCLUDE_LOCAL_FILE_URIS": "include_local_files",
    "INCLUDE_SUBDOMAINS_OF_SEEDS": "include_seed_subdomains",
    "EXTERNAL_DOMAIN_INCLUSION_PATTERNS": "include_hosts",
    "EXTERNAL_DOMAIN_EXCLUSION_PATTERNS": "exclude_hosts",
    "USER_AGENT": "user_agent",
    "PAGE_LOAD_TIMEOUT": "page_load_timeout_ms",
    "DOM_STABILITY_CHECK_INTERVAL": "stability_interval_ms",
    "SERVER_RESPONSE_CACHE__CACHE_PATH": "store_path",
    "SERVER_RESPONSE_CACHE__CLEAR_ON_INIT": "clear_store_on_init",
    "CALL_RECORDER": "recorder",
    "SERVER_RESPONSE_CACHE": "store",
    "CALL_RECORDER__WARC_PATH": "warc_path",
    "CALL_RECORDER__CDX_PATH": "cdx_path",
}

_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    def one(match: re.Match) -> str:
        code = match.group(1)
        if code.startswith("u") and len(code) == 5:
            return chr(int(code[1:], 16))
        return _ESCAPES.get(code, code)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, text, flags=re.S)


def parse_properties(text: str) -> dict[str, str]:
    """Key/value pairs of a properties text: comments, line continuations, escapes."""
    joined = re.sub(r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t\f]*", r"\1", text)
    found = {}
    for line in joined.splitlines():
        line = line.lstrip(" \t\f")
        if not line or line[0] in "#!":
            continue
        key, value = re.fullmatch(
            r"((?:\\.|[^\\=: \t\f])*)[ \t\f]*[=:]?[ \t\f]*(.*)", line, re.S).groups()
        found[_unescape(key)] = _unescape(value)
    return found


# What the last part of another runtime's class name says about its kind of sink.
_KINDS = (("warc", "warc"), ("log", "log"), ("cache", "store"), ("store", "store"))


def _own_sink(class_name: str) -> str | None:
    """The registered sink of the kind a dotted class name of another runtime tells."""
    last = class_name.strip().rsplit(".", 1)[-1].lower()
    return next((sink for word, sink in _KINDS if word in last), None)


def options_from_properties(*texts: str, base: CaptureOptions | None = None) -> CaptureOptions:
    """Options from one or more properties texts; unknown keys are ignored.

    Recorder and store may be registered names, ``module:Class``, or class names of another runtime,
    which stand for the registered sink of their kind; one of no known kind leaves the default, with a
    warning.
    """
    pairs: dict[str, str] = {}
    for text in texts:
        pairs.update(parse_properties(text))
    delimiter = pairs.get("DOMAIN_INCLUSION_PATTERN_DELIM", ";")
    kinds = {field.name: field.type for field in fields(CaptureOptions)}
    changes: dict[str, object] = {}
    for name, value in pairs.items():
        target = PROPERTY_NAMES.get(name)
        if target is None:
            continue
        kind = kinds[target]
        if kind == "int":
            changes[target] = int(value)
        elif kind == "bool":
            changes[target] = value.lower() == "true"
        elif kind.startswith("tuple"):
            parts = (part.strip() for part in re.split(delimiter, value))
            changes[target] = tuple(part for part in parts if part)
        elif target in ("recorder", "store") and ":" not in value and not value.isidentifier():
            own = _own_sink(value)
            if own is None:
                warnings.warn(f"{name}: no sink for {value}, {getattr(CaptureOptions, target)} is used",
                              stacklevel=2)
            else:
                changes[target] = own
        else:
            changes[target] = value
    return (base or CaptureOptions()).with_(**changes)
