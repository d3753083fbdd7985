"""Column functions; all of them stay inside the JVM."""

from webstrata.functions.headers import (content_type, flatten_headers, headers_table,
                                         override_headers, recorded_body, single_content_length)
from webstrata.functions.keys import page_key, plain_base64, ref_label, request_key
from webstrata.functions.register import register_functions
from webstrata.functions.urls import (canonical_url, host_suffixes, resolve_href, surt_key,
                                      url_host, url_scheme)

__all__ = [
    "canonical_url", "content_type", "flatten_headers", "headers_table", "host_suffixes",
    "override_headers", "page_key", "plain_base64", "recorded_body", "ref_label",
    "register_functions", "request_key", "resolve_href", "single_content_length", "surt_key",
    "url_host", "url_scheme",
]
