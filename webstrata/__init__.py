"""Web-capture analytics on Spark: URL identity, scope, frontier, clicks, archives."""

import sys

from pyspark import cloudpickle

from webstrata.options import CaptureOptions
from webstrata.session import build_session

# Tasks carry the package functions they run: executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CaptureOptions", "build_session"]
