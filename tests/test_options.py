"""Sinks named in settings files."""

import pytest

from webstrata.options import CaptureOptions, options_from_properties
from webstrata.sources.sinks import LogSink, ResponseStoreSink, WarcSink, load_sink


@pytest.mark.parametrize("name,kind", [
    ("org.example.recorder.WARCRecorder", WarcSink), ("org.example.LoggingRecorder", LogSink),
    ("log", LogSink), ("webstrata.sources.sinks:WarcSink", WarcSink)])
def test_recorder(name, kind):
    opts = options_from_properties(f"CALL_RECORDER={name}")
    assert type(load_sink(opts.recorder)) is kind


def test_store():
    opts = options_from_properties("SERVER_RESPONSE_CACHE=org.example.disk.HashedResponseCache")
    assert type(load_sink(opts.store)) is ResponseStoreSink


def test_unknown_kind_is_reported():
    with pytest.warns(UserWarning, match="no sink for org.example.Telegraph"):
        opts = options_from_properties("CALL_RECORDER=org.example.Telegraph")
    assert opts.recorder == CaptureOptions().recorder
    with pytest.raises(ValueError, match="unknown sink nothing"):
        load_sink(options_from_properties("CALL_RECORDER=nothing").recorder)
