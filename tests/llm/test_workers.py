"""Caches of a worker process end with the tasks of the operator that filled them."""

import pyarrow as pa

from webstrata.llm import workers


def _batch():
    return pa.RecordBatch.from_pydict({"x": [1, 2]})


def test_cache_lives_while_one_operator_runs():
    held = workers.cache()
    workers.enter("one")
    held["model"] = 1
    workers.enter("one")
    assert held == {"model": 1}
    workers.enter("two")
    assert held == {}


def test_batches_and_groups_pass_unchanged():
    held = workers.cache()

    def run(batches):
        held["seen"] = True
        yield from batches

    assert list(workers.by_batches(run, "three")(iter([_batch()]))) == [_batch()]
    assert list(workers.by_batches(run, "three")(iter([]))) == []
    assert held == {"seen": True}
    table = pa.table({"x": list(range(200_000))})
    assert table.nbytes >= workers.LARGE_GROUP
    assert workers.by_group(lambda part: part)(table) is table
    assert held == {}


def test_no_failure_without_the_trimming_call(monkeypatch):
    monkeypatch.setattr(workers.ctypes, "CDLL", lambda name: object())
    workers.give_back()
