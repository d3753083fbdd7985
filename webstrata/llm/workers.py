"""Memory of Python workers, which Spark keeps and hands to tasks of any operator.

A pipeline runs many operators in the same processes. Caches serve one operator's tasks: they are
emptied when a task of another one arrives, and a task's free memory returns to the system, so
an executor holds what its running tasks need, however many stages came before.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

LARGE_GROUP = 1 << 20

_caches: list[dict] = []
_owner: list[str] = []


def cache() -> dict:
    """A cache of this process that ends with the tasks of the operator that filled it."""
    _caches.append({})
    return _caches[-1]


def enter(owner: str) -> None:
    """A task of ``owner`` runs from now on."""
    if _owner != [owner]:
        for held in _caches:
            held.clear()
        _owner[:] = [owner]
        give_back()


def give_back() -> None:
    """Return free memory to the system; allocators would keep it for a later task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # the C library has no such call
        pass


def by_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               owner: str | None = None):
    """``run`` for mapInArrow, tidy before and after."""
    owner = owner or run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        yield from run(batches)
        give_back()

    return task


def by_group(run: Callable[[pa.Table], pa.Table]):
    """``run`` for applyInArrow, tidy before and after large groups."""
    owner = run.__module__

    def group(table: pa.Table) -> pa.Table:
        enter(owner)
        out = run(table)
        if table.nbytes >= LARGE_GROUP:
            give_back()
        return out

    return group
