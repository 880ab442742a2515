"""Handing memory back to the system between batches.

Workers live as long as the session.  What their arrays have used stays with the
allocators, beside the memory of the executor's own process, until it is given back.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


_caches: list[dict] = []


def kept(cache: dict) -> dict:
    """Register what an operator keeps in a worker from task to task."""
    _caches.append(cache)
    return cache


def forget() -> None:
    """Drop what other operators have kept: the worker has gone over to another one."""
    for cache in _caches:
        cache.clear()
    give_back()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches of a few large rows each, one at a time."""
    forget()
    for batch in batches:
        for at in range(batch.num_rows):
            yield from batch.slice(at, 1).to_pylist()
            give_back()


def by_batch(work: Callable) -> Callable:
    """``work`` on one Arrow batch at a time (it makes any number of them), giving back after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)
            give_back()

    return run
