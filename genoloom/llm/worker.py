"""What a worker process holds from task to task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: What this worker remembers for an operator, and how to let go of it.
HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, forget: Callable[[], None]) -> None:
    HELD[name] = forget


def begin(name: str) -> None:
    """A task of operator ``name`` begins: what is remembered for others goes."""
    for other in [x for x in HELD if x != name]:
        HELD.pop(other)()


def trim() -> None:
    """Gives memory that is free back to the system: allocators keep it otherwise, and a worker outlives many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task(name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task of operator ``name``, after which the worker holds no more than it remembers."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(name)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
