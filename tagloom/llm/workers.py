"""What a Python worker keeps from task to task, and when it gives it back.

Spark uses a worker for one stage after another. What an operator holds there is of use within its stage only, and the
allocator keeps freed memory, so a chain of operators would take the sum of what they need.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark import TaskContext

_held: list[Callable[[], None]] = []
_stage = [-1]


def held_by_worker(give_back: Callable[[], None]) -> None:
    """``give_back`` is called when this worker begins with another stage."""
    _held.append(give_back)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # an allocator without it
        pass


def task(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that starts with what its own stage has kept, and gives free memory back at its end."""
    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        context = TaskContext.get()
        if context is not None and context.stageId() != _stage[0]:
            _stage[0] = context.stageId()
            for give_back in _held:
                give_back()
            gc.collect()
            _trim()
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole
