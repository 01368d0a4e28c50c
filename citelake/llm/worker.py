"""What a Python worker keeps between tasks, and what it gives back after one."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_PLACE = "citelake_worker_cache"


def once(key: str, make: Callable[[], Any]) -> Any:
    """``make()``, made once for each worker process and key."""
    held = sys.modules.setdefault(_PLACE, types.ModuleType(_PLACE)).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` over Arrow batches; once a task is through, the worker returns the memory that it has freed, which it
    would else hold while it waits for the next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run
