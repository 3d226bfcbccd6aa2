"""Small helpers that run inside Python tasks."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa


def worker_cache(name: str) -> dict:
    """A dict that lives as long as this Python worker, whatever task asks for it."""
    holder = sys.modules.setdefault("textmap_worker_cache", types.ModuleType("textmap_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def release_caches() -> None:
    """Empty the caches that earlier stages left in this Python worker, and give back what they and earlier batches held."""
    for cache in sys.modules.get("textmap_worker_cache", types.ModuleType("none")).__dict__.values():
        if isinstance(cache, dict):
            cache.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: the allocators of Python and Arrow keep it for a worker's whole life otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function of batches, that begins without caches of earlier stages and leaves no freed memory with the worker."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        yield from run(batches)
        give_back()

    return tidied


def mixed64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
