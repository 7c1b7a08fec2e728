"""Giving memory back: Python workers live on after a task, and what their allocators keep is lost to the executor."""

from __future__ import annotations

import ctypes
from itertools import islice

import pyarrow as pa


def settle() -> None:
    """Return what Arrow's pool and the C library hold without using it, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def shrink(known: dict, most: int, keep: int) -> None:
    """Bound a memory of results: above ``most`` entries, only the ``keep`` oldest stay, which the commonest words are among."""
    if len(known) > most:
        oldest = list(islice(known.items(), keep))
        known.clear()
        known.update(oldest)
