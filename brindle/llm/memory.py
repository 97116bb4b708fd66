"""Memory that a Python worker gives back when a task's work is done.

Workers are kept for later tasks, and what the allocators keep counts against
the executor all that time."""

from __future__ import annotations


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)
