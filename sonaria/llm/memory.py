"""Memory of Python processes: large arrays are given back to the system when they are freed.

By default the C library keeps freed arrays of some megabytes, and the Arrow pool its own, so that a worker that
serves one stage after another holds the most that each of them needed.
"""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa

# Parameters of mallopt(3).
TRIM_THRESHOLD, MMAP_THRESHOLD, ARENA_MAX = -1, -3, -8


def settle() -> None:
    """Keep little freed memory in this process from now on."""
    if sys.platform == "linux":
        library = ctypes.CDLL(None)
        for name, value in ((MMAP_THRESHOLD, 8 << 20), (TRIM_THRESHOLD, 32 << 20), (ARENA_MAX, 2)):
            library.mallopt(name, value)
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Give back what is free, after a fit that the driver outlives."""
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


settle()
