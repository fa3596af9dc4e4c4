"""Worker caches: Python workers are reused across operators, so only one operator's caches may fill at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_clear: dict[str, Callable[[], None]] = {}
_owner = ""


def register(owner: str, clear: Callable[[], None]) -> None:
    _clear[owner] = clear


def claim(owner: str) -> None:
    """Called when a task of an operator starts: empties what other operators left in this worker."""
    global _owner
    if owner != _owner:
        for name, clear in _clear.items():
            if name != owner:
                clear()
        _owner = owner
        trim()


def trim() -> None:
    """Gives freed memory back to the system; the allocators would keep it for as long as the worker lives."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
