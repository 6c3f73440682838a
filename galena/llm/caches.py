"""What a Python worker remembers between tasks, and how one operator makes room for another.

Workers are reused, so the vocabulary, memos and freed memory of one operator would
stay while the next one runs.  A task names its operator and the caches that it
uses; when that is another operator than before, all other caches are emptied.
Every few seconds freed memory goes back to the system.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable

import pyarrow as pa

_EMPTY: dict[str, Callable[[], None]] = {}
_OWNER = [""]
_TRIMMED = [0.0]


def register(name: str, empty: Callable[[], None]) -> None:
    _EMPTY[name] = empty


def claim(owner: str, *uses: str) -> None:
    if owner == _OWNER[0] and time.monotonic() < _TRIMMED[0] + 3:
        return
    if owner != _OWNER[0]:
        _OWNER[0] = owner
        for name, empty in _EMPTY.items():
            if name not in uses:
                empty()
        gc.collect()
    _TRIMMED[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass
