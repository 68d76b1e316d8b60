"""Shared helpers: scratch tables in the shared folder, and caches of Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

from strandline.storage import drop_path, materialize, scratch_dir, scratch_path  # noqa: F401

_held: dict[str, object] = {}


def worker_cache(owner: str, make: Callable[[], object]):
    """What a Python worker keeps for one owner between tasks; taking up another owner drops it.

    Workers outlive stages, so without this each stage's cache would stay beside the next one's.
    """
    if owner not in _held:
        if _held:
            _held.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass
        _held[owner] = make()
    return _held[owner]
