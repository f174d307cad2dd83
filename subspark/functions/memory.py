"""Memory of Python workers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

#: What tasks of one operator keep for the next ones of their worker.
HELD: list[dict] = []


def release(keep: dict | None = None) -> None:
    """Give memory that a task has freed back to the system: idle workers stay for a while, beside those of later stages.
    What other operators' tasks left in the worker goes too; `keep` stays."""
    for each in HELD:
        if each is not keep:
            each.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
