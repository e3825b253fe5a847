"""What a Python worker keeps between tasks: one large model at a time.

Workers are used again by later stages.  A tokenizer's cache beside the models
of another stage would take an executor's memory twice, so that asking for one
thing lets go of any other.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import suppress
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_held: dict[str, object] = {}


def only(name: str, make: Callable[[], T]) -> T:
    """The thing of this name, made at first use; others are let go."""
    if name not in _held:
        forget()
        _held[name] = make()
    return _held[name]


def forget() -> None:
    """Let go of everything and give free memory back to the system; stages without a model begin with it."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
