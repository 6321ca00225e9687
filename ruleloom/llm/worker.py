"""What a Python worker keeps between the tasks of one stage, and gives back when another stage begins."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import TaskContext

_held: dict[Any, Any] = {}
_of_stage: list[int | None] = [None]


def begin() -> None:
    """To be called as a task begins: drops what was kept for another stage, and hands freed memory back to the machine."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if stage == _of_stage[0]:
        return
    _of_stage[0] = stage
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere freed memory stays with the worker
    if trim is not None:
        trim(0)


def hold() -> None:
    """From now on freed memory of up to 64 MB stays with the worker: arrays made anew each step would else be mapped and cleared by the machine each time."""
    begin()
    tune = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc's
    if tune is not None:
        tune(-1, 1 << 26)  # M_TRIM_THRESHOLD
        tune(-3, 1 << 25)  # M_MMAP_THRESHOLD


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once a worker and stage."""
    begin()
    if key not in _held:
        _held[key] = make()
    return _held[key]
