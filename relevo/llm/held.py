"""What a Python worker keeps between tasks: one large object at a time, and no memory that is no longer used.

Spark reuses its Python workers from stage to stage, and each would add up what every stage builds.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

from relevo.llm import words

_held: dict = {}


def one(name: str, key, make):
    """The object that ``make`` builds; kept until another is asked for, or a step that keeps another ``name`` begins."""
    if _held.get("key") != (name, key):
        _held.clear()
        _held.update(key=(name, key), value=make())
    return _held["value"]


def _release() -> None:
    words.drop_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidy(run, keeps: str = ""):
    """``run`` over batches, which drops what steps of another name hold before it begins, and gives memory back at its end."""
    def step(batches):
        if _held and _held["key"][0] != keeps:
            _held.clear()
        try:
            yield from run(batches)
        finally:
            _release()
    return step
