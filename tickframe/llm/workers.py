"""Python workers serve many tasks and stages: what a task held goes back to the machine when it ends."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not this C library
    _trim = None


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def by_task(run):
    """A function of an iterator of record batches that releases memory at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def by_group(run):
    """A function of a group's tables that releases memory after each group. Spark counts the parameters of what it is given."""

    def released(*args):
        try:
            return run(*args)
        finally:
            release()

    return {1: lambda rows: released(rows), 2: lambda key, rows: released(key, rows), 3: lambda key, left, right: released(key, left, right)}[run.__code__.co_argcount]
