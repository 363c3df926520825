"""Memory of Python workers: a worker that has done a large group keeps little of it beside those that work."""

from __future__ import annotations

import contextlib
import ctypes
import inspect

import pyarrow as pa

#: Groups of fewer rows leave too little behind to ask for it.
LARGE = 1024


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function of a group's table, or of two tables or a key and a table, that gives memory back after each large group."""

    def both(first, second):
        try:
            return run(first, second)
        finally:
            if len(first) + len(second) >= LARGE:
                give_back()

    def one(table):
        try:
            return run(table)
        finally:
            if len(table) >= LARGE:
                give_back()

    return one if len(inspect.signature(run).parameters) == 1 else both
