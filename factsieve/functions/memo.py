"""Reuse of large column expressions.

Columns are immutable descriptions, so one built over plain attribute names can serve every plan of a
session. Building the larger ones takes thousands of gateway calls; this keeps that off the planning path.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column

_built: dict[tuple, object] = {}


def once(key: tuple, build: Callable[[], object]) -> object:
    """``build()`` the first time ``key`` is asked for in a session, the same object afterwards."""
    context = SparkContext._active_spark_context
    full = (context.applicationId if context else None, *key)
    if full not in _built:
        _built[full] = build()
    return _built[full]


def _name(value: object) -> object | None:
    """A hashable stand-in for an argument, or None when the expression must be built afresh."""
    if isinstance(value, Column):
        node = value._jc.node() if hasattr(value, "_jc") else None
        if node is not None and node.getClass().getSimpleName() == "UnresolvedAttribute":
            return ("col", value._jc.toString())
        return None
    return value if isinstance(value, (str, int, float, tuple)) else None


def memo(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build the expression once per session for arguments that are plain names or constants."""
    @wraps(build)
    def cached(*args: object, **kwargs: object) -> Column:
        names = tuple(_name(a) for a in args)
        if None in names or kwargs:
            return build(*args, **kwargs)
        return once((build.__module__, build.__qualname__, names), lambda: build(*args))

    return cached
