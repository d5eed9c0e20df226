"""Column expressions built once per JVM.

A feature plan has thousands of expression nodes, each of them a call from Python to the JVM. The
expressions do not depend on the data, so they are built on first use and shared by later plans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def built_once(function: Callable) -> Callable:
    """Caches the result per JVM and arguments; dicts are handed out as copies."""
    cache: dict = {}

    @wraps(function)
    def wrapper(*args):
        key = (id(SparkContext._jvm), *args)
        if key not in cache:
            cache[key] = function(*args)
        found = cache[key]
        return dict(found) if isinstance(found, dict) else found

    return wrapper
