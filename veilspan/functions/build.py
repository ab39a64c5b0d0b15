"""Building large generated expressions quickly.

A scan is an expression of thousands of nodes, each made by a call into the
JVM.  Literals and whole expressions do not depend on the data, so they are
made once per Spark context and reused by every plan.
"""

from __future__ import annotations

import functools
import json
from collections import OrderedDict
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.errors import utils as _origin
from pyspark.sql import Column
from pyspark.sql import functions as F


@contextmanager
def _quiet():
    """No call site per expression node: these nodes are generated, not written."""
    before = getattr(_origin, "_enable_debugging_cache", None)
    _origin._enable_debugging_cache = False
    try:
        yield
    finally:
        _origin._enable_debugging_cache = before


def generated(fn: Callable) -> Callable:
    """For functions that build expressions of many nodes."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        with _quiet():
            return fn(*args, **kwargs)

    return run


KEPT = 50_000  # expressions; those not used for longest go first


class _Store(OrderedDict):
    """Expressions of one Spark context, the latest used last."""

    def made(self, key, make: Callable[[], Column]) -> Column:
        if key in self:
            self.move_to_end(key)
            return self[key]
        self[key] = column = make()
        if len(self) > KEPT:
            self.popitem(last=False)
        return column


_made: dict = {}


def _store() -> _Store:
    context = SparkContext._active_spark_context
    if _made.get("context") is not context:
        _made.update(context=context, columns=_Store())
    return _made["columns"]


def reused(fn: Callable) -> Callable:
    """Keep the column a function makes; its arguments are names and settings."""

    @functools.wraps(fn)
    def run(*args):
        def make() -> Column:
            with _quiet():
                return fn(*args)

        return _store().made((fn.__module__, fn.__qualname__, args), make)

    return run


def lit(value) -> Column:
    return _store().made(("lit", type(value), value), lambda: F.lit(value))


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
        return f"'{escaped}'"
    return str(value)


PARSED = 1_000  # longer lists are not written as SQL, whose parser is slow on them


def literals(values: Iterable, ddl: str) -> Column:
    """An array of literals, made by one call."""
    values = list(values)

    def make() -> Column:
        if len(values) > PARSED:
            return F.from_json(F.lit(json.dumps(values)), f"array<{ddl}>")
        return F.expr(f"cast(array({', '.join(map(_sql, values))}) as array<{ddl}>)")

    return _store().made(("array", tuple(values), ddl), make)


def literal_map(pairs: Iterable[tuple], ddl: str) -> Column:
    """A map of literals, made by one call; tuple values become arrays."""
    pairs = list(pairs)

    def make() -> Column:
        if len(pairs) > PARSED and ddl.startswith("string,"):
            return F.from_json(F.lit(json.dumps(dict(pairs))), f"map<{ddl}>")
        parts = []
        for k, v in pairs:
            text = f"array({', '.join(map(_sql, v))})" if isinstance(v, tuple) else _sql(v)
            parts += [_sql(k), text]
        return F.expr(f"cast(map({', '.join(parts)}) as map<{ddl}>)")

    return _store().made(("map", tuple(pairs), ddl), make)
