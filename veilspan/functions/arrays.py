"""Column helpers over arrays inside one row.

Everything a document produces (matches, lines, cuts) lives in arrays on that
document's own row, so no stage needs a shuffle.  These helpers keep the work
per row at O(n log n): no nested loop over pairs and no array grown by one
element per step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.build import lit, literals

_POWERS_UP = list(range(31))
_POWERS_DOWN = [1 << k for k in range(30, -1, -1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A plain reuse of the expression inside a lambda would be evaluated again
    for each array element.
    """
    return F.get(F.transform(F.array(value), body), lit(0))


def _scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix scan by doubling: log2(n) passes over the array."""

    def one_pass(acc: Column, power: Column) -> Column:
        step = F.call_function("shiftleft", lit(1), power)
        return F.transform(
            acc,
            lambda x, i: F.when(i >= step, combine(x, F.get(acc, i - step))).otherwise(x),
        )

    return F.aggregate(
        F.filter(
            literals(_POWERS_UP, "int"),
            lambda k: F.call_function("shiftleft", lit(1), k) < F.size(values),
        ),
        values,
        one_pass,
    )


def prefix_sum(values: Column) -> Column:
    return let(values, lambda v: _scan(v, lambda a, b: a + b))


def prefix_max(values: Column) -> Column:
    return let(values, lambda v: _scan(v, F.greatest))


def count_le(sorted_values: Column, x: Column) -> Column:
    """How many entries of an ascending array are <= x (binary search)."""
    return F.aggregate(
        literals(_POWERS_DOWN, "int"),
        lit(0),
        lambda acc, p: F.when(
            (acc + p <= F.size(sorted_values)) & (F.get(sorted_values, acc + p - lit(1)) <= x),
            acc + p,
        ).otherwise(acc),
    )


def count_lt(sorted_values: Column, x: Column) -> Column:
    """How many entries of an ascending integer array are < x."""
    return count_le(sorted_values, x - lit(1))


def empty_array(ddl: str) -> Column:
    """A typed empty array, e.g. ``empty_array('struct<start:int,end:int>')``."""
    return F.expr(f"cast(array() as array<{ddl}>)")
