"""Suppressing findings that lie inside allow-listed text (DET6, JN1).

Containment in any allow-list match needs no pairs: with the matches sorted by
start, a span is inside one of them exactly when the largest end among those
starting at or before it reaches its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.build import lit
from veilspan.functions.arrays import count_le, let, prefix_max
from veilspan.functions.regex import UnsupportedPattern, java_regex
from veilspan.sources import fixed_values


def allow_patterns(user: tuple[str, ...] = ()) -> list[str]:
    """Built-in allow-list, then the user's; unusable user patterns are ignored."""
    out = list(fixed_values.ALLOWLIST)
    for pattern in user:
        try:
            java_regex(pattern)
        except UnsupportedPattern:
            continue
        if pattern and len(pattern.encode()) <= 2000:
            out.append(pattern)
    return out


def allow_index(spans: Column) -> Column:
    """struct<starts, reach>: sorted starts and the largest end so far."""
    return let(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"]))),
        lambda a: F.struct(
            F.transform(a, lambda s: s["start"]).alias("starts"),
            prefix_max(F.transform(a, lambda s: s["end"])).alias("reach"),
        ),
    )


def is_allowed(index: Column, start: Column, end: Column) -> Column:
    """The span lies fully inside one allow-list match."""
    n = count_le(index["starts"], start)
    return F.coalesce(F.get(index["reach"], n - lit(1)) >= end, lit(False))


def suppress(spans: Column, index: Column) -> Column:
    """Drop allowed spans of an array; spans without a place are kept."""
    return F.when(F.size(index["starts"]) == 0, spans).otherwise(
        let(
            index,
            lambda ix: F.filter(
                spans,
                lambda s: s["start"].isNull() | ~is_allowed(ix, s["start"], s["end"]),
            ),
        )
    )


def allowlist_suppress(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Table form: findings not contained in an allow-list match of their document.

    A running maximum over (start, allow-list first) replaces the join, so no
    pair of rows is ever formed.  ``allowed`` has doc_id, start, end.
    """
    marked = findings.withColumn("_allow_end", lit(None).cast("int")).unionByName(
        allowed.select("doc_id", "start", "end", F.col("end").alias("_allow_end")),
        allowMissingColumns=True,
    )
    order = Window.partitionBy("doc_id").orderBy(F.col("start"), F.col("_allow_end").isNull())
    reach = F.max("_allow_end").over(order.rangeBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_reach", reach)
        .filter(F.col("_allow_end").isNull())
        .filter(F.col("start").isNull() | F.coalesce(F.col("_reach") < F.col("end"), lit(True)))
        .select(*findings.columns)
    )
