"""Small helpers shared by the operators."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none (tests).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def col(name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty, broken UTF-8 is replaced."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [b.decode("utf-8", "replace") for b in byte_strings(column)]


def byte_strings(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, math.ceil(rows / max(1, math.ceil(batch.column(text).nbytes / most))))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows with the smallest hash of ``key``: the same at every run.

    Only hashes are ordered to find where the sample ends; the rows themselves
    are then filtered, so that no task sends more than belongs to the sample.
    """
    h = F.xxhash64(F.lit("sample"), F.col(key))
    last = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return df.limit(0)
    return df.filter(h <= last).orderBy(h, key).limit(rows)


def block_pairs(
    candidates: DataFrame,
    queries: DataFrame,
    search: Callable,
    schema: str,
    candidate_block: int,
    query_block: int,
) -> DataFrame:
    """Run ``search(key, candidates, queries)`` on each pair of bounded blocks.

    Both tables have ``vec_id`` and ``v`` (array).  Rows are dealt to blocks by
    a hash of the id, so that no vector, id or cluster makes a block large, and
    a task holds one block of either table.  Only equal dimensions meet.
    """
    n_c = max(1, math.ceil(candidates.count() / candidate_block))
    n_q = max(1, math.ceil(queries.count() / query_block))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (
            df.withColumn("_dim", F.size("v"))
            .withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        )

    keys = ["_dim", "_c", "_q"]
    c = dealt(candidates, "_c", n_c, "_q", n_q).groupBy(*keys)
    q = dealt(queries, "_q", n_q, "_c", n_c).groupBy(*keys)
    return c.cogroup(q).applyInPandas(search, schema)
