"""The redaction count log: JSON lines of (ts, count) (SRC7, SNK3, SNK4, AGG4)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.windows import BLOCK_ROWS, running_sum

LOG_LIMIT = 1024 * 1024
MAX_COUNT = 2**63 - 1


#: Date, time to the second or finer, and a zone (RFC 3339).
STAMP = "^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?(?:[Zz]|[+-]\\d{2}:\\d{2})$"


def parse_log(raw: DataFrame) -> DataFrame:
    """(ts TIMESTAMP, count) from text columns; unusable rows are dropped, also times without a zone."""
    return raw.select(
        F.when(F.col("ts").rlike(STAMP), F.try_to_timestamp(F.upper("ts"))).alias("ts"), F.col("count").cast("bigint").alias("count")
    ).filter("ts is not null and count is not null and count >= 0")


def read_redaction_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a table; malformed lines and bad dates are skipped (SRC7)."""
    raw = spark.read.schema(schemas.REDACTION_LOG).option("mode", "DROPMALFORMED").json(path)
    return parse_log(raw)


def _lines(counts: DataFrame) -> DataFrame:
    return counts.filter("count > 0").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), "count"
    )


def append_redaction_log(counts: DataFrame, path: str) -> None:
    """Append (ts, count) rows with a non-zero count (SNK3)."""
    _lines(counts).write.mode("append").json(path)


def write_epoch(counts: DataFrame, path: str, query: str, epoch: int) -> None:
    """The log rows of one micro-batch of a stream, exactly once (SNK3, STR5).

    Each (query, epoch) has a folder of its own, which a repeated batch writes
    again; ``read_redaction_log(path)`` reads all of them.
    """
    _lines(counts).write.mode("overwrite").json(f"{path}/query={query}/epoch={epoch}")


def retain_newest_half(log: DataFrame, size: Column | int, pos: str = "pos", limit: int = LOG_LIMIT) -> DataFrame:
    """Without the oldest half, by position, once the log is above ``limit`` bytes (SNK4).

    ``pos`` numbers the rows in file order; ranks come from per-block counts,
    so no task sees the whole log.
    """
    total = log.agg(F.count("*").alias("_n"), F.lit(size).alias("_size") if isinstance(size, int) else size.alias("_size"))
    ranked = running_sum(
        log, [], F.floor(F.col(pos) / BLOCK_ROWS), [F.col(pos)], F.lit(1).cast("bigint"), "_rank"
    )
    kept = ranked.crossJoin(F.broadcast(total)).filter(
        (F.col("_size") <= limit) | (F.col("_rank") > F.floor(F.col("_n") / 2))
    )
    return kept.select(*log.columns)


# ---- a log that is rewritten when it gets large --------------------------

MANIFEST = "_manifest"
_ENTRY = "version bigint, folder string"
#: A written file's part number, what all files of its write share, and its place among the files of its part.
_PART = "part-(\\d+)-([^/]+?)(?:-c(\\d+))?\\.[^/]*$"


def current_folder(spark: SparkSession, path: str) -> str:
    """The folder that the newest entry of the manifest names; a log without a manifest has its first folder."""
    try:
        entries = spark.read.schema(_ENTRY).json(f"{path}/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return f"{path}/log-0"
    newest = entries.agg(F.max(F.struct("version", "folder")).alias("m")).first()["m"]
    return f"{path}/{newest['folder'] if newest else 'log-0'}"


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of a log as text, with the number of their split and their place in it.

    Writes are in the order of time, the files of one write in that of their
    part numbers: its tasks may end in any order.  Splits are in the order of
    their first byte; there are as many of them as there are input splits.
    """
    raw = spark.read.text(folder).select(
        "value",
        F.struct(
            F.col("_metadata.file_modification_time").alias("at"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("byte"),
        ).alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    file = F.col("split.file")
    splits = raw.select("split").distinct().select(
        "split",
        F.coalesce(F.nullif(F.regexp_extract(file, _PART, 2), F.lit("")), file).alias("write"),
        *[F.regexp_extract(file, _PART, g).try_cast("bigint").alias(c) for c, g in (("part", 1), ("piece", 3))],
    )
    written = splits.withColumn("written", F.min("split.at").over(Window.partitionBy("write")))
    order = Window.orderBy("written", "write", "part", "piece", "split.file", "split.byte")
    numbered = written.select("split", F.row_number().over(order).alias("split_no"))
    return raw.join(numbered, "split").select("value", "split_no", "line")


def rewrite_log(spark: SparkSession, path: str, limit: int = LOG_LIMIT) -> str:
    """Drop the oldest half of a written log, by position, once its files hold over ``limit`` bytes (SNK4).

    Sizes come from the files' metadata.  The newer half is written to a new
    folder, and an entry in the manifest makes it the log: readers see the old
    one or the new one.  Lines stay as they are.  Returns the current folder;
    the old one is left for the readers that are in it.
    """
    folder = current_folder(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if (files.load(folder).agg(F.sum("length")).first()[0] or 0) <= limit:
        return folder
    lines = _placed(spark, folder)
    ranked = running_sum(lines, [], F.col("split_no"), [F.col("line")], F.lit(1).cast("bigint"), "rank")
    drop = lines.count() // 2
    new = f"log-{uuid.uuid4().hex}"
    kept = ranked.filter(F.col("rank") > drop)
    # the order of lines is that of the files' names
    kept.repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.option(
        "compression", "none"
    ).text(f"{path}/{new}")
    entries = spark.createDataFrame([(_next_version(spark, path), new)], _ENTRY)
    entries.write.mode("append").json(f"{path}/{MANIFEST}")
    return f"{path}/{new}"


def _next_version(spark: SparkSession, path: str) -> int:
    if current_folder(spark, path).endswith("/log-0"):
        return 1
    newest = spark.read.schema(_ENTRY).json(f"{path}/{MANIFEST}").agg(F.max("version")).first()[0]
    return newest + 1


def age_buckets(log: DataFrame, now: str) -> DataFrame:
    """Counts by age with exclusive bounds; future rows only in the total (AGG4)."""
    at = F.to_timestamp(F.lit(now))
    count = F.col("count").cast("decimal(38,0)")

    def younger(hours: int) -> Column:
        inside = (F.col("ts") <= at) & (F.col("ts") > at - F.expr(f"INTERVAL {hours} HOURS"))
        return _saturated(F.sum(F.when(inside, count)))

    return log.agg(
        younger(24).alias("last_24h"),
        younger(24 * 7).alias("last_7d"),
        younger(24 * 30).alias("last_30d"),
        younger(24 * 90).alias("last_90d"),
        _saturated(F.sum(count)).alias("total"),
    )


def _saturated(total: Column) -> Column:
    top = F.lit(MAX_COUNT).cast("decimal(38,0)")
    return F.least(F.coalesce(total, F.lit(0).cast("decimal(38,0)")), top).cast("bigint")
