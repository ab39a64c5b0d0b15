"""Redacting and counting streams (STR1, STR4, STR5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.config import ScanConfig
from veilspan.plans.scan import redact_table
from veilspan.sources.redaction_log import append_redaction_log, write_epoch


def redact_stream(
    stream: DataFrame, cfg: ScanConfig, catalog: DataFrame | None = None, policy: str = "quarantine"
) -> DataFrame:
    """Redact every message (STR1): (doc_id, text, names, n, too_large).

    The redaction is narrow, so the batch plan runs on a stream as it is:
    stateless, append mode, no foreachBatch.  Messages above
    ``cfg.size_limit`` bytes (SNK5) are not scanned: with ``quarantine`` their
    text is withheld (NULL), with ``pass`` it goes on as it is; ``scan`` scans
    every message.  They are marked ``too_large``.
    """
    if policy not in ("quarantine", "pass", "scan"):
        raise ValueError(f"unknown policy {policy!r}")
    large = F.coalesce(F.octet_length("text") > cfg.size_limit, F.lit(False))
    marked = stream.select("doc_id", "text", (F.lit(False) if policy == "scan" else large).alias("too_large"))
    if policy == "scan":
        return redact_table(marked, cfg, catalog).withColumn("too_large", F.lit(False))
    small = redact_table(marked.filter("not too_large"), cfg, catalog).withColumn("too_large", F.lit(False))
    text = F.col("text") if policy == "pass" else F.lit(None).cast("string")
    apart = marked.filter("too_large").select(
        "doc_id",
        text.alias("text"),
        F.expr("cast(array() as array<string>)").alias("names"),
        F.lit(0).alias("n"),
        "too_large",
    )
    return small.unionByName(apart)


def redaction_counts(
    stream: DataFrame, window: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Sum of ``count`` per event-time window of ``ts`` (STR4)."""
    if stream.isStreaming:
        stream = stream.withWatermark("ts", delay)
    return (
        stream.groupBy(F.window("ts", window, slide).alias("w"))
        .agg(F.sum("count").alias("count"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count")
    )


def count_sink(path: str, query: str | None = None):
    """A foreachBatch function: one log row per batch that redacted something (STR5).

    With the name of a query, rows are keyed by it and the batch's epoch, and a
    batch that is run again is logged once.  Without, they are appended, so a
    batch that is run again is logged again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        total = batch.agg(
            F.current_timestamp().alias("ts"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("count"),
        )
        if query is None:
            append_redaction_log(total, path)
        else:
            write_epoch(total, path, query, epoch)

    return write
