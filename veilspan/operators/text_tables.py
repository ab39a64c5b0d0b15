"""Lines and tokens of documents as tables (DET13, DET14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import line_starts, locate


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start): lines end with a newline (DET13)."""
    rows = F.arrays_zip(
        F.split("text", "\n").alias("line"), line_starts(F.col("text")).alias("start")
    )
    return docs.select("doc_id", F.posexplode(rows).alias("line_no", "r")).select(
        "doc_id", "line_no", "r.line", "r.start"
    )


def ws_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token, start, end) of runs without white space (DET14)."""
    return (
        docs.select("doc_id", F.posexplode_outer(locate(F.col("text"), "\\S+")).alias("pos", "t"))
        .filter("t is not null")
        .select("doc_id", "pos", F.col("t.value").alias("token"), "t.start", "t.end")
    )
