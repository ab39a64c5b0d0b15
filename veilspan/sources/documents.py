"""Reading documents and writing results (SRC1, SRC2, SNK1, SNK2, SNK5, SNK6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.config import SIZE_LIMIT


def read_documents(
    spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text) from a table, or one file per row with ``fmt='files'`` (SRC1)."""
    if fmt == "files":
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if fmt in ("csv", "json"):
        reader = reader.schema(f"{id_col} bigint, {text_col} string")
    table = reader.format(fmt).load(path)
    return table.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def spread(docs: DataFrame, partitions: int) -> DataFrame:
    """The same rows dealt out to ``partitions`` tasks.

    For inputs whose files hold fewer row groups than there are cores; a table
    of many files needs none of it, and scans never shuffle by themselves.
    """
    return docs.repartition(partitions)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Chat turns, one document per turn (SRC2)."""
    turns = spark.read.parquet(path)
    key = F.concat_ws(":", F.col("conv_id"), F.col("turn"))
    return turns.select(key.alias("doc_id"), "conv_id", "turn", "role", "text")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages, scanned as they are (SRC2)."""
    return spark.read.parquet(path).select(
        F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text")
    )


def write_findings(findings: DataFrame, path: str, with_values: bool = False) -> None:
    """Findings by category; the found text is left out unless asked for (SNK1)."""
    out = findings if with_values else findings.drop("value")
    out.withColumn("category", F.coalesce("category", F.col("source"))).write.mode(
        "overwrite"
    ).partitionBy("category").parquet(path)


def write_redacted(redacted: DataFrame, path: str) -> None:
    """Redacted documents under their key (SNK2)."""
    redacted.write.mode("overwrite").parquet(path)


def size_gate(
    docs: DataFrame, limit: int = SIZE_LIMIT, policy: str = "quarantine", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(to scan, too large): strictly above ``limit`` bytes (SNK5).

    ``quarantine`` keeps large texts apart, ``pass`` returns them unredacted in
    the second output with ``passed`` set, ``scan`` scans everything.
    """
    large = F.coalesce(F.octet_length(text) > limit, F.lit(False))
    if policy == "scan":
        return docs, docs.filter(F.lit(False)).withColumn("passed", F.lit(False))
    apart = docs.filter(large).withColumn("passed", F.lit(policy == "pass"))
    return docs.filter(~large), apart


def valid_utf8_gate(docs: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(valid as text, not text) from a BINARY column (SNK6)."""
    text = F.col(raw).cast("string")
    good = docs.filter(F.is_valid_utf8(text)).withColumn("text", text).drop(raw)
    return good, docs.filter(~F.is_valid_utf8(text))
