"""Counts and profiles over the findings table (AGG1-AGG7)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finding_count(findings: DataFrame) -> DataFrame:
    """Findings per document (AGG1)."""
    return findings.groupBy("doc_id").agg(F.count("*").alias("n"))


def has_findings(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Documents with at least one finding (DET11)."""
    return docs.join(findings.select("doc_id").distinct(), "doc_id", "left_semi")


def matched_names(findings: DataFrame) -> DataFrame:
    """Distinct names per document in first-match order (AGG2)."""
    rank = (
        F.when(F.col("source") == "pattern", 0)
        .when(F.col("source") == "softwrap", 1)
        .when(F.col("source") == "deep", 2)
        .otherwise(3)
    )
    first = findings.groupBy("doc_id", "name").agg(F.min(F.struct(rank, "ord", "start")).alias("at"))
    return first.groupBy("doc_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("at", "name"))), lambda r: r["name"]
        ).alias("names")
    )


def count_by(findings: DataFrame, *cols: str) -> DataFrame:
    """Findings by severity, category, bucket, ... (AGG3)."""
    return findings.groupBy(*cols).agg(F.count("*").alias("n"))


def rollup_by_category(findings: DataFrame) -> DataFrame:
    """Counts by category and name with subtotals (AGG3)."""
    return findings.rollup("category", "name").agg(F.count("*").alias("n"))


def leak_profile(findings: DataFrame, docs: DataFrame, *by: str) -> DataFrame:
    """Findings, distinct documents and their share of all documents (AGG5).

    Findings are first counted per document, so the join carries one row per
    (document, category), and a hot category is counted before the shuffle.
    """
    per_doc = findings.groupBy("doc_id", "category").agg(F.count("*").alias("_n"))
    totals = docs.groupBy(*by).agg(F.count("*").alias("docs"))
    found = (
        per_doc.join(docs.select("doc_id", *by), "doc_id")
        .groupBy(*by, "category")
        .agg(F.sum("_n").alias("findings"), F.count("*").alias("leaky_docs"))
    )
    groups = totals.select(*[F.col(c).alias(f"_{c}") for c in by], "docs")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    return (
        found.join(groups, same)
        .select(*by, "category", "findings", "leaky_docs", "docs")
        .withColumn("share", F.col("leaky_docs") / F.col("docs"))
    )


LG_CELLS = 12  # 4096 cells: a standard error of about 1.04 / 64, 1.6 %


def document_sketches(findings: DataFrame, *by: str, lg_cells: int = LG_CELLS) -> DataFrame:
    """(by..., findings, sketch): which documents have findings, as a sketch of bounded size (AGG5).

    Sketches of parts, such as days, merge with ``merge_sketches`` without
    reading the findings again; a document in several parts counts once.
    """
    return findings.groupBy(*by).agg(
        F.count("*").alias("findings"), F.hll_sketch_agg("doc_id", lg_cells).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., findings, sketch, leaky_docs): sketches added up; ``leaky_docs`` is the estimate."""
    merged = sketches.groupBy(*by).agg(
        F.sum("findings").alias("findings"), F.hll_union_agg("sketch").alias("sketch")
    )
    return merged.withColumn("leaky_docs", F.hll_sketch_estimate("sketch"))


def top_documents(findings: DataFrame, k: int) -> DataFrame:
    """The k documents with most findings (AGG6)."""
    return finding_count(findings).orderBy(F.desc("n"), "doc_id").limit(k)


def duplicate_secrets(findings: DataFrame) -> DataFrame:
    """Values (as a hash) found in more than one document (AGG7).

    The inner aggregate makes (value, document) unique with a partial
    aggregate before each shuffle, so one value in most documents is no hot task.
    """
    pairs = findings.filter("value is not null").select(
        F.sha2("value", 256).alias("value_hash"), "name", "doc_id"
    )
    unique = pairs.groupBy("value_hash", "name", "doc_id").agg(F.count("*").alias("_n"))
    return (
        unique.groupBy("value_hash", "name")
        .agg(F.count("*").alias("docs"), F.sum("_n").alias("n"))
        .filter("docs > 1")
    )
