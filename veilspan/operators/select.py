"""Choosing rules: relational operators on the catalog table (SEL1-SEL12)."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.build import lit, literals
from veilspan.config import ScanConfig
from veilspan.sources import fixed_values
from veilspan.sources.rules import CUSTOM_BUCKET, MAX_RULES, bucket_table, load_catalog, with_flags

PRESETS = ("minimal", "balanced", "full")


def _names(spark: SparkSession, values: Iterable[str], column: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def filter_buckets(catalog: DataFrame, disabled: Iterable[str]) -> DataFrame:
    """Drop whole buckets by stem (SEL1)."""
    off = _names(catalog.sparkSession, disabled, "bucket")
    return catalog.join(F.broadcast(off), "bucket", "left_anti").select(*catalog.columns)


def filter_custom(custom: DataFrame, disabled: Iterable[str]) -> DataFrame:
    """Drop user rules by category (SEL2)."""
    off = _names(custom.sparkSession, disabled, "category")
    return custom.join(F.broadcast(off), "category", "left_anti").select(*custom.columns)


def merge_rules(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in rules first, then user rules, renumbered in that order (SEL3).

    User rules are in the order of ``pos`` (file and line); a table without it
    has no order of its own, and its rules are then ordered by their fields.
    """
    spark = builtin.sparkSession
    fields = ["name", "category", "severity", "regex"]
    order = ["pos"] if "pos" in custom.columns else fields
    rows = custom.select(*fields, *[c for c in order if c not in fields]).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = [r[:4] for r in sorted(rows, key=lambda r: tuple(r[c] or 0 if c == "pos" else r[c] or "" for c in order))]
    last = builtin.agg(F.max("ord")).first()[0]
    base = 0 if last is None else last + 1
    extra = spark.createDataFrame(
        [(base + i, CUSTOM_BUCKET, *r, None) for i, r in enumerate(rows)],
        "ord int, bucket string, name string, category string, severity string, "
        "regex string, validator string",
    )
    return builtin.unionByName(with_flags(extra))


def preset_buckets(spark: SparkSession, name: str) -> DataFrame:
    """Bucket stems a preset switches on (SEL4)."""
    stems = {
        "minimal": fixed_values.MINIMAL,
        "balanced": fixed_values.BALANCED,
        "full": list(fixed_values.BUCKETS),
    }[name]
    return _names(spark, stems, "bucket")


def disabled_for(name: str) -> tuple[str, ...]:
    """The complement a preset stores, in bucket order."""
    on = {"minimal": fixed_values.MINIMAL, "balanced": fixed_values.BALANCED}.get(name)
    return tuple(b for b in fixed_values.BUCKETS if on is not None and b not in on)


def apply_preset(catalog: DataFrame, name: str) -> DataFrame:
    buckets = preset_buckets(catalog.sparkSession, name)
    return catalog.join(F.broadcast(buckets), "bucket", "left_semi").select(*catalog.columns)


def detect_preset(disabled: Column) -> Column:
    """Which preset an array of disabled stems equals as a set, else NULL (SEL5)."""
    have = F.array_sort(F.array_distinct(disabled))
    out = lit(None).cast("string")
    for name in reversed(PRESETS):
        want = sorted(disabled_for(name))
        target = literals(want, "string")
        out = F.when(have == target, lit(name)).otherwise(out)
    return out


def softwrap_rules(catalog: DataFrame) -> DataFrame:
    """Rules precise enough for rejoined lines (SEL9)."""
    return catalog.filter("softwrap")


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Rules per bucket (SEL11)."""
    return catalog.groupBy("bucket").agg(F.count("*").alias("n"))


def catalog_profile(catalog: DataFrame) -> DataFrame:
    """Rules by bucket and severity, with how many are checksum-gated (SEL12)."""
    severities = ["Critical", "High", "Medium", "Low"]
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in severities]
    return catalog.groupBy("bucket").agg(
        F.count("*").alias("rules"), *counts, F.count("validator").alias("validated")
    )


CUBE = ("bucket", "severity", "category", "validated")


def catalog_cube(catalog: DataFrame, *measures: Column) -> DataFrame:
    """Rules by bucket, severity, category and checksum gate, with all subtotals (SEL12).

    ``level`` is the grouping id: a set bit, bucket first, marks a column that
    is summed over, and tells its NULL from one in the table.
    """
    rows = catalog.withColumn("validated", F.col("validator").isNotNull())
    return rows.cube(*CUBE).agg(F.grouping_id().alias("level"), F.count("*").alias("rules"), *measures)


def active_rules(
    spark: SparkSession,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """The rule table a scan runs: SEL1 on built-ins, SEL2 on user rules, SEL3.

    Warns of enabled buckets for which the catalog has no rule.
    """
    rules = load_catalog(spark) if catalog is None else catalog
    empty = bucket_table(rules).filter("rules = 0").orderBy("bucket_ord").collect()
    silent = [r["bucket"] for r in empty if r["bucket"] not in cfg.disabled_categories]
    if silent:
        warnings.warn(f"no rules are loaded for {len(silent)} enabled buckets: {', '.join(silent)}", stacklevel=2)
    if cfg.disabled_categories:
        rules = filter_buckets(rules, cfg.disabled_categories)
    if custom is not None:
        rules = merge_rules(rules, filter_custom(custom, cfg.disabled_categories))
    return rules
