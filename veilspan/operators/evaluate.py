"""Recall, round trip and false positives over labelled text (EVAL1-EVAL5, JN9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.config import ScanConfig
from veilspan.operators.entropy import entropy_tokens
from veilspan.operators.patterns import settled
from veilspan.plans.scan import add_findings, add_redaction, add_scan, compile_scanner, redact_table

NAMED = ("pattern", "softwrap", "deep")


def _fired(sections: DataFrame, cfg: ScanConfig, key: str, text: str) -> DataFrame:
    found = add_findings(sections.withColumnRenamed(text, "text"), cfg)
    names = F.transform(
        F.filter("findings", lambda f: f["source"].isin(*NAMED)), lambda f: f["name"]
    )
    return found.withColumn("fired", F.array_distinct(names)).drop("findings").withColumnRenamed(
        "text", text
    )


def recall(sections: DataFrame, cfg: ScanConfig, key: str = "section", text: str = "body") -> DataFrame:
    """Expected names that did not fire, one row each (EVAL1, JN9)."""
    missed = F.array_except("expected", "fired")
    return (
        _fired(sections, cfg, key, text)
        .select(key, F.explode_outer(missed).alias("missed"))
        .filter("missed is not null")
    )


def round_trip(docs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Documents whose redacted copy still has a pattern or deep finding (EVAL2)."""
    redacted = redact_table(docs, cfg).select("doc_id", "text")
    return _fired(redacted, cfg, "doc_id", "text").filter(F.size("fired") > 0).select("doc_id", "fired")


def false_positives(docs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Clean documents in which something fired (EVAL3)."""
    return _fired(docs.select("doc_id", "text"), cfg, "doc_id", "text").filter(
        F.size("fired") > 0
    ).select("doc_id", "fired")


def fixed_point(docs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Documents that change when redacted a second time (EVAL4); both passes stay on the document's row."""
    sc = compile_scanner(docs.sparkSession, cfg)
    first = add_redaction(add_scan(docs.select("doc_id", "text"), sc), sc)
    once = settled(first, ["doc_id"], {"text": F.col("redacted")})
    second = add_redaction(add_scan(once, sc), sc)
    twice = settled(second, ["doc_id"], {"same": F.col("text").eqNullSafe(F.col("redacted"))})
    return twice.filter("not same").select("doc_id")


def monotone(docs: DataFrame, low: float, high: float, min_len: int, max_len: int) -> DataFrame:
    """Token counts under a lower and a higher threshold (EVAL5)."""
    tokens = entropy_tokens(docs, min_len, max_len, low)
    return tokens.agg(
        F.count("*").alias("at_low"), F.count_if(F.col("score") >= high).alias("at_high")
    )
