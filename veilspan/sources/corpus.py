"""The evaluation corpus: sections of labelled text (SRC6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.windows import running_sum

_TRIM = "(?U)\\A\\s+|\\s+\\z"


def read_eval_corpus(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )
    return parse_sections(lines)


def parse_sections(lines: DataFrame) -> DataFrame:
    """(file, section_no, section, expected, body) from (file, block, line_no, line).

    ``block`` cuts a file along its lines, so one huge file stays parallel.
    """
    line = F.regexp_replace("line", "(?U)\\s+\\z", "")
    lead = F.regexp_replace(line, "(?U)\\A\\s+", "")
    kind = (
        F.when(lead.startswith("# === "), "section")
        .when(lead.startswith("# expect:"), "expect")
        .when(lead.startswith("#"), "comment")
        .otherwise("body")
    )
    typed = lines.select(
        "file", "block", "line_no", line.alias("line"), lead.alias("lead"), kind.alias("kind")
    )
    numbered = running_sum(
        typed,
        ["file"],
        F.col("block"),
        [F.col("line_no")],
        (F.col("kind") == "section").cast("int"),
        "section_no",
    ).filter("section_no > 0 and kind <> 'comment'")
    title = F.regexp_replace(
        F.regexp_replace(F.regexp_replace("lead", "\\A# === ", ""), "=+\\z", ""), _TRIM, ""
    )
    label = F.regexp_replace(F.regexp_replace("lead", "\\A# expect:", ""), _TRIM, "")

    def ordered(cond, value):
        rows = F.collect_list(F.when(cond, F.struct("line_no", value.alias("v"))))
        return F.transform(F.sort_array(rows), lambda r: r["v"])

    named = (F.col("kind") == "expect") & ~label.isin("(none)", "")
    return numbered.groupBy("file", "section_no").agg(
        F.max(F.when(F.col("kind") == "section", title)).alias("section"),
        ordered(named, label).alias("expected"),
        F.array_join(
            ordered(F.col("kind") == "body", F.concat(F.col("line"), F.lit("\n"))), ""
        ).alias("body"),
    )
