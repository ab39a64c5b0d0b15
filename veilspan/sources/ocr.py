"""OCR words from tab-separated files (SRC5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.windows import BLOCK_ROWS, running_sum


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of every file under ``path``, numbered in file order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("image_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )
    return parse_ocr_lines(lines)


def parse_ocr_lines(lines: DataFrame) -> DataFrame:
    """Words from lines (image_id, block_start, line_no, line), with their number in reading order.

    The header row has no numeric level, so it drops out with other rows.
    Only level-5 rows with a confidence, a box and some text are words; the
    twelfth column may hold tabs.
    """
    c = F.split("line", "\t", 12)

    def number(i: int):
        return F.when(F.trim(F.get(c, i)).rlike("\\A[0-9]+\\z"), F.trim(F.get(c, i)).try_cast("int"))

    words = lines.select(
        "image_id",
        "block_start",
        "line_no",
        F.trim(F.get(c, 0)).alias("level"),
        F.regexp_replace(F.get(c, 11), "(?U)\\A\\s+|\\s+\\z", "").alias("text"),
        number(6).alias("x"),
        number(7).alias("y"),
        number(8).alias("w"),
        number(9).alias("h"),
        F.trim(F.get(c, 10)).try_cast("float").alias("conf"),
        F.coalesce(number(2), F.lit(0)).alias("block"),
        F.coalesce(number(4), F.lit(0)).alias("line"),
    ).filter(
        "level = '5' and conf >= 0 and text <> '' and x is not null and y is not null "
        "and w is not null and h is not null"
    )
    # splits of one file can be read in any order: their first byte comes before the line's number
    block = F.struct("block_start", F.floor(F.col("line_no") / BLOCK_ROWS))
    order = [F.col("block_start"), F.col("line_no")]
    numbered = running_sum(words.drop("level"), ["image_id"], block, order, F.lit(1), "word_ix")
    return numbered.withColumn("word_ix", (F.col("word_ix") - 1).cast("int"))
