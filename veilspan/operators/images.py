"""From OCR words to the boxes to cover (IMG1-IMG3, JN2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.config import ScanConfig
from veilspan.functions.arrays import count_le, count_lt, let
from veilspan.functions.windows import BLOCK_ROWS, running_max, running_sum
from veilspan.operators.patterns import settled
from veilspan.plans.scan import add_redaction, add_scan, compile_scanner


def word_ranges(words: DataFrame) -> DataFrame:
    """Words with ``sep`` before them and their byte range in the image's text (IMG1)."""
    block = F.floor(F.col("word_ix") / BLOCK_ROWS)
    order = Window.partitionBy("image_id", F.floor(F.col("word_ix") / BLOCK_ROWS)).orderBy("word_ix")
    at = F.struct("word_ix", "block", "line")
    local = words.withColumn("_prev", F.lag(at).over(order))
    lasts = (
        words.groupBy("image_id", (block + 1).alias("_b"))
        .agg(F.max(F.struct("word_ix", "block", "line")).alias("_carry"))
    )
    joined = local.withColumn("_b", block).join(lasts, ["image_id", "_b"], "left")
    before = F.coalesce("_prev", "_carry")
    same = (before["block"] == F.col("block")) & (before["line"] == F.col("line"))
    separated = joined.withColumn(
        "sep", F.when(before.isNull(), "").when(same, " ").otherwise("\n")
    ).drop("_prev", "_carry", "_b")
    size = F.octet_length("sep") + F.octet_length("text")
    ended = running_sum(
        separated, ["image_id"], block, [F.col("word_ix")], size.cast("bigint"), "_end"
    )
    return ended.select(
        *words.columns,
        "sep",
        (F.col("_end") - F.octet_length("text")).cast("int").alias("start"),
        F.col("_end").cast("int").alias("end"),
    )


def assemble(words: DataFrame) -> DataFrame:
    """(image_id, text): the words in order with their separators (IMG1).

    One text per image: an image's words are bounded by the image itself.
    """
    pieces = F.sort_array(F.collect_list(F.struct("word_ix", F.concat("sep", "text").alias("p"))))
    return word_ranges(words).groupBy("image_id").agg(
        F.array_join(F.transform(pieces, lambda r: r["p"]), "").alias("text")
    )


def boxes_for_spans(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct boxes of the words that overlap a span (JN2).

    Word ranges are disjoint and sorted, so a word is hit exactly when the
    largest end among spans starting before its end lies after its start: a
    running maximum, not a join of pairs.
    """
    words = ranges.select(
        "image_id", F.col("end").alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast("int").alias("_reach"), "start", "x", "y", "w", "h",
    )
    marks = spans.filter("start < end").select(
        "image_id", (F.col("start") + 1).alias("_at"), F.lit(0).alias("_kind"),
        F.col("end").cast("int").alias("_reach"),
        *[F.lit(None).cast("int").alias(c) for c in ("start", "x", "y", "w", "h")],
    )
    reached = running_max(
        words.unionByName(marks),
        ["image_id"],
        F.floor(F.col("_at") / BLOCK_ROWS),
        [F.col("_at"), F.col("_kind")],
        F.col("_reach"),
        "_far",
    )
    hit = reached.filter("_kind = 1 and _far > start")
    return hit.select("image_id", "x", "y", "w", "h").distinct()


def image_boxes(words: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(image_id, status, boxes): one row per image, scanned once (IMG2).

    The words of an image stay on its row with their byte ranges; islands are
    sorted and disjoint, so two binary searches tell whether a word meets one.
    """
    word = F.struct("word_ix", F.concat("sep", "text").alias("p"), "start", "end", "x", "y", "w", "h")
    texts = (
        word_ranges(words)
        .groupBy("image_id")
        .agg(F.sort_array(F.collect_list(word)).alias("words"))
        .withColumn("text", F.array_join(F.transform("words", lambda r: r["p"]), ""))
    )
    sc = compile_scanner(words.sparkSession, cfg)

    def covered(islands: Column) -> Column:
        starts, ends = F.transform(islands, lambda s: s["start"]), F.transform(islands, lambda s: s["end"])
        hit = let(
            F.struct(starts.alias("starts"), ends.alias("ends")),
            lambda c: F.filter(
                "words",
                lambda r: (r["start"] < r["end"])
                & (count_lt(c["starts"], r["end"]) > count_le(c["ends"], r["start"])),
            ),
        )
        return F.array_distinct(F.transform(hit, lambda r: F.struct(r["x"], r["y"], r["w"], r["h"])))

    scanned = settled(
        add_redaction(add_scan(texts, sc), sc),
        ["image_id", "words"],
        {"n": F.size("findings"), "islands": F.col("islands")},
    )
    boxed = scanned.select("image_id", "n", covered(F.col("islands")).alias("boxes"))
    status = (
        F.when(F.col("n") == 0, "no_secrets").when(F.size("boxes") == 0, "unmappable").otherwise("boxes")
    )
    return boxed.select("image_id", status.alias("status"), "boxes")


def redaction_boxes(words: DataFrame, cfg: ScanConfig) -> tuple[DataFrame, DataFrame]:
    """(image_id, status) and the distinct boxes, as two views of ``image_boxes`` (IMG2)."""
    out = image_boxes(words, cfg)
    boxes = out.select("image_id", F.explode("boxes").alias("b"))
    return out.select("image_id", "status"), boxes.select("image_id", "b.x", "b.y", "b.w", "b.h")


def clip_boxes(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Boxes inside the image; empty ones are dropped (IMG3)."""
    clipped = boxes.select(
        "image_id",
        F.least(F.col("x"), F.col(width)).alias("x0"),
        F.least(F.col("y"), F.col(height)).alias("y0"),
        F.least(F.col("x") + F.col("w"), F.col(width)).alias("x1"),
        F.least(F.col("y") + F.col("h"), F.col(height)).alias("y1"),
    )
    return clipped.filter("x0 < x1 and y0 < y1")
