"""Multi-party perspective rotation: every participant once as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import col

END = "<|end|>\n"


def _plain(text: Column) -> Column:
    """Keep a turn from forging template marks."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate_perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_roles: tuple[str, ...] = ("system",),
    block_turns: int = 256,
) -> DataFrame:
    """Render each dialogue from the side of each of its participants.

    Rows out: ``conv_id, speaker, part, n_turns, text, masks``.  The speaker's
    turns are assistant turns, those of others are user turns with their name,
    and system turns stay system turns and have no perspective of their own.
    ``masks`` are half-open code point ranges of ``text`` to train on: the
    speaker's words with the end mark.

    A part holds the turns of one block of ``block_turns`` turn numbers, so a
    conversation of any length is many bounded rows.  DataFrame functions only.

    Null text is empty; a null role is the participant ``unknown``; null turns
    form a part of their own (-1); null ids are one conversation.  Rows alike in
    id, turn, role and text are one turn; other ties go by role, then text.
    Only-system conversations give no row.  ``<|`` and ``|>`` inside turns and
    names get a blank.
    """
    role = F.coalesce(col(role_col), F.lit("unknown"))
    rows = turns.select(
        col(conv_col).alias("conv_id"),
        F.coalesce(F.floor(col(turn_col) / block_turns), F.lit(-1)).cast("long").alias("part"),
        col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.coalesce(col(text_col), F.lit("")).alias("text"),
    ).distinct()
    speakers = (
        rows.filter(~F.col("role").isin(*system_roles))
        .select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker"))
        .distinct()
    )
    parts = rows.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def mine(t: Column) -> Column:
        return t["role"] == F.col("speaker")

    def head(t: Column) -> Column:
        named = F.concat(F.lit("<|user name="), _plain(t["role"]), F.lit("|>\n"))
        return (
            F.when(t["role"].isin(*system_roles), F.lit("<|system|>\n"))
            .when(mine(t), F.lit("<|assistant|>\n"))
            .otherwise(named)
        )

    def piece(t: Column) -> Column:
        h, body = head(t), _plain(t["text"])
        return F.struct(
            F.concat(h, body, F.lit(END)).alias("text"),
            F.length(h).alias("head"),
            mine(t).alias("mine"),
        )

    def add(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["text"])
        span = F.struct((acc["at"] + p["head"]).alias("start"), (end - 1).alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(p["mine"], F.concat(acc["masks"], F.array(span))).otherwise(acc["masks"]).alias("masks"),
        )

    empty = F.expr("named_struct('at', 0, 'masks', cast(array() as array<struct<start:int,end:int>>))")
    return both.withColumn("pieces", F.transform("turns", piece)).select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        F.aggregate("pieces", empty, add, lambda acc: acc["masks"]).alias("masks"),
    )
