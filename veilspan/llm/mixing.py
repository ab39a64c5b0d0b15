"""Mixing sources to target weights: temperature, bisected, and budgeted block permutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.llm.common import checkpointed, col

BROADCAST_ROWS = 100_000
GRID = 33
ROUNDS = 8


@dataclass(frozen=True)
class Mix:
    """``entropy``: least share of the largest possible entropy, or None.  ``max_repeats``: most passes over a source,
    or None.  ``budget``: tokens to deal out; None is the least that gives every source a full pass."""

    entropy: float | None = None
    max_repeats: float | None = None
    budget: int | None = None
    block_tokens: int = 65_536
    seed: int = 7


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table only after its rows were counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _by_exponent(sources: DataFrame, exponents: list[float]) -> list:
    """Norm, entropy and the range of repeats (per budget token share) under each exponent; one row each."""
    p = F.col("share")
    a = F.col("a")
    power = F.pow(p, a)
    return (
        sources.filter("tokens > 0")
        .select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        .groupBy("a")
        .agg(
            F.sum(power).alias("z"),
            F.sum(power * F.log(p)).alias("pl"),
            F.max(F.pow(p, a - 1)).alias("most"),
            F.min(F.pow(p, a - 1)).alias("least"),
        )
        .select(
            "a",
            "z",
            (F.log("z") - a * F.col("pl") / F.col("z")).alias("entropy"),
            (F.col("most") / F.col("z")).alias("most"),
            (F.col("least") / F.col("z")).alias("least"),
        )
        .orderBy("a")
        .collect()
    )


def find_exponent(sources: DataFrame, mix: Mix, total: float, n: int) -> float:
    """Bisect the exponent in [0, 1], ``GRID`` - 1 parts a round, each round one small aggregation.

    Entropy falls and repeats even out as the exponent grows.  The exponent is
    the largest that meets the entropy, or 0 if none does; a repetition limit
    that asks for more evenness of repeats raises it.
    """
    import math

    def search(ok, rising: bool) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = _by_exponent(sources, [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)])
            good = [ok(r) for r in rows]
            if rising:  # the smallest that is good
                i = good.index(True) if True in good else len(rows) - 1
                lo, hi = rows[max(i - 1, 0)].a, rows[i].a
            else:  # the largest that is good
                i = max((k for k, g in enumerate(good) if g), default=0)
                lo, hi = rows[i].a, rows[min(i + 1, len(rows) - 1)].a
            if lo == hi:
                break
        return round(hi if rising else lo, 9)

    if total <= 0:
        return 1.0
    found = 1.0
    if mix.entropy is not None:
        found = search(lambda r: r.entropy >= mix.entropy * math.log(max(n, 1)) - 1e-12, rising=False)
    elif mix.max_repeats is not None:
        found = 0.0
    if mix.max_repeats is not None:

        def within(r) -> bool:
            repeats = r.most / r.least if mix.budget is None else r.most * mix.budget / total
            return repeats <= mix.max_repeats * (1 + 1e-12)

        found = max(found, search(within, rising=True))
    return found


def source_weights(rows: DataFrame, mix: Mix) -> DataFrame:
    """``source, docs, tokens, share, weight, quota, repeats, n_blocks`` from ``source, n_tokens``."""
    sums = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    sums = checkpointed(sums)
    whole = sums.agg(F.sum("tokens").alias("t"), F.count_if(F.col("tokens") > 0).alias("n")).first()
    total, n = float(whole.t or 0), whole.n
    sources = sums.withColumn("share", F.col("tokens") / F.lit(total if total else 1.0))
    exponent = find_exponent(sources, mix, total, n)
    at = _by_exponent(sources, [exponent])
    z, least = (at[0].z, at[0].least) if at else (1.0, 1.0)
    budget = float(mix.budget) if mix.budget is not None else total / least
    some = F.col("tokens") > 0
    weight = F.when(some, F.pow("share", F.lit(exponent)) / z).otherwise(0.0)
    quota = F.round(weight * budget).cast("long")
    if mix.budget is None:
        quota = F.greatest(quota, F.col("tokens"))
    return checkpointed(
        sources.withColumn("weight", weight)
        .withColumn("quota", quota)
        .withColumn("repeats", F.when(some, F.col("quota") / F.col("tokens")).otherwise(1.0))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / mix.block_tokens)).cast("long"))
    )


def _order(seed: int, *by: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in by))


def _last_pass(blocks: DataFrame, mix: Mix) -> DataFrame:
    """Passes of each block: the full ones, and one more for blocks that begin within the rest of the quota.

    The running sum over a source's blocks goes in two steps (sums of up to
    4,096 groups of the permutation, then within a group), so that a source of
    any size is spread over tasks.
    """
    full = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long")
    blocks = blocks.withColumn("full", full).withColumn("u", _order(mix.seed, "source", "full", "block"))
    blocks = blocks.withColumn("g", F.shiftrightunsigned("u", 52))
    before = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        blocks.groupBy("source", "g")
        .agg(F.sum("block_tokens").alias("t"))
        .select(
            F.col("source").alias("s"),
            F.col("g").alias("gg"),
            F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"),
        )
    )
    inside = Window.partitionBy("source", "g").orderBy("u", "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("base") + F.coalesce(F.sum("block_tokens").over(inside), F.lit(0))
    rest = F.col("quota") - F.col("full") * F.col("tokens")
    return (
        blocks.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("gg")))
        .withColumn("begins", begins)
        .select(
            "source",
            "block",
            (F.col("full") + F.when((F.col("tokens") > 0) & (F.col("begins") < rest), 1).otherwise(0)).alias("passes"),
        )
    )


def mix_sources(
    docs: DataFrame,
    mix: Mix,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each copy dealt out: ``doc_id, source, n_tokens, epoch, block, place`` and the ``keep`` columns.

    Tokens are runs of non-blanks.  A source's documents lie in blocks of about
    ``block_tokens`` by a hash of the id; every pass (epoch) goes over the
    blocks in its own permutation (``place`` orders blocks, then documents),
    and the last pass stops at the block that reaches the quota, so a source is
    over its quota by less than a block.  Order the result by
    ``epoch, place, doc_id`` to stream it.

    Shares are summed before any shuffle, and only block sums are permuted: no
    text moves while source and block tables, whose rows are counted, are small
    enough to broadcast.

    A null source is a source; null texts have 0 tokens; a source without
    tokens is dealt once; repeated rows are dealt alike; null ids share a block.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    base = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        col(source_col).alias("source"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_tokens"),
        *(col(name).alias(f"_k{i}") for i, name in enumerate(keep)),
    )
    extra = [f"_k{i}" for i in range(len(keep))]
    counts = checkpointed(base.select("doc_id", "source", "n_tokens"))
    weights = source_weights(counts, mix)
    by = _small(weights.select(F.col("source").alias("s"), "n_blocks"))
    block = F.pmod(_order(mix.seed, "doc_id"), F.col("n_blocks"))

    def placed(rows: DataFrame) -> DataFrame:
        joined = rows.join(by, F.col("source").eqNullSafe(F.col("s")))
        return joined.withColumn("block", block).drop("s", "n_blocks")

    sums = placed(counts).groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    quotas = _small(weights.select(F.col("source").alias("s"), "tokens", "quota"))
    blocks = sums.join(quotas, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = checkpointed(_last_pass(blocks, mix))
    passes = _small(passes.select(F.col("source").alias("s"), F.col("block").alias("b"), "passes"))
    rows = placed(base if keep else counts)
    dealt = rows.join(passes, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    out = dealt.filter("passes > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, passes - 1)")))
    return out.withColumn("place", _order(mix.seed, "source", "epoch", "block")).select(
        "doc_id", "source", "n_tokens", "epoch", "block", "place", *(F.col(c).alias(n) for c, n in zip(extra, keep))
    )
