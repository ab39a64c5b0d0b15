"""High-entropy tokens and where they occur (DET7, part of RED1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.build import lit
from veilspan.functions.arrays import count_le, empty_array, let
from veilspan.functions.spans import locate_literal
from veilspan.functions.text import shannon_entropy

ENTROPY_NAME = "High Entropy"
PLACE = "struct<start:int,end:int,value:string>"
TOKEN_CLASS = "[0-9A-Za-z_.\\-[\\x80-\\x{10FFFF}&&[\\p{IsAlphabetic}\\p{N}]]]"


def min_chars(min_len: int, threshold: float) -> int:
    """Fewest characters a token can have.

    A character is at most four bytes, and entropy t needs at least 2^t
    distinct characters.
    """
    return max(1, math.ceil(min_len / 4), math.ceil(2**threshold - 1e-6))


def run_regex(min_len: int, threshold: float) -> str:
    """Maximal runs of token characters long enough to hold a token."""
    return f"{TOKEN_CLASS}{{{min_chars(min_len, threshold)},}}"


def tokens_of(runs: Column, min_len: int, max_len: int, threshold: float) -> Column:
    """array<struct<start,end,value,score>> of runs that clear the bar."""
    sized = F.filter(
        runs, lambda r: F.octet_length(r["value"]).between(min_len, max_len)
    )
    scored = F.transform(
        sized,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["value"].alias("value"),
            shannon_entropy(r["value"]).alias("score"),
        ),
    )
    return F.filter(scored, lambda r: r["score"] >= threshold)


def occurrences(runs: Column, tokens: Column) -> Column:
    """array<struct<start,end,value>>: every literal occurrence of each distinct token, in text order.

    A token is made of token characters, so each occurrence lies inside one
    maximal run; only the runs are searched, not the text.  Runs that equal a
    token are looked up by binary search.  Only a token whose first or last
    bytes were seen elsewhere in a longer run is searched for inside runs.
    """

    def searched(held: Column) -> Column:
        def of_run(run: Column) -> Column:
            mine = F.filter(
                held,
                lambda t: (F.octet_length(t) < F.octet_length(run["value"]))
                & F.contains(run["value"], t),
            )
            return F.flatten(F.transform(mine, lambda t: _inside(run, t)))

        return F.when(F.size(held) == 0, empty_array(PLACE)).otherwise(
            F.flatten(F.transform(runs, of_run)).cast(f"array<{PLACE}>")
        )

    def all_inside(distinct: Column) -> Column:
        def same(r: Column) -> Column:
            return F.get(distinct, count_le(distinct, r["value"]) - lit(1)) == r["value"]

        equal = F.transform(
            F.filter(runs, same),
            lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["value"].alias("value")),
        )
        return F.concat(equal.cast(f"array<{PLACE}>"), let(_contained(runs, distinct), searched))

    return F.when(F.size(tokens) == 0, empty_array(PLACE)).otherwise(
        F.array_sort(let(F.array_sort(F.array_distinct(tokens)), all_inside))
    )


def _inside(run: Column, token: Column) -> Column:
    return F.transform(
        locate_literal(run["value"], token),
        lambda s: F.struct(
            (run["start"] + s["start"]).alias("start"),
            (run["start"] + s["end"]).alias("end"),
            token.alias("value"),
        ),
    )


def _contained(runs: Column, distinct: Column) -> Column:
    """The tokens that may lie inside a longer run; none that does is left out.

    With k the bytes of the shortest token: a token that starts later than its
    run has its first k bytes there at a later place, and one that starts with
    its run has its last k bytes there before the end.  Hashes of all places
    are intersected with those of the tokens, so no pair is compared.
    """

    def grams(longer: Column, k: Column, skip: int) -> Column:
        def of_run(r: Column) -> Column:
            return let(
                r["value"].cast("binary"),
                lambda raw: F.transform(
                    F.sequence(lit(1 + skip), F.octet_length(raw) - k + lit(skip)),
                    lambda i: F.xxhash64(F.substring(raw, i, k)),
                ),
            )

        return F.flatten(F.transform(longer, of_run))

    def head(t: Column, k: Column) -> Column:
        return F.xxhash64(F.substring(t.cast("binary"), lit(1), k))

    def tail(t: Column, k: Column) -> Column:
        return F.xxhash64(F.substring(t.cast("binary"), F.octet_length(t) - k + lit(1), k))

    def of_longer(k: Column, longer: Column) -> Column:
        heads = F.array_intersect(F.transform(distinct, lambda t: head(t, k)), grams(longer, k, 1))
        tails = F.array_intersect(F.transform(distinct, lambda t: tail(t, k)), grams(longer, k, 0))
        return let(
            F.struct(heads.alias("heads"), tails.alias("tails")),
            lambda c: F.when(
                (F.size(c["heads"]) == 0) & (F.size(c["tails"]) == 0), empty_array("string")
            ).otherwise(
                F.filter(
                    distinct,
                    lambda t: F.array_contains(c["heads"], head(t, k))
                    | F.array_contains(c["tails"], tail(t, k)),
                )
            ),
        )

    def with_length(k: Column) -> Column:
        longer = F.filter(runs, lambda r: F.octet_length(r["value"]) > k)
        return let(
            longer,
            lambda x: F.when(F.size(x) == 0, empty_array("string")).otherwise(of_longer(k, x)),
        )

    return let(F.array_min(F.transform(distinct, lambda t: F.octet_length(t))), with_length)


def entropy_tokens(docs: DataFrame, min_len: int, max_len: int, threshold: float) -> DataFrame:
    """One row per token, duplicates kept (DET7)."""
    runs = F.regexp_extract_all(F.col("text"), lit(run_regex(min_len, threshold)), lit(0))
    words = docs.select("doc_id", F.explode_outer(runs).alias("value")).filter(
        F.octet_length("value").between(min_len, max_len)
    )
    return words.select("doc_id", "value", shannon_entropy(F.col("value")).alias("score")).filter(
        F.col("score") >= threshold
    )
