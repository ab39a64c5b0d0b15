"""Merging spans and writing the redacted text (RED1-RED9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from veilspan.config import ScanConfig
from veilspan.functions.arrays import let, prefix_max
from veilspan.functions.build import lit, literal_map
from veilspan.functions.spans import byte_slice
from veilspan.functions.text import name_to_tag
from veilspan.sources import fixed_values

ISLAND = "struct<start:int,end:int,name:string>"


def merge_spans(spans: Column, style: str) -> Column:
    """Overlapping spans fused into islands, sorted (RED2).

    ``spans`` are in precedence order.  Overlap always fuses and the earliest
    span's name stays.  Touching islands fuse for marker and drop, and for
    typed and placeholder when both names are equal.
    """
    by_name = style in ("typed", "placeholder")

    def islands(sorted_: Column) -> Column:
        reach = prefix_max(F.transform(sorted_, lambda s: s["end"]))

        def fuse(c: Column) -> Column:
            spans_, reach_ = c["spans"], c["reach"]
            n = F.size(spans_)

            def opens(s: Column, i: Column) -> Column:
                before = F.get(reach_, i - lit(1))
                apart = s["start"] >= before if by_name else s["start"] > before
                return F.when((i == 0) | apart, i)

            firsts = F.array_compact(F.transform(spans_, opens))

            def groups(f: Column) -> Column:
                return F.transform(
                    f,
                    lambda i, k: F.struct(
                        F.get(spans_, i)["start"].alias("start"),
                        F.get(reach_, F.coalesce(F.get(f, k + lit(1)), n) - lit(1)).alias("end"),
                        F.get(spans_, i)["name"].alias("name"),
                    ),
                )

            return let(firsts, groups)

        return let(F.struct(sorted_.alias("spans"), reach.alias("reach")), fuse)

    def join_touching(groups: Column) -> Column:
        def opens(g: Column, i: Column) -> Column:
            before = F.get(groups, i - lit(1))
            joined = (g["start"] == before["end"]) & (g["name"] == before["name"])
            return F.when((i == 0) | ~joined, i)

        firsts = F.array_compact(F.transform(groups, opens))
        return let(
            firsts,
            lambda f: F.transform(
                f,
                lambda i, k: F.struct(
                    F.get(groups, i)["start"].alias("start"),
                    F.get(
                        groups, F.coalesce(F.get(f, k + lit(1)), F.size(groups)) - lit(1)
                    )["end"].alias("end"),
                    F.get(groups, i)["name"].alias("name"),
                ),
            ),
        )

    keyed = F.transform(
        spans,
        lambda s, i: F.struct(
            s["start"].alias("start"), i.alias("seq"), s["end"].alias("end"), s["name"].alias("name")
        ),
    )
    merged = let(F.sort_array(keyed), islands)
    return let(merged, join_touching) if by_name else merged


def placeholder_map(rows: Sequence[Row]) -> Column:
    """Rule name to sample: by name, then by the category of its last rule (JN7)."""
    samples: dict[str, str] = {}
    for r in rows:
        by_category = fixed_values.SAMPLE_BY_CATEGORY.get(r["category"])
        samples.pop(r["name"], None)
        if by_category is not None:
            samples[r["name"]] = by_category
    samples.update(fixed_values.SAMPLE_BY_NAME)
    return literal_map(samples.items(), "string,string")


def replacement(name: Column, cfg: ScanConfig, rows: Sequence[Row]) -> Column:
    """What is written for one span (RED5-RED8)."""
    if cfg.style == "marker":
        return lit(cfg.marker)
    if cfg.style == "drop":
        return lit("")
    if cfg.style == "typed":
        return name_to_tag(name)
    return F.coalesce(F.try_element_at(placeholder_map(rows), name), name_to_tag(name))


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(text, lit("\\"), lit("\\\\")), lit("$"), lit("\\$"))


def emit(text: Column, islands: Column, cfg: ScanConfig, rows: Sequence[Row] = ()) -> Column:
    """The text with each island replaced, line breaks kept (RED3, RED4)."""

    def pieces(c: Column) -> Column:
        spans, raw = c["islands"], c["raw"]

        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(spans, i - lit(1))["end"], lit(0))
            inside = byte_slice(raw, s["start"], s["end"])
            repl = _quoted(replacement(s["name"], cfg, rows))
            return F.concat(
                byte_slice(raw, before, s["start"]),
                F.regexp_replace(inside, lit("[^\\r\\n]+"), repl),
            )

        last = F.coalesce(F.get(spans, F.size(spans) - lit(1))["end"], lit(0))
        return F.concat(
            F.array_join(F.transform(spans, piece), ""),
            byte_slice(raw, last, F.octet_length(raw)),
        )

    return F.when(F.size(islands) == 0, text).otherwise(
        let(F.struct(islands.alias("islands"), text.cast("binary").alias("raw")), pieces)
    )


def fail_closed(
    text: Column, redacted: Column, found: Column, had_spans: Column, cfg: ScanConfig
) -> Column:
    """Replace the whole text when something was found but nothing changed (RED9)."""
    noop = found & (redacted == text)
    if cfg.style == "placeholder":
        noop = noop & ~had_spans
    whole = {
        "marker": cfg.marker,
        "typed": "[SECRET]",
        "drop": "",
        "placeholder": fixed_values.SAMPLE_UNLOCATED,
    }[cfg.style]
    return F.when(noop, lit(whole)).otherwise(redacted)
