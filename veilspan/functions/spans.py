"""Where a pattern matches, as spans in byte offsets, on the document's row.

Spark's regex functions return text, not positions.  ``regexp_replace`` frames
each match with two control characters; the lengths of the framed pieces then
give the positions.  A span is half-open, in UTF-8 bytes of the original text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.build import lit
from veilspan.functions.arrays import count_le, let, prefix_sum
from veilspan.functions.regex import locating_regex

RECORD, FIELD = "\x01", "\x02"
SPAN = "struct<start:int,end:int,value:string,aux:string>"


def clean(text: Column) -> Column:
    """The text without the two framing characters, at equal byte length.

    A pattern sees U+0003 for either; ``restored`` puts the values right again.
    """
    return F.when(
        F.contains(text, lit(RECORD)) | F.contains(text, lit(FIELD)),
        F.translate(text, RECORD + FIELD, "\x03\x03"),
    ).otherwise(text)


def locate_marked(marked: Column) -> Column:
    """Spans of a framed text: array<struct<start,end,value,aux>>."""

    def with_parts(parts: Column) -> Column:
        records = F.transform(
            F.slice(parts, lit(2), F.size(parts) - lit(1)), lambda p: F.split(p, FIELD)
        )
        base = F.octet_length(F.get(parts, lit(0)))

        def length(r: Column, *fields: int) -> Column:
            total = F.octet_length(F.get(r, lit(fields[0])))
            for f in fields[1:]:
                total = total + F.octet_length(F.get(r, lit(f)))
            return total

        def with_records(recs: Column) -> Column:
            ends = prefix_sum(F.transform(recs, lambda r: length(r, 1, 2, 3)))

            def span(r: Column, end: Column) -> Column:
                stop = base + end - length(r, 3)
                return F.struct(
                    (stop - length(r, 2)).alias("start"),
                    stop.alias("end"),
                    F.get(r, lit(2)).alias("value"),
                    F.get(r, lit(0)).alias("aux"),
                )

            return F.zip_with(recs, ends, span)

        return let(records, with_records)

    return let(F.split(marked, RECORD), with_parts)


def restored(spans: Column, text: Column) -> Column:
    """Spans with their values as they are in the text, where ``clean`` had to change it."""
    framing = F.contains(text, lit(RECORD)) | F.contains(text, lit(FIELD))
    return F.when(
        framing,
        let(
            text.cast("binary"),
            lambda raw: F.transform(
                spans, lambda s: s.withField("value", byte_slice(raw, s["start"], s["end"]))
            ),
        ),
    ).otherwise(spans)


def mark(text: Column, java: str, replacement: str) -> Column:
    """Frame the matches of a Java regex in a text free of control characters."""
    return F.regexp_replace(text, lit(java), lit(replacement))


def locate(text: Column, pattern: str) -> Column:
    """All non-overlapping leftmost matches of one rule pattern."""
    java, replacement = locating_regex(pattern)
    return restored(locate_marked(mark(clean(text), java, replacement)), text)


def locate_literal(text: Column, literal: Column) -> Column:
    """All non-overlapping occurrences of a literal, left to right."""
    framed = F.concat(lit(RECORD + FIELD + FIELD), literal, lit(FIELD))
    return locate_marked(F.replace(text, literal, framed))


def line_starts(text: Column) -> Column:
    """Byte offset of each line's first byte (lines end with a newline)."""
    lengths = F.transform(F.split(text, "\n"), lambda line: F.octet_length(line) + lit(1))
    return let(
        prefix_sum(lengths),
        lambda ends: F.concat(
            F.array(lit(0)), F.slice(ends, lit(1), F.size(ends) - lit(1))
        ),
    )


def line_of(starts: Column, offset: Column) -> Column:
    """0-based number of the line that holds a byte offset."""
    return count_le(starts, offset) - lit(1)


def byte_slice(raw: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets of a BINARY column."""
    return F.substring(raw, start + lit(1), end - start).cast("string")
