"""Secrets split by one soft line break (DET8-DET10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.build import lit
from veilspan.functions.arrays import count_le, empty_array, let, prefix_sum
from veilspan.functions.spans import byte_slice, clean, locate_marked, mark, restored
from veilspan.functions.text import shannon_entropy
from veilspan.operators.allowlist import is_allowed
from veilspan.operators.entropy import occurrences
from veilspan.plans.guards import JAVA_BLANKS

WRAPPED = "struct<ord:int,start:int,end:int,value:string,fresh:boolean>"
_BODY = "[A-Za-z0-9+/=_.\\-]"
# six body characters before the break, two after it, and the next line is not
# a new "name=value" or "Header: value"; only breaks are looked at at all
WRAP = (
    f"(?=[\\r\\n])(?<={_BODY}{{6}})\\r?\\n\\r?(?={_BODY}{{2}})"
    "(?![A-Za-z0-9_-]*+[=:]=*+[ \\t]*+[^\\r\\n])"
)


def dewrap(text: Column) -> Column:
    """The text without its soft line breaks (DET8)."""
    return F.when(F.contains(text, lit("\n")), F.regexp_replace(text, WRAP, "")).otherwise(text)


def cuts(cleaned: Column) -> Column:
    """struct<at, removed>: where breaks were cut in the joined text, bytes cut so far."""

    def from_spans(spans: Column) -> Column:
        widths = F.transform(spans, lambda s: s["end"] - s["start"])
        return let(
            prefix_sum(widths),
            lambda total: F.struct(
                F.zip_with(spans, total, lambda s, t: s["end"] - t).alias("at"),
                total.alias("removed"),
            ),
        )

    return let(
        locate_marked(mark(cleaned, WRAP, "\x01\x02\x02$0\x02")), from_spans
    )


#: Joined words, with what stands before each; the last match may hold no break.
_JOINED = (
    f"(?<pre>(?:[^{JAVA_BLANKS}]*+(?!{WRAP})[{JAVA_BLANKS}]++)*+)"
    f"(?<run>[^{JAVA_BLANKS}]*+(?:{WRAP}[^{JAVA_BLANKS}]*+)++|[^{JAVA_BLANKS}]*+\\z)"
)


def joined_words(text: Column) -> Column:
    """struct<text,at,removed,bare>: the words of the joined text that hold a cut, one a line, and their places as ``cuts``.

    A match that lies in one word and holds a cut is found there as in the
    whole joined text, which is longer by far.  ``bare``: a cut has no ASCII
    letter on either side.
    """

    def pieces(word: Column) -> Column:
        lines = locate_marked(mark(word["value"], "[^\\r\\n]+", "\x01\x02\x02$0\x02"))
        return F.transform(
            lines,
            lambda s: F.struct(
                (word["start"] + s["start"]).alias("start"),
                (word["start"] + s["end"]).alias("end"),
                s["value"].alias("value"),
                F.when(s["start"] == 0, 1).otherwise(0).alias("first"),
            ),
        )

    def of(found: Column, bare: Column) -> Column:
        def width(s: Column) -> Column:
            return s["end"] - s["start"]

        def with_places(at: Column) -> Column:
            return F.struct(
                F.array_join(
                    F.transform(found, lambda s: F.when(s["first"] == 1, F.concat(lit("\n"), s["value"])).otherwise(s["value"])), ""
                ).alias("text"),
                at.alias("at"),
                F.zip_with(found, at, lambda s, a: s["start"] - a).alias("removed"),
                bare.alias("bare"),
            )

        ends = prefix_sum(F.transform(found, lambda s: s["first"] + width(s)))
        return let(F.zip_with(found, ends, lambda s, e: e - width(s)), with_places)

    marked = mark(clean(text), _JOINED, "\x01\x02${pre}\x02${run}\x02")
    words = F.filter(locate_marked(marked), lambda s: F.contains(s["value"], lit("\n")))

    def joined(w: Column) -> Column:
        bare = F.exists(w, lambda s: s["value"].rlike("[^A-Za-z\\r\\n][\\r\\n]+[^A-Za-z\\r\\n]"))
        return let(restored(F.flatten(F.transform(w, pieces)), text), lambda found: of(found, bare))

    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,aux:string>>)")
    return let(F.when(F.contains(text, lit("\n")), words).otherwise(none), joined)


def _back(cut: Column, offset: Column) -> Column:
    n = count_le(cut["at"], offset)
    return offset + F.coalesce(F.get(cut["removed"], n - lit(1)), lit(0))


def original_span(cut: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A span of the joined text as a span of the original."""
    return _back(cut, start), _back(cut, end - lit(1)) + lit(1)


def _mapped(spans: Column, cut: Column, raw: Column, allow: Column) -> Column:
    """Spans moved to the original that hold a newline and are not allow-listed."""

    def move(s: Column) -> Column:
        start, end = original_span(cut, s["start"], s["end"])
        return F.struct(
            s["ord"].alias("ord"), start.alias("start"), end.alias("end"), s["value"].alias("value")
        )

    return F.filter(
        F.transform(spans, move),
        lambda s: F.contains(byte_slice(raw, s["start"], s["end"]), lit("\n"))
        & ~is_allowed(allow, s["start"], s["end"]),
    )


def softwrap_spans(
    joined: Sequence[tuple[Column, Column]], text: Column, allow: Column, seen: Column
) -> Column:
    """array<struct<ord,start,end,value,fresh>> (DET9).

    ``joined`` are gated matches in joined texts, each with the cuts of its
    text; ``seen`` are the pattern spans of the original.  A span is fresh when
    its (rule, start) was not found before.
    """

    def key(s: Column) -> Column:
        return F.call_function("shiftleft", s["ord"].cast("long"), lit(32)) + s["start"]

    def label(spans: Column) -> Column:
        def against(known: Column) -> Column:
            def fresh(k: Column) -> Column:
                return ~F.coalesce(F.get(known, count_le(known, k) - lit(1)) == k, lit(False))

            return F.transform(spans, lambda s: s.withField("fresh", fresh(key(s))))

        return F.when(F.size(spans) == 0, empty_array(WRAPPED)).otherwise(
            let(F.array_sort(F.transform(seen, key)), against).cast(f"array<{WRAPPED}>")
        )

    def mapped(c: Column) -> Column:
        # by rule, then by place
        parts = [_mapped(spans, c[f"cut{i}"], c["raw"], c["allow"]) for i, (spans, _) in enumerate(joined)]
        return parts[0] if len(parts) == 1 else F.array_sort(F.concat(*parts))

    return let(
        F.struct(
            *[cut.alias(f"cut{i}") for i, (_, cut) in enumerate(joined)], text.cast("binary").alias("raw"), allow.alias("allow")
        ),
        lambda c: let(mapped(c), label),
    )


FOUND = "struct<start:int,end:int,value:string,score:double,fresh:boolean>"


def _in_sorted(ascending: Column, x: Column) -> Column:
    return F.coalesce(F.get(ascending, count_le(ascending, x) - lit(1)) == x, lit(False))


def softwrap_entropy(
    runs: Column, tokens: Column, before: Column, cut: Column, text: Column, allow: Column
) -> Column:
    """array<struct<start,end,value,score,fresh>> (DET10).

    ``runs`` and ``tokens`` come from the joined text, ``before`` holds the
    token values of the original.  A token counts when it was no token before
    and no newline-free fragment of the occurrence was one, also not one that
    was accepted earlier.

    Tokens and fragments are looked up in sorted arrays.  Only where a fragment
    equals one of the new tokens, so that one decision hangs on another, are
    they taken one after the other.
    """

    def places(values: Column, c: Column) -> Column:
        """Occurrences of the tokens that hold a line break in the original."""
        found = F.transform(
            occurrences(runs, values),
            lambda s: F.struct(
                lit(0).alias("ord"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")
            ),
        )
        return _mapped(found, c["cut"], c["raw"], c["allow"])

    def with_parts(found: Column, c: Column) -> Column:
        def parts(s: Column) -> Column:
            return F.filter(F.split(byte_slice(c["raw"], s["start"], s["end"]), "[\r\n]+"), lambda p: p != "")

        return F.transform(found, lambda s: s.withField("parts", parts(s)))

    def at_once(new: Column, found: Column, old: Column) -> Column:
        """Every place by its start, then by its token's turn."""

        def numbered(turns: Column) -> Column:
            values = F.transform(turns, lambda t: t["value"])

            def by_start(sorted_values: Column) -> Column:
                def turn(v: Column) -> Column:
                    return F.get(turns, count_le(sorted_values, v) - lit(1))["turn"]

                kept = F.filter(found, lambda s: ~F.exists(s["parts"], lambda p: _in_sorted(old, p)))
                return F.array_sort(
                    F.transform(
                        kept,
                        lambda s: F.struct(
                            s["start"].alias("start"), turn(s["value"]).alias("turn"), s["end"].alias("end"), s["value"].alias("value")
                        ),
                    )
                )

            return let(values, by_start)

        turns = F.array_sort(F.transform(new, lambda v, i: F.struct(v.alias("value"), i.alias("turn"))))
        return let(
            let(turns, numbered),
            lambda placed: F.transform(
                placed,
                lambda s, i: F.struct(
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    s["value"].alias("value"),
                    shannon_entropy(s["value"]).alias("score"),
                    (~F.coalesce(F.when(i > 0, F.get(placed, i - lit(1))["start"] == s["start"]), lit(False))).alias("fresh"),
                ),
            ),
        )

    def in_turn(new: Column, found: Column) -> Column:
        """One token after the other, each against those accepted before it."""

        def step(acc: Column, value: Column) -> Column:
            def kept(known: Column) -> Column:
                return F.filter(
                    found, lambda s: (s["value"] == value) & ~F.arrays_overlap(s["parts"], known)
                )

            mine = let(F.concat(before, F.transform(acc, lambda a: a["value"])), kept)
            return F.concat(
                acc,
                F.transform(
                    mine,
                    lambda s: F.struct(
                        s["start"].alias("start"),
                        s["end"].alias("end"),
                        s["value"].alias("value"),
                        shannon_entropy(value).alias("score"),
                        (~F.exists(acc, lambda a: a["start"] == s["start"])).alias("fresh"),
                    ),
                ).cast(f"array<{FOUND}>"),
            )

        split = F.array_intersect(new, F.transform(found, lambda s: s["value"]))
        return F.aggregate(split, empty_array(FOUND), step)

    def decided(new: Column, found: Column) -> Column:
        def judged(fragments: Column) -> Column:
            alone = F.size(F.array_intersect(fragments, new)) == 0
            old = F.array_sort(F.array_intersect(fragments, before))
            at_once_ = let(old, lambda o: at_once(new, found, o)).cast(f"array<{FOUND}>")
            return F.when(alone, at_once_).otherwise(in_turn(new, found))

        fragments = F.array_distinct(F.flatten(F.transform(found, lambda s: s["parts"])))
        return F.when(F.size(found) == 0, empty_array(FOUND)).otherwise(let(fragments, judged))

    def run(c: Column) -> Column:
        # one entry per distinct token, in first-seen order
        new = F.array_except(F.transform(tokens, lambda t: t["value"]), before)
        return let(new, lambda values: let(with_parts(places(values, c), c), lambda found: decided(values, found)))

    return let(
        F.struct(cut.alias("cut"), text.cast("binary").alias("raw"), allow.alias("allow")), run
    )
