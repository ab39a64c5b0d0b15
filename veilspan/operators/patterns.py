"""Pattern matching on the document's own row (DET1-DET5).

One narrow pass: no rule table is joined to the documents.  A prefilter names
the rules that can match a text (DET1), in a few passes shared by all rules;
only those rules' patterns run, and the located spans stay in an array on the
row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veilspan.functions import regex as rx
from veilspan.functions.arrays import count_le, empty_array, let, prefix_sum
from veilspan.functions.build import generated, lit, literal_map, literals, reused
from veilspan.functions.spans import clean, locate_marked, mark, restored
from veilspan.functions.validators import VALIDATORS
from veilspan.plans.guards import (
    PLAIN,
    RARE_RUNS,
    RUN_CLASSES,
    WORD,
    Guard,
    first_characters,
    guard_for,
    is_rare,
    literal_counts,
    literals_in,
    longest_run,
    lowered,
    plain_gate,
    told_by,
    told_words,
    word_bound,
)
from veilspan.sources.rules import collect_rules

#: Up to so many rules are branches of the plan; the patterns of more are looked up by number.
BRANCHES = 500
#: Where at least so many rules find their matches in the told words of a text, those words are read instead of the text.
MANY_IN_WORDS = 12
LOCATED = "struct<ord:int,start:int,end:int,value:string,aux:string>"


@dataclass(frozen=True)
class CompiledRule:
    ord: int
    java: str
    replacement: str
    guard: Guard
    validator: str | None = None
    in_word: bool = False  # each match lies in one word and hangs on nothing outside it
    told: bool = False  # and that word is one of ``told_words``
    letterless: bool = False  # no match has an ASCII letter
    around: bool = False  # its guard is about the whole text


def compile_rule(
    ord_: int, pattern: str, validator: str | None = None, counts: Counter[str] | None = None
) -> CompiledRule:
    java, replacement = rx.locating_regex(pattern)
    if java == rx.FLAGS + rx.to_java(pattern) or "${post}" in replacement:
        # word boundaries and optional parts are then tried at few places only
        java = f"{rx.FLAGS}{first_characters(pattern)}{java.removeprefix(rx.FLAGS)}"
    return CompiledRule(ord_, java, replacement, guard_for(pattern, counts), validator, *word_bound(pattern))


def compile_rules(rows: Sequence[Row], guarded: bool = True, ords: Sequence[int] | None = None) -> list[CompiledRule]:
    """Compiled rules, numbered by ``ord`` or as told; many rules are kept apart by their rarest literals."""
    counts = literal_counts(r["regex"] for r in rows) if len(rows) > BRANCHES else None
    numbers = [r["ord"] for r in rows] if ords is None else ords
    rules = [compile_rule(o, r["regex"], r["validator"], counts) for o, r in zip(numbers, rows)]
    return rules if guarded else [replace(r, guard=Guard()) for r in rules]


# ---- prefilter -----------------------------------------------------------


class _Prefilter:
    """What is measured of a text, and which rules that leaves."""

    def __init__(self, rules: Sequence[CompiledRule]):
        self.rules = rules
        # a reading of the text for the sake of one rule that is told by something else as well is not worth it
        needed = {c: [r.guard for r in rules if c in r.guard.runs] for c in RUN_CLASSES}
        self.classes = [
            c for c, guards in needed.items()
            if len(guards) > 1 or guards and (c in RARE_RUNS or not guards[0].literals and len(guards[0].runs) == 1)
        ]
        self.with_literal = [r for r in rules if r.guard.literals]
        self.words = sorted({x for r in self.with_literal for x in r.guard.literals})
        self.common = sorted({x for r in self.with_literal if not is_rare(r.guard) for x in r.guard.literals})

    def found(self, text: Column, run: Callable[[str], Column]) -> Column:
        """The literals that occur; ``run`` gives the longest run of a class."""
        if not self.words:
            return empty_array("string")
        rare = lit(False)
        for c in self.classes:
            if c in RARE_RUNS:
                rare = rare | (run(c) >= RARE_RUNS[c])
        few = literals_in(lowered(text), self.common) if self.common else empty_array("string")
        return F.when(rare, literals_in(lowered(text), self.words)).otherwise(few)

    def left(self, text: Column, found: Column, have: Column | None) -> Column:
        """Ascending numbers of the rules that can match; ``have`` holds the longest run of each class."""
        by_literal: dict[str, list[int]] = {}
        for r in self.with_literal:
            for x in r.guard.literals:
                for y in told_by(x, self.words):
                    by_literal.setdefault(y, []).append(r.ord)
        named = literals([r.ord for r in self.rules if not r.guard.literals], "int")
        if by_literal:
            index = literal_map(
                [(word, tuple(sorted(set(ords)))) for word, ords in by_literal.items()],
                "string,array<int>",
            )
            told = F.flatten(F.transform(found, lambda w: F.try_element_at(index, w)))
            named = F.concat(named, told)

        top = max(r.ord for r in self.rules) + 1

        def needs(name: str) -> Column:
            size = {r.ord: r.guard.runs.get(name, 0) for r in self.rules}
            return literals([size.get(o, 0) for o in range(top)], "int")

        def long_enough(o: Column, have: Column) -> Column:
            cond = lit(True)
            for name in self.classes:
                cond = cond & (F.get(needs(name), o) <= have[name])
            return cond

        cand_all = cand = F.array_distinct(named)
        if self.classes:
            # the measured runs are bound once, outside the lambda over rules
            cand = let(have, lambda h: F.filter(cand_all, lambda o: long_enough(o, h)))
        by_signs: dict[tuple[str, ...], list[int]] = {}
        for r in self.rules:
            if r.guard.signs:
                by_signs.setdefault(r.guard.signs, []).append(r.ord)
        without = []
        for signs, ords in by_signs.items():
            held = lit(False)
            for s in signs:
                held = held | F.contains(text, lit(s))
            without.append(F.when(held, empty_array("int")).otherwise(literals(ords, "int")))
        return F.array_sort(F.array_except(cand, F.concat(*without)) if without else cand)


def plain_rules(rules: Sequence[CompiledRule]) -> list[CompiledRule] | None:
    """The rules that can match a plain text, where they are few enough to be tried one by one."""
    few = [r for r in rules if not r.guard.beyond]
    return few if 4 * len(few) <= len(rules) else None


def _left_plain(text: Column, few: Sequence[CompiledRule]) -> Column:
    """Ascending numbers of the rules that can match a plain text, without measuring it."""

    def held(r: CompiledRule, low: Column) -> Column:
        out = lit(False)
        for x in r.guard.literals:
            out = out | F.contains(low, lit(x))
        return out

    def of(rules: Sequence[CompiledRule], can_match: Callable[[CompiledRule], Column]) -> Column:
        return F.array_compact(F.array(*[F.when(can_match(r), lit(r.ord)) for r in rules]))

    def gated(rules: Sequence[CompiledRule], left: Column) -> Column:
        return F.when(text.rlike(plain_gate([r.guard for r in rules])), left).otherwise(empty_array("int"))

    named = [r for r in few if r.guard.literals]
    bare = [r for r in few if not r.guard.literals]
    parts = [empty_array("int")]
    if named:
        parts.append(gated(named, let(F.lower(text), lambda low: of(named, lambda r: held(r, low)))))
    if bare:
        parts.append(gated(bare, of(bare, lambda r: text.rlike(r.java))))
    return F.array_sort(F.concat(*parts))


@generated
def add_candidates(
    df: DataFrame, text: str, rules: Sequence[CompiledRule], out: str, words: str | None = None
) -> DataFrame:
    """Add ``out``: ascending rule numbers that can match ``text`` (DET1).

    ``words`` holds all told words of the text; runs without blanks of at least
    ``WORD`` characters are measured there, shorter ones are not asked for.
    """
    if not rules:
        return df.withColumn(out, empty_array("int"))
    if words is not None:
        rules = [replace(r, guard=_wide_runs(r.guard)) for r in rules]
    elif plain_rules(rules) is not None:
        return df.withColumn(out, candidates_of(F.col(text), rules))
    pre = _Prefilter(rules)
    found = f"_{out}_found"
    runs = {c: f"_{out}_{c}" for c in pre.classes}
    within = {c: words if words and not RUN_CLASSES[c].separators else text for c in pre.classes}
    measured = df.withColumns({runs[c]: longest_run(F.col(within[c]), c) for c in pre.classes})
    measured = measured.withColumn(found, pre.found(F.col(text), lambda c: F.col(runs[c])))
    have = F.struct(*[F.col(runs[c]).alias(c) for c in pre.classes]) if pre.classes else None
    return measured.withColumn(out, pre.left(F.col(text), F.col(found), have)).drop(*runs.values(), found)


def _wide_runs(guard: Guard) -> Guard:
    return replace(guard, runs={c: n for c, n in guard.runs.items() if RUN_CLASSES[c].separators or n >= WORD})


@generated
def candidates_of(text: Column, rules: Sequence[CompiledRule]) -> Column:
    """The same for any text, also one inside an array."""
    if not rules:
        return empty_array("int")
    pre, few = _Prefilter(rules), plain_rules(rules)

    def measured(t: Column) -> Column:
        if not pre.classes:
            return let(pre.found(t, lambda c: lit(0)), lambda f: pre.left(t, f, None))
        have = F.struct(*[longest_run(t, c).alias(c) for c in pre.classes])
        return let(have, lambda h: let(pre.found(t, lambda c: h[c]), lambda f: pre.left(t, f, h)))

    if few is None:
        return let(text, measured)
    return let(text, lambda t: F.when(t.rlike(PLAIN), _left_plain(t, few)).otherwise(measured(t)))


# ---- locating ------------------------------------------------------------


def _case(key: Column, branches: Sequence[tuple[list[int], Column]], default: Column) -> Column:
    """CASE over rule numbers, halved so that few comparisons are made."""
    if len(branches) > 8 and all(len(ords) == 1 for ords, _ in branches):
        mid = len(branches) // 2
        return F.when(key < branches[mid][0][0], _case(key, branches[:mid], default)).otherwise(
            _case(key, branches[mid:], default)
        )
    out = default
    for ords, value in reversed(branches):
        out = F.when(key.isin(ords) if len(ords) > 1 else key == ords[0], value).otherwise(out)
    return out


def checksum_ok(ord_: Column, value: Column, rules: Sequence[CompiledRule]) -> Column:
    """The rule's check accepts the value; rules without one accept all."""
    by_check: dict[str, list[int]] = {}
    for r in rules:
        if r.validator:
            by_check.setdefault(r.validator, []).append(r.ord)
    if not by_check:
        return lit(True)
    checked = _case(
        ord_, [(ords, VALIDATORS[kind](value)) for kind, ords in by_check.items()], lit(True)
    )
    gated = sorted(o for ords in by_check.values() for o in ords)
    return ~F.array_contains(literals(gated, "int"), ord_) | F.coalesce(checked, lit(False))


@generated
def locate_candidates(text: Column, cand: Column, rules: Sequence[CompiledRule]) -> Column:
    """array<struct<ord,start,end,value,aux>> of the matches of candidate rules.

    Spans are in rule order, then in text order.  At most one framed copy of
    the text is alive at a time.
    """
    if not rules:
        return empty_array(LOCATED)
    ordered = sorted(rules, key=lambda r: r.ord)

    def matches(ord_: Column, cleaned: Column) -> Column:
        if len(ordered) > BRANCHES:
            by_ord = {r.ord: r for r in ordered}
            every = [by_ord.get(o) for o in range(ordered[-1].ord + 1)]
            java = literals([r and r.java for r in every], "string")
            framing = literals([r and r.replacement for r in every], "string")
            framed = F.regexp_replace(cleaned, F.get(java, ord_), F.get(framing, ord_))
        else:
            framed = _case(
                ord_,
                [([r.ord], mark(cleaned, r.java, r.replacement)) for r in ordered],
                lit(None).cast("string"),
            )
        return F.transform(
            locate_marked(framed),
            lambda s: F.struct(
                ord_.alias("ord"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["value"].alias("value"),
                s["aux"].alias("aux"),
            ),
        )

    return F.when(F.size(cand) == 0, empty_array(LOCATED)).otherwise(
        restored(
            let(clean(text), lambda c: F.flatten(F.transform(cand, lambda o: matches(o, c)))), text
        )
    )


@generated
def matching_candidates(text: Column, cand: Column, rules: Sequence[CompiledRule]) -> Column:
    """The candidate rules that match, each read up to its first match only."""
    ordered = sorted(rules, key=lambda r: r.ord)
    if not ordered:
        return empty_array("int")

    def matches(ord_: Column, cleaned: Column) -> Column:
        if len(ordered) > BRANCHES:
            by_ord = {r.ord: r.java for r in ordered}
            java = literals([by_ord.get(o) for o in range(ordered[-1].ord + 1)], "string")
            return F.regexp_like(cleaned, F.get(java, ord_))
        return _case(ord_, [([r.ord], cleaned.rlike(r.java)) for r in ordered], lit(False))

    return F.when(F.size(cand) == 0, empty_array("int")).otherwise(
        let(clean(text), lambda c: F.filter(cand, lambda o: matches(o, c)))
    )


@generated
def gate_spans(spans: Column, rules: Sequence[CompiledRule]) -> Column:
    """Keep the spans whose value passes the check of their rule (DET4)."""
    if not any(r.validator for r in rules):
        return spans
    return F.filter(spans, lambda s: checksum_ok(s["ord"], s["value"], rules))


@reused
def located_column(text: str, cand: str, rules: tuple[CompiledRule, ...]) -> Column:
    return locate_candidates(F.col(text), F.col(cand), rules)


@reused
def gated_column(spans: str, rules: tuple[CompiledRule, ...]) -> Column:
    return gate_spans(F.col(spans), rules)


@generated
def add_pattern_spans(
    df: DataFrame,
    text: str,
    rules: Sequence[CompiledRule],
    out: str,
    gate: bool = True,
    beside: str | None = None,
    keep: str | None = None,
) -> DataFrame:
    """Add ``out``: located matches of all rules, gated by their checks.

    ``keep`` names a column for the rules that can match the text or, with
    ``beside``, the text without its soft line breaks, whose joined words that
    column holds; rules that match in one word may be left out there.
    """
    cand, every = f"_{out}_cand", f"_{out}_every"
    told = tuple(r for r in rules if r.told)
    both = F.concat(F.col(text), lit("\n\x03\n"), F.col(beside)) if beside else F.col(text)
    df = df.withColumn(every, F.when(F.col(beside) != "", both).otherwise(F.col(text)) if beside else both)
    if MANY_IN_WORDS <= len(told) and len(rules) <= BRANCHES:
        located = _add_located(df, text, every, beside, told, tuple(r for r in rules if not r.told), out, cand)
    else:
        located = add_candidates(df, every, rules, cand).withColumn(out, located_column(text, cand, tuple(rules)))
    if gate and any(r.validator for r in rules):
        located = located.withColumn(out, gated_column(out, tuple(rules)))
    if keep:
        located = located.withColumn(keep, F.col(cand))
    return located.drop(cand, every)


def _add_located(
    df: DataFrame,
    text: str,
    every: str,
    beside: str | None,
    told: tuple[CompiledRule, ...],
    others: tuple[CompiledRule, ...],
    out: str,
    cand: str,
) -> DataFrame:
    """The same in two readings: of the told words for the rules that match in them, of the whole text for the others.

    A condition that other words may meet (``signs``, words near a match) is a matter of the whole text.
    """
    words, near, runs, here = (f"_{out}_{k}" for k in ("words", "near", "runs", "here"))
    measured = (*others, *(r for r in told if r.around))
    df = df.withColumn(words, told_column(text))
    df = df.withColumn(near, F.col(words)["text"])
    df = df.withColumn(runs, F.concat_ws("\n", F.col(near), F.col(beside)) if beside else F.col(near))
    df = add_candidates(df, every, measured, cand, runs)
    df = add_candidates(df, near, [r for r in told if not r.around], here)
    columns = text, words, near, cand, here
    return df.withColumn(out, _located_both(*columns, told, others)).drop(words, near, runs, here)


@reused
def told_column(text: str) -> Column:
    """struct<text,at,shift>: the told words of a text, one a line, and how far each lies from its place there."""

    def of(spans: Column) -> Column:
        ends = prefix_sum(F.transform(spans, lambda s: s["end"] - s["start"] + lit(1)))
        starts = F.zip_with(spans, ends, lambda s, e: e - lit(1) - (s["end"] - s["start"]))
        return let(
            starts,
            lambda at: F.struct(
                F.array_join(F.transform(spans, lambda s: s["value"]), "\n").alias("text"),
                at.alias("at"),
                F.zip_with(spans, at, lambda s, a: s["start"] - a).alias("shift"),
            ),
        )

    return let(locate_marked(told_words(clean(F.col(text)))), of)


def placed(spans: Column, at: Column, shift: Column) -> Column:
    """Located spans of a text made of pieces, which begin at ``at``, as spans of the text the pieces are from."""

    def moved(s: Column) -> Column:
        return let(
            F.get(shift, count_le(at, s["start"]) - lit(1)),
            lambda d: F.struct(
                s["ord"].alias("ord"),
                (s["start"] + d).alias("start"),
                (s["end"] + d).alias("end"),
                s["value"].alias("value"),
                s["aux"].alias("aux"),
            ),
        )

    return F.transform(spans, moved)


@reused
def _located_both(
    text: str, words: str, near: str, cand: str, here: str, told: tuple[CompiledRule, ...], others: tuple[CompiledRule, ...]
) -> Column:
    whole, inside = F.col(cand), F.col(here)
    around = [r.ord for r in told if r.around]
    if around:
        ords = literals(around, "int")
        inside = F.array_sort(F.concat(inside, F.array_intersect(whole, ords)))
        whole = F.array_except(whole, ords)
    pieces = F.col(words)
    spans = let(inside, lambda o: locate_candidates(F.col(near), o, told))
    spans = restored(placed(spans, pieces["at"], pieces["shift"]), F.col(text))
    return F.array_sort(F.concat(let(whole, lambda o: locate_candidates(F.col(text), o, others)), spans))


# ---- table forms ---------------------------------------------------------


def unnest(df: DataFrame, column: str, required: str) -> DataFrame:
    """One row per struct of an array column.

    The outer form keeps the optimizer from adding a "size > 0" filter below,
    which would evaluate the whole array expression a second time.
    """
    keep = [F.col(c) for c in df.columns if c != column]
    return df.select(*keep, F.inline_outer(column)).filter(F.col(required).isNotNull())


def settled(df: DataFrame, keep: list[str], made: dict[str, Column]) -> DataFrame:
    """``keep`` and the ``made`` columns, as a finished step of the plan.

    A later filter on a made column would otherwise be pushed below, with the
    whole scan substituted into it once per reference.  A one-row generator
    keeps the step as it is; it neither shuffles nor copies rows.
    """
    row = F.struct(*[c.alias(name) for name, c in made.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))


@generated
def lookup(rows: Sequence[Row], field: str, ord_: Column) -> Column:
    """A rule's attribute by its number."""
    if not rows:
        return lit(None).cast("string")
    if len(rows) > BRANCHES and max(r["ord"] for r in rows) < 2 * len(rows) + BRANCHES:
        by_ord = {r["ord"]: r[field] for r in rows}
        return F.get(literals([by_ord.get(o) for o in range(max(by_ord) + 1)], "string"), ord_)
    table = literal_map([(r["ord"], r[field]) for r in rows], "int,string")
    return F.try_element_at(table, ord_)


def candidates(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_id, ord) pairs that can match, one narrow pass (DET1)."""
    rules = compile_rules(collect_rules(catalog))
    cand = add_candidates(docs.select("doc_id", "text"), "text", rules, "_cand")
    return cand.select("doc_id", F.explode_outer("_cand").alias("ord")).filter("ord is not null")


def matched_rules(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_id, ord): the candidate rules of each document that match, in the same narrow pass."""
    rules = compile_rules(collect_rules(catalog))
    cand = add_candidates(docs.select("doc_id", "text"), "text", rules, "_cand")
    hit = cand.select("doc_id", matching_candidates(F.col("text"), F.col("_cand"), rules).alias("_hit"))
    return hit.select("doc_id", F.explode_outer("_hit").alias("ord")).filter("ord is not null")


def match_patterns(
    docs: DataFrame, catalog: DataFrame, gate: bool = False, guarded: bool = True
) -> DataFrame:
    """One row per match of each rule (DET2, DET3; with ``gate`` also DET4).

    Without ``guarded`` every rule runs on every text: the same rows, slower.
    """
    rows = collect_rules(catalog)
    spans = add_pattern_spans(
        docs.select("doc_id", "text"), "text", compile_rules(rows, guarded), "_spans", gate
    )
    found = unnest(spans.select("doc_id", "_spans"), "_spans", "ord")
    labels = [lookup(rows, f, F.col("ord")).alias(f) for f in ("name", "category", "severity")]
    return found.select("doc_id", "ord", *labels, "start", "end", "value")


@generated
def checksum_gate(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Drop findings whose rule has a check that rejects the value (DET4)."""
    rules = compile_rules(collect_rules(catalog))
    return findings.filter(checksum_ok(F.col("ord"), F.col("value"), rules))


def dedupe(findings: DataFrame) -> DataFrame:
    """One row per (document, rule, start) (DET5)."""
    return findings.dropDuplicates(["doc_id", "ord", "start"])
