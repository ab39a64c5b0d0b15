"""The whole scan and the redaction of a table (DET12, RED10).

``documents -> findings -> redacted documents`` in one narrow pass: every
intermediate result is an array on the document's own row, so neither step
shuffles, and one huge or hot group of documents is just more rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from veilspan.config import ScanConfig
from veilspan.functions.arrays import let
from veilspan.functions.build import generated, lit, literals, reused
from veilspan.functions.regex import FLAGS
from veilspan.functions.spans import clean
from veilspan.operators import allowlist, deep, entropy, redact, softwrap
from veilspan.operators.patterns import (
    CompiledRule,
    add_candidates,
    add_pattern_spans,
    compile_rule,
    compile_rules,
    gate_spans,
    located_column,
    settled,
    unnest,
)
from veilspan.operators.select import active_rules
from veilspan.plans.guards import WORD, Guard
from veilspan.schemas import FINDING
from veilspan.sources.documents import size_gate
from veilspan.sources.rules import MATCHES_EMPTY, collect_rules, compile_errors

SPAN = "struct<start:int,end:int,name:string>"
TOKENS = "struct<start:int,end:int,value:string,score:double>"
SOFT = "struct<ord:int,start:int,end:int,value:string,fresh:boolean>"
SOFT_TOKENS = "struct<start:int,end:int,value:string,score:double,fresh:boolean>"


@dataclass(frozen=True)
class Scanner:
    """A compiled configuration: the catalog rows and all patterns to locate."""

    cfg: ScanConfig
    rows: tuple[Row, ...]
    rules: tuple[CompiledRule, ...]  # numbered by position in ``rows``
    allow: tuple[CompiledRule, ...]
    deep: deep.Probes | None
    runs: CompiledRule | None  # entropy runs
    softwrap: tuple[CompiledRule, ...]

    @property
    def everything(self) -> tuple[CompiledRule, ...]:
        extra = self.deep.rules if self.deep else ()
        return (*self.rules, *self.allow, *extra, *([self.runs] if self.runs else []))


def compile_scanner(
    spark: SparkSession,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> Scanner:
    rows = tuple(collect_rules(active_rules(spark, cfg, catalog, custom)))
    rules = tuple(compile_rules(rows, ords=range(len(rows))))
    n = len(rules)
    # a user's allow-list pattern that does not compile is left out
    errors = compile_errors(spark, cfg.allowlist_regex)
    usable = tuple(p for p in cfg.allowlist_regex if errors[p] in (None, MATCHES_EMPTY))
    allow = tuple(
        compile_rule(n + i, p) for i, p in enumerate(allowlist.allow_patterns(usable))
    )
    n += len(allow)
    probes = deep.probes(n) if cfg.enable_deep_scan else None
    n += len(probes.rules) if probes else 0
    runs = None
    if cfg.enable_entropy:
        threshold, min_len, _ = cfg.entropy_limits
        pattern = FLAGS + entropy.run_regex(min_len, threshold)
        told = entropy.min_chars(min_len, threshold) >= WORD
        runs = CompiledRule(n, pattern, "\x01\x02\x02$0\x02", Guard(), in_word=True, told=told)
    soft = tuple(rule for rule, r in zip(rules, rows) if r["softwrap"])
    return Scanner(cfg, rows, rules, allow, probes, runs, soft)


def _between(loc: Column, low: int, high: int) -> Column:
    return F.filter(loc, lambda s: (s["ord"] >= low) & (s["ord"] < high))


def _empty(ddl: str) -> Column:
    return F.expr(f"cast(array() as array<{ddl}>)")


@generated
def add_scan(docs: DataFrame, sc: Scanner, text: str = "text") -> DataFrame:
    """Add the scan's columns to a table of documents.

    ``_pat`` pattern spans, ``_tok`` entropy tokens, ``_run`` entropy runs,
    ``_deep`` deep findings, ``_soft`` and ``_softent`` soft-wrap spans and
    ``_allow`` the allow-list index.
    """
    df = docs
    if sc.softwrap or sc.runs:
        df = df.withColumn("_jw", _joined_words(text)).withColumn("_jt", F.col("_jw")["text"])
    beside = "_jt" if sc.softwrap else None
    df = add_pattern_spans(df, text, sc.everything, "_loc", False, beside, "_can" if sc.softwrap else None)
    df = df.withColumns(_from_located(sc))
    if sc.deep:
        df = deep.add_deep_findings(df, text, "_loc", sc.deep, sc.cfg.wordlist, "_deep")
    df = df.drop("_loc")
    df = df.withColumns(_kept(sc))
    return _add_softwrap(df, sc, text)


@reused
def _from_located(sc: Scanner) -> dict[str, Column]:
    n, located = len(sc.rules), F.col("_loc")
    return {
        "_pat": gate_spans(_between(located, 0, n), sc.rules),
        "_allow": allowlist.allow_index(_between(located, n, n + len(sc.allow))),
        "_run": F.filter(located, lambda s: s["ord"] == sc.runs.ord)
        if sc.runs
        else _empty(TOKENS),
    }


@reused
def _kept(sc: Scanner) -> dict[str, Column]:
    threshold, min_len, max_len = sc.cfg.entropy_limits
    return {
        "_pat": allowlist.suppress(F.col("_pat"), F.col("_allow")),
        "_deep": allowlist.suppress(F.col("_deep"), F.col("_allow"))
        if sc.deep
        else _empty(deep.DEEP),
        "_tok": entropy.tokens_of(F.col("_run"), min_len, max_len, threshold)
        if sc.runs
        else _empty(TOKENS),
    }


def _add_softwrap(df: DataFrame, sc: Scanner, text: str) -> DataFrame:
    """Second pass over joined lines; texts without a soft wrap have '' there, and without a pattern for it there is none.

    Rules that match in one word read the words that hold a cut, the others the whole joined text.
    """
    second = (*sc.softwrap, *([sc.runs] if sc.runs else []))
    if not second:
        return df.withColumns({"_soft": _empty(SOFT), "_softent": _empty(SOFT_TOKENS)})
    within, across = _second_pass(sc)
    if within:
        df = add_candidates(df, "_jt", within, "_jwc")
        df = df.withColumn("_jwl", located_column("_jt", "_jwc", within))
    if across:
        df = df.withColumn("_dwc", _across_candidates(across)).withColumns(_joined(text))
        df = df.withColumn("_dwl", located_column("_dw", "_dwc", across))
    return df.withColumns(_softwrap_columns(sc, text)).drop(
        "_dw", "_dwc", "_dwl", "_cut", "_can", "_jw", "_jt", "_jwc", "_jwl"
    )


@reused
def _across_candidates(across: tuple[CompiledRule, ...]) -> Column:
    """Rules that can match the joined text over a cut; without letters only where a cut has none beside it."""

    def of(rules: list[CompiledRule]) -> Column:
        return F.array_intersect(F.col("_can"), literals([r.ord for r in rules], "int"))

    bare = F.when(F.col("_jw")["bare"], of([r for r in across if r.letterless])).otherwise(F.expr("cast(array() as array<int>)"))
    found = F.array_sort(F.concat(of([r for r in across if not r.letterless]), bare))
    return F.when(F.col("_jt") != "", found).otherwise(F.expr("cast(array() as array<int>)"))


def _second_pass(sc: Scanner) -> tuple[tuple[CompiledRule, ...], tuple[CompiledRule, ...]]:
    """The rules of the second pass that match in one word, and the others."""
    second = (*sc.softwrap, *([sc.runs] if sc.runs else []))
    return tuple(r for r in second if r.in_word), tuple(r for r in second if not r.in_word)


@reused
def _joined_words(text: str) -> Column:
    return softwrap.joined_words(F.col(text))


@reused
def _joined(text: str) -> dict[str, Column]:
    read = F.size("_dwc") > 0
    return {
        "_dw": F.when(read, softwrap.dewrap(F.col(text))).otherwise(""),
        "_cut": F.when(read, softwrap.cuts(clean(F.col(text)))),
    }


@reused
def _softwrap_columns(sc: Scanner, text: str) -> dict[str, Column]:
    n = len(sc.rules)
    within, across = _second_pass(sc)
    wrapped = lit(False)
    joined = []
    if within:
        wrapped = wrapped | (F.col("_jt") != "")
        joined.append((gate_spans(_between(F.col("_jwl"), 0, n), within), F.col("_jw")))
    if across:
        wrapped = wrapped | (F.col("_dw") != "")
        joined.append((gate_spans(_between(F.col("_dwl"), 0, n), across), F.col("_cut")))
    parts = {
        "_soft": F.when(
            wrapped,
            softwrap.softwrap_spans(joined, F.col(text), F.col("_allow"), F.col("_pat")).cast(f"array<{SOFT}>"),
        ).otherwise(_empty(SOFT)),
        "_softent": _empty(SOFT_TOKENS),
    }
    if sc.runs:
        threshold, min_len, max_len = sc.cfg.entropy_limits
        runs = F.filter(F.col("_jwl"), lambda s: s["ord"] == sc.runs.ord)
        parts["_softent"] = F.when(
            F.col("_jt") != "",
            let(
                runs,
                lambda r: softwrap.softwrap_entropy(
                    r,
                    entropy.tokens_of(r, min_len, max_len, threshold),
                    F.transform(F.col("_tok"), lambda t: t["value"]),
                    F.col("_jw"),
                    F.col(text),
                    F.col("_allow"),
                ),
            ),
        ).otherwise(_empty(SOFT_TOKENS))
    return parts


def _rule_names(rows: Sequence[Row], field: str) -> Column:
    return literals([r[field] for r in rows], "string")


@reused
def findings_column(sc: Scanner) -> Column:
    """array<FINDING> in precedence order: patterns, entropy, deep, soft wrap."""
    names, categories, severities, ords = (
        _rule_names(sc.rows, "name"),
        _rule_names(sc.rows, "category"),
        _rule_names(sc.rows, "severity"),
        literals([r["ord"] for r in sc.rows], "int"),
    )
    top = max((r["ord"] for r in sc.rows), default=-1)

    def by_rule(source: str):
        return lambda s: F.struct(
            lit(source).alias("source"),
            F.get(ords, s["ord"]).alias("ord"),
            F.get(names, s["ord"]).alias("name"),
            F.get(categories, s["ord"]).alias("category"),
            F.get(severities, s["ord"]).alias("severity"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            lit(None).cast("double").alias("score"),
        )

    def plain(source: str, ord_: int, name, start, end, value, score) -> Column:
        return F.struct(
            lit(source).alias("source"),
            lit(ord_).alias("ord"),
            name.alias("name"),
            lit(None).cast("string").alias("category"),
            lit(None).cast("string").alias("severity"),
            start.alias("start"),
            end.alias("end"),
            value.alias("value"),
            score.alias("score"),
        )

    def token(source: str, ord_: int):
        return lambda t: plain(
            source, ord_, lit("entropy"), t["start"], t["end"], t["value"], t["score"]
        )

    none_s, none_d = lit(None).cast("string"), lit(None).cast("double")
    pieces = [
        F.transform(F.col("_pat"), by_rule("pattern")),
        F.transform(F.col("_tok"), token("entropy", top + 1)),
        F.transform(
            F.col("_deep"),
            lambda d: plain("deep", top + 2, d["name"], d["start"], d["end"], none_s, none_d),
        ),
        F.transform(
            F.filter(F.col("_soft"), lambda s: s["fresh"]), by_rule("softwrap")
        ),
        F.transform(
            F.filter(F.col("_softent"), lambda s: s["fresh"]),
            token("softwrap_entropy", top + 4),
        ),
    ]
    return F.concat(*[p.cast(f"array<{FINDING}>") for p in pieces])


@reused
def spans_column(sc: Scanner) -> Column:
    """array<start,end,name> to redact, in precedence order (RED1)."""
    names = _rule_names(sc.rows, "name")
    high = lit(entropy.ENTROPY_NAME)

    def span(start: Column, end: Column, name: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), name.alias("name"))

    def named(s: Column) -> Column:
        return span(s["start"], s["end"], F.get(names, s["ord"]))

    def high_entropy(s: Column) -> Column:
        return span(s["start"], s["end"], high)

    pieces = [F.transform(F.col("_pat"), named)]
    if sc.runs:
        values = F.concat(
            F.transform(F.col("_tok"), lambda t: t["value"]),
            F.transform(F.col("_softent"), lambda t: t["value"]),
        )
        pieces.append(F.transform(entropy.occurrences(F.col("_run"), values), high_entropy))
    pieces.append(
        F.transform(
            F.filter(F.col("_deep"), lambda d: d["start"] < d["end"]),
            lambda d: span(d["start"], d["end"], d["name"]),
        )
    )
    pieces.append(F.transform(F.col("_soft"), named))
    if sc.runs:
        pieces.append(F.transform(F.col("_softent"), high_entropy))
    return allowlist.suppress(
        F.concat(*[p.cast(f"array<{SPAN}>") for p in pieces]), F.col("_allow")
    )


def scan(
    docs: DataFrame,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """The findings table of a table of documents (doc_id, text) (DET12)."""
    sc = compile_scanner(docs.sparkSession, cfg, catalog, custom)
    df = add_scan(docs.select("doc_id", "text"), sc)
    found = df.select("doc_id", findings_column(sc).alias("_f"))
    return unnest(found, "_f", "source")


def add_findings(
    docs: DataFrame,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """Documents with their findings as an array column."""
    sc = compile_scanner(docs.sparkSession, cfg, catalog, custom)
    return settled(add_scan(docs, sc), docs.columns, {"findings": findings_column(sc)})


@generated
def add_redaction(df: DataFrame, sc: Scanner, text: str = "text") -> DataFrame:
    """Add ``findings``, ``islands`` and ``redacted`` to a scanned table."""
    df = df.withColumns({"findings": findings_column(sc), "_spans": spans_column(sc)})
    df = df.withColumn("islands", _islands(sc.cfg.style))
    return df.withColumn("redacted", _written(sc, text)).drop("_spans")


@reused
def _islands(style: str) -> Column:
    return redact.merge_spans(F.col("_spans"), style)


@reused
def _written(sc: Scanner, text: str) -> Column:
    had_spans = (
        (F.size("_pat") > 0)
        | (F.size("_tok") > 0)
        | (F.size("_soft") > 0)
        | (F.size("_softent") > 0)
        | F.exists("_deep", lambda d: d["start"].isNotNull())
    )
    found = had_spans | (F.size("_deep") > 0)
    written = redact.emit(F.col(text), F.col("islands"), sc.cfg, sc.rows)
    return let(written, lambda w: redact.fail_closed(F.col(text), w, found, had_spans, sc.cfg))


@reused
def names_column() -> Column:
    """Distinct names, first match first: patterns, deep types, then ``entropy`` (AGG2)."""

    def of(sources: tuple[str, ...]) -> Column:
        return F.transform(
            F.filter(F.col("findings"), lambda f: f["source"].isin(*sources)),
            lambda f: f["name"],
        )

    return F.array_distinct(
        F.concat(
            of(("pattern",)),
            of(("softwrap",)),
            of(("deep",)),
            of(("entropy", "softwrap_entropy")),
        )
    )


def redact_table(
    docs: DataFrame,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, text, names, n): redacted documents, narrow from end to end (RED10)."""
    sc = compile_scanner(docs.sparkSession, cfg, catalog, custom)
    df = add_redaction(add_scan(docs.select("doc_id", "text"), sc), sc)
    made = {"text": F.col("redacted"), "names": names_column(), "n": F.size("findings")}
    return settled(df, ["doc_id"], made)


def scan_within(
    docs: DataFrame,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, quarantined): texts above ``cfg.size_limit`` bytes are not scanned but come back whole (SNK5)."""
    within, quarantined = size_gate(docs, cfg.size_limit)
    return scan(within, cfg, catalog, custom), quarantined


def redact_within(
    docs: DataFrame,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(redacted, quarantined), as ``scan_within``; no text is cut or lost."""
    within, quarantined = size_gate(docs, cfg.size_limit)
    return redact_table(within, cfg, catalog, custom), quarantined


def register_views(
    spark: SparkSession, findings: DataFrame, catalog: DataFrame, prefix: str = ""
) -> None:
    """SQL surface: temp views ``findings`` and ``catalog`` (UDF6)."""
    findings.createOrReplaceTempView(f"{prefix}findings")
    catalog.createOrReplaceTempView(f"{prefix}catalog")


def collect_spans(
    docs: DataFrame,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, seq, start, end, name): every span to redact before merging (RED1)."""
    sc = compile_scanner(docs.sparkSession, cfg, catalog, custom)
    df = add_scan(docs.select("doc_id", "text"), sc).select("doc_id", spans_column(sc).alias("_s"))
    numbered = F.transform(F.col("_s"), lambda s, i: s.withField("seq", i))
    return unnest(df.select("doc_id", numbered.alias("_s")), "_s", "seq").select(
        "doc_id", "seq", "start", "end", "name"
    )


def merged_spans(
    docs: DataFrame,
    cfg: ScanConfig,
    catalog: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, start, end, name): the islands of a style (RED2)."""
    sc = compile_scanner(docs.sparkSession, cfg, catalog, custom)
    df = add_redaction(add_scan(docs.select("doc_id", "text"), sc), sc)
    return unnest(df.select("doc_id", "islands"), "islands", "start")
