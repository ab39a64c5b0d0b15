"""Every built-in rule and every vendor host on texts made to match it, and on near misses."""

from __future__ import annotations

import random
import re
import warnings
from re import _constants as C
from re import _parser

from pyspark.sql import functions as F

from veilspan import ScanConfig
from veilspan.functions.regex import to_java
from veilspan.operators import patterns
from veilspan.plans import scan as scan_plan
from veilspan.sources import fixed_deep, rules
from workload import detect
from workload.base import dealt, hits_sql, quote, register, rule_rows
from workload.checks import CHECK_SQL

_SAMPLES, _CHECKED = 3, 40  # texts a rule gets; those with a checksum need more, as only some pass
_CATEGORIES = {
    C.CATEGORY_DIGIT: "0123456789", C.CATEGORY_SPACE: " ", C.CATEGORY_WORD: "aZ5_",
    C.CATEGORY_NOT_DIGIT: "aZ-", C.CATEGORY_NOT_SPACE: "aZ5-", C.CATEGORY_NOT_WORD: " -",
}
_ANY = [chr(c) for c in range(33, 127)]


def _one_of(items, rng: random.Random) -> str:
    negated = items[0][0] is C.NEGATE
    chars: set[str] = set()
    for op, arg in items[negated:]:
        if op is C.LITERAL:
            chars.add(chr(arg))
        elif op is C.RANGE:
            chars.update(chr(c) for c in range(arg[0], min(arg[1], 126) + 1))
        else:
            chars.update(_CATEGORIES[arg])
    return rng.choice([c for c in _ANY if c not in chars] if negated else sorted(chars))


def _text(seq, rng: random.Random) -> str:
    """A text that the parsed pattern takes, boundaries aside."""
    out = ""
    for op, arg in seq:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.NOT_LITERAL:
            out += rng.choice([c for c in _ANY if c != chr(arg)])
        elif op is C.ANY:
            out += rng.choice(_ANY)
        elif op is C.IN:
            out += _one_of(arg, rng)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            out += "".join(_text(body, rng) for _ in range(rng.randint(low, min(int(high), low + 2))))
        elif op is C.SUBPATTERN:
            out += _text(arg[3], rng)
        elif op is C.BRANCH:
            out += _text(rng.choice(arg[1]), rng)
    return out


def samples(pattern: str, n: int, seed: int) -> list[str]:
    """``n`` texts made from a pattern, each followed by a near miss of it: a character lost, changed or doubled."""
    rng = random.Random(seed)
    java = re.sub(r"\\[pP](?:\{\w+\}|\w)", r"\\w", to_java(pattern)).replace("(?<secret>", "(?P<secret>").replace("\\z", "\\Z")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = _parser.parse(java)
    out = []
    for _ in range(n):
        text = _text(tree, rng)
        i = rng.randrange(len(text))
        near = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("x0-") + text[i + 1 :], text[:i] + text[i] + text[i:]])
        out += [text, near]
    return out


_ALL = rule_rows()
_TEXTS = [" \n ".join(samples(r[5], _CHECKED if r[6] else _SAMPLES, r[0])) for r in _ALL]


def _joined_sql(texts: list[str]) -> str:
    rows = ", ".join(f"({i}, {quote(t)})" for i, t in enumerate(texts))
    return (
        f"planted AS (SELECT doc_id, d.text || chr(10) || ' ' || s.text || ' ' AS text FROM documents d "
        f"JOIN (VALUES {rows}) AS s(k, text) ON k = doc_id % {len(texts)})"
    )


def _joined(spark, sf, texts: list[str]):
    made = spark.createDataFrame(list(enumerate(texts)), "k long, made string")
    docs = dealt(spark, sf).withColumn("k", F.col("doc_id") % len(texts))
    text = F.concat("text", F.lit("\n "), "made", F.lit(" "))
    return docs.join(F.broadcast(made), "k").select("doc_id", text.alias("text"))


@register(
    "det2_every_rule",
    f"WITH {_joined_sql(_TEXTS)}, hits AS ({hits_sql(_ALL)}) SELECT ord, doc_id, start, \"end\", md5(value) AS value FROM hits",
)
def det2_every(spark, sf):
    """All matches of all rules on texts made for each of them, and on near misses."""
    found = patterns.match_patterns(_joined(spark, sf, _TEXTS), rules.load_catalog(spark))
    return found.select("ord", "doc_id", "start", "end", F.md5("value").alias("value"))


# checks that the SQL does over one wide number hold no longer texts; their own queries compare them
_GATED = [r for r in _ALL if r[6] is None or "HUGEINT" not in CHECK_SQL[r[6]].upper()]


@register(
    "det4_every_rule",
    f"WITH {_joined_sql(_TEXTS)}, hits AS ({detect.gated_sql(_GATED)}) SELECT ord, count(*) AS n, count(DISTINCT doc_id) AS docs FROM hits GROUP BY 1",
)
def det4_every(spark, sf):
    """What the checksums leave of them."""
    catalog = rules.load_catalog(spark).filter(F.col("ord").isin([r[0] for r in _GATED]))
    found = patterns.match_patterns(_joined(spark, sf, _TEXTS), catalog, gate=True)
    return found.groupBy("ord").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


_HOST_TEXTS = [
    " \n ".join(f"{a} {s}" for a, s in zip(samples(anchor, _SAMPLES, i), samples(shape, _SAMPLES, 1000 + i)))
    for i, (_, anchor, shape) in enumerate(fixed_deep.HOST_GATED)
]


@register(
    "deep10_every_host",
    f"WITH {_joined_sql(_HOST_TEXTS)} " + " UNION ALL ".join(detect._host_sql(*h) for h in fixed_deep.HOST_GATED),
)
def deep10_every(spark, sf):
    """All vendor hosts and labels, each next to its token shape."""
    none = rules.load_catalog(spark).filter("false")
    found = scan_plan.scan(_joined(spark, sf, _HOST_TEXTS), ScanConfig(enable_deep_scan=True), catalog=none)
    names = [h[0] for h in fixed_deep.HOST_GATED]
    return found.filter(F.col("name").isin(names)).select("doc_id", "name", "start", "end")
