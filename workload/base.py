"""Shared inputs and SQL pieces of the registered queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.regex import leading_flags, locating_regex
from veilspan.sources.documents import spread
from veilspan.sources.rules import load_catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register a Spark query and, when given, its SQL form."""

    def keep(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; one of this machine only where all of Spark runs on it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- documents with one planted line each, the same in Spark and SQL ------

_HASH = "md5(cast(doc_id as string))"
PLANTED_LINES = [
    "concat('key AKIA', lpad(cast(doc_id as string), 16, '0'))",
    "concat('ssn ', lpad(cast(doc_id % 900 as string), 3, '0'), '-45-', lpad(cast(doc_id % 10000 as string), 4, '0'))",
    "concat('card 4111-1111-1111-', lpad(cast(doc_id % 10000 as string), 4, '0'))",
    "concat('mail u', cast(doc_id as string), '@corp.example.com')",
    "concat('host 10.0.', cast(doc_id % 256 as string), '.', cast(doc_id % 200 as string))",
    "concat('postgres://app:pw', cast(doc_id as string), 'x@db.example.com/x')",
    "concat('csrf_token=AKIA', lpad(cast(doc_id as string), 16, '0'))",
    f"concat('token = \"ghp_', {_HASH}, 'abcdef\"')",
    f"concat('use ghp_', substring({_HASH}, 1, 20), '\n', substring({_HASH}, 21, 12), 'abcdef now')",
    f"concat('db_password=', {_HASH})",
    f"concat('api.vultr.com\nkey ', upper({_HASH}), 'WXYZ')",
    f"concat('{{\"a\":{{\"password\":\"', {_HASH}, '\"}}}}')",
    "concat('card 4111 1111 1111 1111 exp 0', cast(doc_id % 9 + 1 as string), '/27')",
    "concat('call +1 (555) 555-', lpad(cast(doc_id % 10000 as string), 4, '0'))",
    "concat('BSN: ', lpad(cast(doc_id * 7919 % 1000000000 as string), 9, '0'))",
    f"concat('-----BEGIN RSA PRIVATE KEY-----\n', {_HASH}, '\n-----END RSA PRIVATE KEY-----')",
    "concat('login: user', cast(doc_id as string), ' password: hunter', cast(doc_id as string))",
    f"concat('the secret is on the next line\n', {_HASH}, '\nend')",
]


def _planted_text(string: str, newline: str) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {line}".replace("\n", newline).replace("as string", f"as {string}")
        for i, line in enumerate(PLANTED_LINES)
    )
    return f"concat(text, {newline!r}, CASE doc_id % {len(PLANTED_LINES) + 2} {arms} ELSE 'none' END)"


def dealt(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dealt out to all cores: their files may hold fewer row groups, and a scan costs far more than a shuffle."""
    return spread(table(spark, sf, "documents"), 4 * spark.sparkContext.defaultParallelism)


def planted(spark: SparkSession, sf: str) -> DataFrame:
    docs = dealt(spark, sf)
    text = _planted_text("string", "\n").replace("'\\n'", "'\\n'")
    return docs.select("doc_id", "lang", "source", F.expr(_spark_literal(text)).alias("text"))


def _spark_literal(text: str) -> str:
    return text.replace("\n", "\\n")


def _duck_literal(text: str) -> str:
    return text.replace("'\\n'", "chr(10)").replace("\n", "' || chr(10) || '")


PLANTED_SQL = (
    "planted AS (SELECT doc_id, lang, source, "
    + _duck_literal(_planted_text("varchar", "\n"))
    + " AS text FROM documents)"
)


# ---- SQL for regex spans --------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _groups(pattern: str) -> int:
    n, i, in_class = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "(" and not in_class and (pattern[i + 1] != "?" or pattern[i + 2 : i + 4] == "P<"):
            n += 1
        i += 1
    return n


def span_sql(pattern: str, source: str = "planted", text: str = "text", key: str = "doc_id") -> str:
    """SELECT key, start, "end", value of every match of a rule pattern."""
    if "(?P<secret>" in pattern:
        flags, body = leading_flags(pattern)
        at = body.index("(?P<secret>")
        depth, i, in_class = 0, at, False
        while True:
            c = body[i]
            if c == "\\":
                i += 2
                continue
            if in_class:
                in_class = c != "]"
            elif c == "[":
                in_class = True
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        before, group, after = body[:at], body[at : i + 1], body[i + 1 :]
        rx = f"{flags}({before}){group.replace('(?P<secret>', '(', 1)}({after})"
        pre, val = 1, 2 + _groups(before)
    else:
        rx, pre, val = pattern, None, 0
    lead = f"regexp_extract_all({text}, {quote(rx)}, {pre})" if pre else "NULL"
    return (
        f'SELECT {key}, s + p AS start, s + p + strlen(v) AS "end", v AS value FROM ('
        f"SELECT {key}, unnest(list_transform(range(1, len(ms) + 1), lambda i: "
        "list_sum(list_transform(gs[1:i], lambda g: strlen(g))) + "
        "coalesce(list_sum(list_transform(ms[1:i-1], lambda m: strlen(m))), 0))) AS s, "
        + ("unnest(list_transform(ps, lambda x: strlen(x)))" if pre else "0")
        + f" AS p, unnest(vs) AS v FROM (SELECT {key}, regexp_extract_all({text}, {quote(rx)}, 0) AS ms, "
        f"{lead} AS ps, regexp_extract_all({text}, {quote(rx)}, {val}) AS vs, "
        f"string_split_regex({text}, {quote(rx)}) AS gs FROM {source}) WHERE len(ms) > 0)"
    )


def hits_sql(rules, source: str = "planted", text: str = "text") -> str:
    """UNION ALL of the spans of (ord, bucket, name, category, severity, regex, validator)."""
    return " UNION ALL ".join(
        f"SELECT doc_id, {r[0]} AS ord, {quote(r[2])} AS name, {quote(r[3])} AS category, "
        f"{quote(r[4])} AS severity, start, \"end\", value FROM ({span_sql(r[5], source, text)})"
        for r in rules
    )


def rule_rows(where: Callable[[tuple], bool] | None = None) -> list[tuple]:
    from veilspan.sources.fixed_rules import RULES

    rows = [(i, *r) for i, r in enumerate(RULES)]
    return [r for r in rows if where is None or where(r)]


def some_rules(spark: SparkSession, ords: list[int]) -> DataFrame:
    return load_catalog(spark).filter(F.col("ord").isin(ords))


def named(*names: str) -> list[int]:
    return [r[0] for r in rule_rows(lambda r: r[2] in names)]


__all__ = ["locating_regex"]
