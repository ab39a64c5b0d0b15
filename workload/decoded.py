"""Documents encoded whole, up to four times: three levels of decoded texts against three joined levels of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan import ScanConfig
from veilspan.operators import deep, patterns
from veilspan.plans import scan as scan_plan
from veilspan.sources import fixed_deep, rules
from workload import base, detect
from workload.base import PLANTED_SQL, planted, quote, register

_RUN = quote(fixed_deep.BASE64_RUN)
_TIMES = 4


def _level_sql(depth: int, source: str) -> str:
    """CTEs ``n{depth}``: what the strong runs of the readable texts of ``source`` decode to."""
    core = "split_part(run, '=', 1)"
    usable = f"left({core}, length({core}) - CASE WHEN length({core}) % 4 = 1 THEN 1 ELSE 0 END)"
    padded = f"{usable} || repeat('=', (4 - length({usable}) % 4) % 4)"
    return (
        f"r{depth} AS MATERIALIZED (SELECT root, parent, run, row_number() OVER () AS r FROM ("
        f"SELECT root, id AS parent, unnest(regexp_extract_all(text, {_RUN})) AS run FROM {source})), "
        f"e{depth} AS (SELECT r FROM (SELECT r, c, count(*) AS k FROM (SELECT r, unnest(string_split(run, '')) AS c FROM r{depth}) GROUP BY r, c) "
        "GROUP BY r HAVING log2(sum(k)) - sum(k * log2(k)) / sum(k) >= 4.5), "
        f"n{depth} AS MATERIALIZED (SELECT *, p / strlen(text) > 0.7 AND strlen(text) > 10 AS readable, "
        "p / strlen(text) < 0.3 AND strlen(text) BETWEEN 32 AND 4096 AS is_binary FROM ("
        f"SELECT root, parent, {depth}000000000 + r AS id, text, "
        "length(regexp_replace(text, '[^\\x21-\\x7e \\t\\n\\f\\r]', '', 'g'))::DOUBLE AS p FROM ("
        f"SELECT root, parent, r, try(decode(from_base64({padded}))) AS text FROM r{depth} JOIN e{depth} USING (r)) WHERE text IS NOT NULL))"
    )


def _heuristics_sql() -> str:
    """(doc_id, name) of every heuristic over a table ``planted``."""
    kv = " UNION ALL ".join(detect._keyed_sql(p, "", detect._KV) for p in fixed_deep.KEY_VALUE)
    parts = [f"SELECT doc_id, name FROM ({kv})"]
    for key in ("deep2_env_secrets", "deep3_connection_strings", "deep5_private_keys", "deep6_credential_composites",
                "deep7_card_with_expiry", "deep9_proximity_secrets", "deep10_vendor_host_tokens"):
        sql = base.ORACLE[key]
        body = sql.removeprefix(f"WITH {PLANTED_SQL}").lstrip(" ,")
        # further tables of the query stay its own
        parts.append(f"SELECT doc_id, name FROM ({body if body.startswith('SELECT') else 'WITH ' + body})")
    json = "regexp_extract(text, '\\{\"a\":\\{\"password\":\"([A-Za-z0-9_./+-]{8,})\"\\}\\}', 1)"
    parts.append(
        f"SELECT doc_id, 'JSON Secret' AS name FROM (SELECT doc_id, {json} AS v FROM planted) WHERE v <> '' AND {detect.entropy_sql('v')} > 3.5"
    )
    return " UNION ALL ".join(parts)


def _encoded_sql() -> str:
    text = "'blob ' || to_base64(encode({}))"
    arms, inner = "", "text"
    for k in range(_TIMES):
        inner = text.format(inner)
        arms += f" WHEN {k} THEN {inner}"
    return f"encoded AS MATERIALIZED (SELECT doc_id AS root, doc_id AS id, CASE doc_id % {_TIMES}{arms} END AS text FROM planted)"


_NODES = f"WITH {PLANTED_SQL}, {_encoded_sql()}, " + ", ".join(
    [_level_sql(1, "encoded"), *(_level_sql(d, f"(SELECT * FROM n{d - 1} WHERE readable)") for d in (2, 3, 4))]
)
_OWN = (
    "own AS MATERIALIZED (SELECT doc_id AS id, name FROM (WITH planted AS (SELECT id AS doc_id, text FROM n1 WHERE readable UNION ALL "
    "SELECT id, text FROM n2 WHERE readable UNION ALL SELECT id, text FROM n3 WHERE readable) " + _heuristics_sql() + "))"
)
# a readable text tells of itself when it has names, or something below it has
_TOLD = (
    "t3 AS (SELECT id, parent FROM n3 WHERE readable AND (id IN (SELECT id FROM own) OR id IN (SELECT parent FROM n4 WHERE is_binary))), "
    "t2 AS (SELECT id, parent FROM n2 WHERE readable AND (id IN (SELECT id FROM own) OR id IN (SELECT parent FROM n3 WHERE is_binary) OR id IN (SELECT parent FROM t3))), "
    "t1 AS (SELECT id, parent FROM n1 WHERE readable AND (id IN (SELECT id FROM own) OR id IN (SELECT parent FROM n2 WHERE is_binary) OR id IN (SELECT parent FROM t2)))"
)
_ROOTS = " UNION ALL ".join(f"SELECT id, root, is_binary FROM n{d}" for d in (1, 2, 3, 4))


def _encoded(spark, sf):
    docs = planted(spark, sf)

    def once(text):
        return F.concat(F.lit("blob "), F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit("")))

    text, made = F.col("text"), F.lit(None).cast("string")
    levels = []
    for _ in range(_TIMES):
        text = once(text)
        levels.append(text)
    for k, level in enumerate(levels):
        made = F.when(F.col("doc_id") % _TIMES == k, level).otherwise(made)
    # a finished step, as a table that is read would be: the scan refers to its text many times
    return patterns.settled(docs, ["doc_id"], {"text": made})


@register(
    "deep4_whole_documents",
    f"{_NODES}, {_OWN}, {_TOLD}, roots AS ({_ROOTS}) "
    "SELECT root AS doc_id, name, count(*) AS n FROM (SELECT root, name FROM own JOIN roots USING (id) UNION ALL "
    "SELECT root, 'Base64 (Binary/Key Material)' FROM roots WHERE is_binary UNION ALL "
    "SELECT root, 'Base64 Encoded Secret' FROM roots WHERE id IN (SELECT id FROM t1 UNION ALL SELECT id FROM t2 UNION ALL SELECT id FROM t3)) GROUP BY 1, 2",
)
def deep4_whole(spark, sf):
    """Whole documents encoded one to four times: names come up from three levels, the fourth is not read."""
    cfg = ScanConfig(enable_deep_scan=True)
    none = rules.load_catalog(spark).filter("false")
    # the documents are dealt out before they are encoded; dealing the encoded ones again would move twice their bytes
    found = scan_plan.scan(_encoded(spark, sf), cfg, catalog=none).filter("start is null")
    return found.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@register(
    "deep4_decoded_texts",
    f"{_NODES} SELECT root AS doc_id, depth, readable, is_binary, md5(text) AS text FROM ("
    + " UNION ALL ".join(f"SELECT root, {d} AS depth, readable, is_binary, text FROM n{d}" for d in (1, 2, 3))
    + ")",
)
def deep4_texts(spark, sf):
    """The decoded texts themselves, one row each."""
    return deep.decoded_table(_encoded(spark, sf)).select("doc_id", "depth", "readable", F.col("binary").alias("is_binary"), F.md5("text").alias("text"))
