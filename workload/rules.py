"""User rules: files of them, their size and ambiguity, and scans that run them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan import ScanConfig
from veilspan.operators import patterns, reports, select
from veilspan.plans import scan as scan_plan
from veilspan.sources import rules
from workload import base
from workload.base import PLANTED_SQL, hits_sql, planted, quote, register, rule_rows, shared_folder, span_sql, table

# rules made of supplier keys: two kinds that are good, three that are not
_KINDS = {
    0: "concat('\\\\bu', s_suppkey, '@corp')",
    1: "concat('(?i)LOGIN: user(?P<secret>', s_suppkey, ') password')",
    2: "concat('(a|aa)+', s_suppkey)",
    3: "''",
    4: "concat('x*x*x*', s_suppkey)",
}


def _made(spark, sf):
    arms = " ".join(f"WHEN {k} THEN {text}" for k, text in _KINDS.items())
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("rule "), "s_suppkey").alias("name"),
        F.lit("Team").alias("category"),
        F.lit("high").alias("severity"),
        F.expr(f"CASE s_suppkey % {len(_KINDS)} {arms} END").alias("regex"),
        F.col("s_suppkey").alias("pos"),
    )


_FOUND_SQL = (
    f"WITH {PLANTED_SQL}, hits AS ("
    f"SELECT regexp_extract(value, '[0-9]+') AS k, 0 AS kind FROM ({span_sql(chr(92) + 'bu[0-9]+@corp')}) "
    f"UNION ALL SELECT value AS k, 1 AS kind FROM ({span_sql('(?i)LOGIN: user(?P<secret>[0-9]+) password')})), "
    "counts AS (SELECT k, kind, count(*) AS n FROM hits GROUP BY ALL) "
)


@register(
    "src4_custom_file",
    _FOUND_SQL
    + "SELECT concat('rule ', s_suppkey) AS name, CASE WHEN s_suppkey % 5 < 2 THEN coalesce(n, 0) END AS n, "
    "CASE WHEN s_suppkey % 5 >= 2 THEN 2 ELSE 0 END AS errors "
    "FROM supplier LEFT JOIN counts ON k = cast(s_suppkey AS VARCHAR) AND kind = s_suppkey % 5 "
    "UNION ALL SELECT 'missing', 0, 0 UNION ALL SELECT 'unparsable', 0, 1",
)
def src4(spark, sf):
    """A file of user rules, loaded twice in one session and run over the documents; a missing file and a broken one."""
    path = shared_folder(spark, "rules")
    rules.save_custom_patterns(_made(spark, sf), f"{path}/good")
    _, errors = rules.load_custom_patterns(spark, f"{path}/good")
    good, again = rules.load_custom_patterns(spark, f"{path}/good")
    merged = select.merge_rules(rules.load_catalog(spark), good)
    added = merged.filter(F.col("bucket") == rules.CUSTOM_BUCKET)
    found = patterns.match_patterns(planted(spark, sf), added).groupBy("name").agg(F.count("*").alias("n"))
    rejected = errors.unionByName(again).groupBy("name").agg(F.count("*").cast("int").alias("errors"))
    broken = _made(spark, sf).select(F.to_json(F.struct("name", "regex")).alias("value"))
    broken.unionByName(spark.createDataFrame([('{"name": ',)], "value string")).write.text(f"{path}/broken")
    others = []
    for name in ("missing", "unparsable"):
        got, said = rules.load_custom_patterns(spark, f"{path}/{'broken' if name == 'unparsable' else name}")
        n = got.agg(F.count("*").alias("n"))
        others.append(n.crossJoin(said.agg(F.count("*").cast("int").alias("errors"))).withColumn("name", F.lit(name)))
    ours = good.select("name").join(found, "name", "left").select(
        "name", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).alias("errors")
    )
    gone = rejected.select("name", F.lit(None).cast("bigint").alias("n"), "errors")
    return ours.unionByName(gone).unionByName(others[0]).unionByName(others[1])


@register(
    "udf1_scan_with_loaded_rules",
    _FOUND_SQL
    + "SELECT concat('rule ', s_suppkey) AS name, cast(n AS BIGINT) AS n "
    "FROM supplier JOIN counts ON k = cast(s_suppkey AS VARCHAR) AND kind = s_suppkey % 5",
)
def udf1(spark, sf):
    """A whole scan, with validators, allow-list and soft wraps, in which loaded rules join the built-in ones."""
    path = shared_folder(spark, "rules")
    rules.save_custom_patterns(_made(spark, sf), path)
    good, _ = rules.load_custom_patterns(spark, path)
    few = base.some_rules(spark, base.named("AWS Access Key ID"))
    found = scan_plan.scan(planted(spark, sf), ScanConfig(), catalog=few, custom=good)
    return found.filter("category = 'Team'").groupBy("name").agg(F.count("*").alias("n"))


# patterns around a key, and what is said of them
_JUDGED = [
    ("concat('key', s_suppkey, '[0-9]{4}')", None),
    ("concat('(a|aa)+', s_suppkey)", "pattern can read one text in exponentially many ways"),
    ("concat('(?:[a-z]+\\\\d?)+', s_suppkey)", "pattern can read one text in exponentially many ways"),
    ("concat('x*x*x*y', s_suppkey)", "the time of the pattern grows with about the power 4 of a text''s length"),
    ("concat('\\\\s*[:=]?\\\\s*', s_suppkey)", None),
    ("concat('[a-z]{1,65000}', s_suppkey)", "pattern has over 10000 states"),
    ("concat('z{70000}', s_suppkey)", "repetition count too large"),
    ("concat('(b)\\\\1k', s_suppkey)", "references to groups are not supported"),
    ("repeat('ab', 1001)", "pattern has over 2000 bytes"),
    ("concat('(open', s_suppkey)", "does not compile"),
    ("''", "pattern is empty"),
    ("concat('(', s_suppkey, ')?')", "pattern matches the empty string"),
]


@register(
    "sel7_rule_checks",
    f"SELECT s_suppkey, CASE s_suppkey % {len(_JUDGED)} "
    + " ".join(f"WHEN {i} THEN '{said}'" for i, (_, said) in enumerate(_JUDGED) if said)
    + " ELSE 'good' END AS verdict FROM supplier",
)
def sel7(spark, sf):
    """Size, ambiguity and compilation of a rule for each supplier, all in two jobs where all compile."""
    arms = " ".join(f"WHEN {i} THEN {text}" for i, (text, _) in enumerate(_JUDGED))
    made = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("name"),
        F.lit("Team").alias("category"),
        F.lit("low").alias("severity"),
        F.expr(f"CASE s_suppkey % {len(_JUDGED)} {arms} END").alias("regex"),
    )
    good, rejected = rules.validate_rules(made)
    reason = F.regexp_extract("error", "^rule left out, \\d+: (.*)", 1)
    said = F.when(reason.startswith(rules.NOT_COMPILED), "does not compile").otherwise(reason)
    both = rejected.select("name", said.alias("verdict")).unionByName(good.select("name", F.lit("good").alias("verdict")))
    return both.select(F.col("name").cast("bigint").alias("s_suppkey"), "verdict")


_CUBE_ARMS = " UNION ALL ".join(
    f"SELECT {quote(r[1])} AS bucket, {quote(r[4])} AS severity, {quote(r[3])} AS category, {r[6] is not None} AS validated, "
    f"(SELECT count(*) FROM planted WHERE regexp_matches(text, {quote(r[5])})) AS n"
    for r in rule_rows()
)


@register(
    "sel12_catalog_cube",
    f"WITH {PLANTED_SQL} SELECT bucket, severity, category, validated, grouping_id(bucket, severity, category, validated) AS level, "
    f"count(*) AS rules, cast(sum(n) AS BIGINT) AS docs FROM ({_CUBE_ARMS}) GROUP BY CUBE (bucket, severity, category, validated)",
)
def sel12_cube(spark, sf):
    """All subtotals over the built-in rules, with the documents that each rule is found in."""
    catalog = rules.load_catalog(spark)
    found = patterns.match_patterns(planted(spark, sf), catalog).select("doc_id", "ord").distinct()
    counts = found.groupBy("ord").agg(F.count("*").alias("n"))
    # the catalog is a table of checked size
    rows = catalog.join(counts, "ord", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return select.catalog_cube(rows, F.sum("n").alias("docs")).withColumn("level", F.col("level").cast("bigint"))


_SOME = base.named("AWS Access Key ID", "Email Address", "US Social Security Number", "Phone Number", "IPv4 Address", "Visa Card")


@register(
    "agg5_mergeable_distincts",
    f"WITH {PLANTED_SQL}, hits AS ({hits_sql([r for r in rule_rows() if r[0] in _SOME])}) "
    "SELECT category, count(*) AS findings, count(DISTINCT doc_id) AS leaky_docs, true AS within_bound FROM hits GROUP BY 1",
)
def agg5_sketches(spark, sf):
    """Sketches by day, merged; the estimate lies within three standard errors of the exact count."""
    found = patterns.match_patterns(planted(spark, sf), base.some_rules(spark, _SOME))
    daily = reports.document_sketches(found.withColumn("day", F.pmod(F.xxhash64("doc_id", "start"), F.lit(7))), "day", "category")
    merged = reports.merge_sketches(daily, "category").select("category", "findings", F.col("leaky_docs").alias("estimate"))
    exact = found.groupBy("category").agg(F.count_distinct("doc_id").alias("leaky_docs"))
    bound = F.ceil(3 * 1.04 / 2 ** (reports.LG_CELLS / 2) * F.col("leaky_docs"))
    return merged.join(exact, "category").select(
        "category", "findings", "leaky_docs", (F.abs(F.col("estimate") - F.col("leaky_docs")) <= bound).alias("within_bound")
    )
