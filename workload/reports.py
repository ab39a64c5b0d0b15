"""Redaction, counts, images, streams' batch forms and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan import ScanConfig
from veilspan.functions.text import name_to_tag
from veilspan.operators import evaluate, images, patterns, redact, reports
from veilspan.plans import scan as scan_plan
from veilspan.sources import fixed_values, redaction_log, rules
from veilspan.streaming import reassembly, redaction
from workload import base
from workload.base import PLANTED_SQL, planted, quote, register, table
from workload.checks import CHECK_SQL
from workload.detect import _SOME, _SOME_ROWS, ALLOW_SQL, entropy_sql, gated_sql

# ---- redaction -----------------------------------------------------------

_CFG = ScanConfig()
_SPANS = (
    f"{PLANTED_SQL}, hits AS ({gated_sql(_SOME_ROWS)}), allow AS ({ALLOW_SQL}), spans AS (SELECT h.doc_id, h.ord, h.name, h.start, h.\"end\" FROM hits h "
    'WHERE NOT EXISTS (SELECT 1 FROM allow a WHERE a.doc_id = h.doc_id AND a.start <= h.start AND h."end" <= a."end"))'
)


def _islands(by_name: bool) -> str:
    first = ">=" if by_name else ">"
    out = (
        f"{_SPANS}, reached AS (SELECT *, max(\"end\") OVER (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), "
        f"grouped AS (SELECT *, sum(CASE WHEN reach IS NULL OR start {first} reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, ord) AS g FROM reached), "
        'isl AS (SELECT doc_id, g, min(start) AS start, max("end") AS "end", arg_min(name, start * 100000 + ord) AS name FROM grouped GROUP BY doc_id, g)'
    )
    if by_name:
        out += (
            ", chained AS (SELECT *, CASE WHEN lag(\"end\") OVER w = start AND lag(name) OVER w = name THEN 0 ELSE 1 END AS opens FROM isl WINDOW w AS (PARTITION BY doc_id ORDER BY start)), "
            "numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS k FROM chained), "
            'merged AS (SELECT doc_id, min(start) AS start, max("end") AS "end", arg_min(name, start) AS name FROM numbered GROUP BY doc_id, k)'
        )
    else:
        out += ', merged AS (SELECT doc_id, start, "end", name FROM isl)'
    return out


_TAG = "coalesce('[' || upper(nullif(trim(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '_'), '')) || ']', '[SECRET]')"
_SAMPLE = "CASE name " + " ".join(
    f"WHEN {quote(n)} THEN {quote(s)}" for n, s in fixed_values.SAMPLE_BY_NAME.items() if n in {r[2] for r in _SOME_ROWS}
) + f" ELSE {_TAG} END"
_REPLACEMENT = {"marker": "'[REDACTED]'", "drop": "''", "typed": _TAG, "placeholder": _SAMPLE}


def _bytes(text: str, a: str, b: str) -> str:
    return f"decode(encode({text})[{a} + 1 : {b}])"


def _text_sql(style: str) -> str:
    by_name = style in ("typed", "placeholder")
    return (
        f"WITH {_islands(by_name)}, cuts AS (SELECT m.*, p.text, coalesce(lag(m.\"end\") OVER w, 0) AS prev, "
        "lead(m.start) OVER w IS NULL AS is_last FROM merged m JOIN planted p USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY m.start)), "
        f"pieces AS (SELECT doc_id, start, {_bytes('text', 'prev', 'start')} || regexp_replace({_bytes('text', 'start', chr(34) + 'end' + chr(34))}, '[^\\r\\n]+', {_REPLACEMENT[style]}, 'g') "
        f"|| CASE WHEN is_last THEN {_bytes('text', chr(34) + 'end' + chr(34), 'strlen(text)')} ELSE '' END AS piece FROM cuts) "
        "SELECT p.doc_id, coalesce((SELECT string_agg(piece, '' ORDER BY start) FROM pieces x WHERE x.doc_id = p.doc_id), p.text) AS text FROM planted p"
    )


def _register_style(style: str, key: str) -> None:
    @register(key, _text_sql(style))
    def run(spark, sf):
        out = scan_plan.redact_table(planted(spark, sf), _CFG.with_(style=style), base.some_rules(spark, _SOME))
        return out.select("doc_id", "text")


for _style, _key in (
    ("marker", "red5_style_marker"),
    ("drop", "red6_style_drop"),
    ("typed", "red7_style_typed"),
    ("placeholder", "red8_style_placeholder"),
):
    _register_style(_style, _key)


@register("red1_collect_spans", f'WITH {_SPANS} SELECT doc_id, start, "end", name FROM spans')
def red1(spark, sf):
    spans = scan_plan.collect_spans(planted(spark, sf), _CFG, base.some_rules(spark, _SOME))
    return spans.select("doc_id", "start", "end", "name")


@register("red1_collect_spans_entropy")
def red1e(spark, sf):
    cfg = ScanConfig(enable_entropy=True)
    return scan_plan.collect_spans(planted(spark, sf), cfg, base.some_rules(spark, _SOME)).drop("seq")


@register("red2_merge_marker", f'WITH {_islands(False)} SELECT doc_id, start, "end", name FROM merged')
def red2m(spark, sf):
    return scan_plan.merged_spans(planted(spark, sf), _CFG, base.some_rules(spark, _SOME))


@register("red2_merge_typed", f'WITH {_islands(True)} SELECT doc_id, start, "end", name FROM merged')
def red2t(spark, sf):
    return scan_plan.merged_spans(planted(spark, sf), _CFG.with_(style="typed"), base.some_rules(spark, _SOME))


_BLOCK = base.named("Private Key Block")
_BLOCK_RX = base.rule_rows(lambda r: r[0] in _BLOCK)[0][5]


@register(
    "red4_line_preservation",
    f"WITH {PLANTED_SQL} SELECT doc_id, replace(text, '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(cast(doc_id AS VARCHAR)) || chr(10) || '-----END RSA PRIVATE KEY-----', "
    f"'[REDACTED]' || chr(10) || '[REDACTED]' || chr(10) || '[REDACTED]') AS text FROM planted WHERE regexp_matches(text, {quote(_BLOCK_RX)})",
)
def red4(spark, sf):
    out = scan_plan.redact_table(planted(spark, sf), _CFG, base.some_rules(spark, _BLOCK))
    return out.filter("n > 0").select("doc_id", "text")


@register(
    "red9_fail_closed",
    f"WITH {PLANTED_SQL} SELECT doc_id, '[REDACTED]' AS text FROM planted WHERE doc_id % 20 = 15",
)
def red9(spark, sf):
    """A private key is found by structure alone, so nothing can be located."""
    cfg = ScanConfig(enable_deep_scan=True)
    none = rules.load_catalog(spark).filter("false")
    out = scan_plan.redact_table(planted(spark, sf), cfg, none)
    return out.filter(F.array_contains("names", "Private Key")).select("doc_id", "text")


@register("red10_redact_table")
def red10(spark, sf):
    """Everything on: all rules, entropy and deep scan, typed tags."""
    cfg = ScanConfig(enable_deep_scan=True, enable_entropy=True, style="typed")
    out = scan_plan.redact_table(planted(spark, sf), cfg)
    return out.select("doc_id", "text", F.array_join("names", "|").alias("names"), "n")


@register(
    "jn7_sample_lookup",
    "SELECT category, sample, count(*) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Email Address' WHEN 1 THEN 'Bearer Token' ELSE 'Order ' || o_orderstatus END AS category FROM orders) "
    "JOIN (VALUES ('Email Address', 'user@example.com'), ('Bearer Token', 'example-auth-token-value'), ('Order O', '[ORDER_O]'), ('Order F', '[ORDER_F]'), ('Order P', '[ORDER_P]')) AS v(category, sample) USING (category) GROUP BY 1, 2",
)
def jn7(spark, sf):
    rows = rules.collect_rules(rules.load_catalog(spark))
    name = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Email Address' WHEN 1 THEN 'Bearer Token' ELSE concat('Order ', o_orderstatus) END")
    named = table(spark, sf, "orders").select(name.alias("category"))
    sample = redact.replacement(F.col("category"), _CFG.with_(style="placeholder"), rows)
    return named.groupBy("category", sample.alias("sample")).agg(F.count("*").alias("n"))


# ---- counts --------------------------------------------------------------

_HITS = f"WITH {PLANTED_SQL}, hits AS ({gated_sql(_SOME_ROWS)})"


def _found(spark, sf):
    return patterns.match_patterns(planted(spark, sf), base.some_rules(spark, _SOME), gate=True).withColumn(
        "source", F.lit("pattern")
    )


@register("agg1_finding_count", f"{_HITS} SELECT doc_id, count(*) AS n FROM hits GROUP BY 1")
def agg1(spark, sf):
    return reports.finding_count(_found(spark, sf))


@register(
    "agg2_matched_names",
    f"{_HITS} SELECT doc_id, string_agg(name, '|' ORDER BY o) AS names FROM (SELECT doc_id, name, min(ord) AS o FROM hits GROUP BY 1, 2) GROUP BY 1",
)
def agg2(spark, sf):
    return reports.matched_names(_found(spark, sf)).select("doc_id", F.array_join("names", "|").alias("names"))


@register("agg3_count_by_severity", f"{_HITS} SELECT severity, count(*) AS n FROM hits GROUP BY 1")
def agg3s(spark, sf):
    return reports.count_by(_found(spark, sf), "severity")


@register("agg3_rollup_by_category", f"{_HITS} SELECT category, name, count(*) AS n FROM hits GROUP BY ROLLUP (category, name)")
def agg3r(spark, sf):
    return reports.rollup_by_category(_found(spark, sf))


@register(
    "udf6_sql_views",
    f"{_HITS} SELECT severity, name, count(DISTINCT doc_id) AS docs FROM hits GROUP BY ALL",
)
def udf6(spark, sf):
    """Findings and rules from SQL."""
    scan_plan.register_views(spark, _found(spark, sf), base.some_rules(spark, _SOME), "udf6_")
    return spark.sql(
        "SELECT c.severity, c.name, count(DISTINCT f.doc_id) AS docs "
        "FROM udf6_findings f JOIN udf6_catalog c ON f.ord = c.ord GROUP BY ALL"
    )


_NOW = "2024-01-31 00:00:00"


@register(
    "agg4_age_buckets",
    "SELECT coalesce(sum(c) FILTER (ts <= now AND ts > now - INTERVAL 24 HOUR), 0)::BIGINT AS last_24h, "
    "coalesce(sum(c) FILTER (ts <= now AND ts > now - INTERVAL 7 DAY), 0)::BIGINT AS last_7d, "
    "coalesce(sum(c) FILTER (ts <= now AND ts > now - INTERVAL 30 DAY), 0)::BIGINT AS last_30d, "
    "coalesce(sum(c) FILTER (ts <= now AND ts > now - INTERVAL 90 DAY), 0)::BIGINT AS last_90d, "
    f"sum(c)::BIGINT AS total FROM (SELECT ts, event_id % 5 AS c, TIMESTAMP '{_NOW}' AS now FROM events)",
)
def agg4(spark, sf):
    log = table(spark, sf, "events").select("ts", F.expr("event_id % 5").alias("count"))
    return redaction_log.age_buckets(log, _NOW)


@register(
    "agg5_leak_profile",
    f"{_HITS}, totals AS (SELECT lang, count(*) AS docs FROM planted GROUP BY 1) SELECT lang, category, findings, leaky_docs, docs, round(leaky_docs / docs, 9) AS share FROM ("
    "SELECT lang, category, count(*) AS findings, count(DISTINCT doc_id) AS leaky_docs FROM hits JOIN (SELECT doc_id, lang FROM planted) USING (doc_id) GROUP BY 1, 2) JOIN totals USING (lang)",
)
def agg5(spark, sf):
    return reports.leak_profile(_found(spark, sf), planted(spark, sf), "lang").withColumn("share", F.round("share", 9))


@register("agg6_top_documents", f"{_HITS} SELECT doc_id, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 20")
def agg6(spark, sf):
    return reports.top_documents(_found(spark, sf), 20)


@register(
    "agg7_duplicate_secrets",
    f"{_HITS} SELECT sha256(value) AS value_hash, name, count(DISTINCT doc_id) AS docs, count(*) AS n FROM hits GROUP BY value, name HAVING count(DISTINCT doc_id) > 1",
)
def agg7(spark, sf):
    return reports.duplicate_secrets(_found(spark, sf))


@register(
    "labels_leak_by_quality",
    f"{_HITS} SELECT quality, toxic, count(DISTINCT l.doc_id) AS docs, count(h.doc_id) AS findings FROM labels l LEFT JOIN hits h ON h.doc_id = l.doc_id GROUP BY 1, 2",
)
def labels_leak(spark, sf):
    per_doc = reports.finding_count(_found(spark, sf))
    return (
        table(spark, sf, "labels")
        .join(per_doc, "doc_id", "left")
        .groupBy("quality", "toxic")
        .agg(F.count_distinct("doc_id").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
    )


# ---- images --------------------------------------------------------------

_WORD = "CASE WHEN event_id % 7 = 0 THEN concat('user', cast(event_id as {s}), '@mail.example.com') ELSE event_type END"
_WORDS_SQL = (
    "words AS (SELECT event_id // 10 AS image_id, cast(event_id % 10 AS INT) AS word_ix, "
    + _WORD.replace("{s}", "varchar")
    + " AS text, cast(event_id % 100 AS INT) AS x, cast(event_id % 60 AS INT) AS y, cast(user_id % 30 AS INT) AS w, cast(event_id % 9 AS INT) AS h, "
    "cast(event_id % 10 // 6 AS INT) AS block, cast(event_id % 10 // 3 AS INT) AS line FROM events), "
    "seps AS (SELECT *, CASE WHEN lag(word_ix) OVER k IS NULL THEN '' WHEN lag(block) OVER k = block AND lag(line) OVER k = line THEN ' ' ELSE chr(10) END AS sep FROM words WINDOW k AS (PARTITION BY image_id ORDER BY word_ix)), "
    "ranges AS (SELECT *, e - strlen(text) AS start, e AS \"end\" FROM (SELECT *, cast(sum(strlen(sep) + strlen(text)) OVER (PARTITION BY image_id ORDER BY word_ix) AS INT) AS e FROM seps))"
)


def _words(spark, sf):
    return table(spark, sf, "events").select(
        F.expr("event_id div 10").alias("image_id"),
        F.expr("cast(event_id % 10 as int)").alias("word_ix"),
        F.expr(_WORD.replace("{s}", "string")).alias("text"),
        F.expr("cast(event_id % 100 as int)").alias("x"),
        F.expr("cast(event_id % 60 as int)").alias("y"),
        F.expr("cast(user_id % 30 as int)").alias("w"),
        F.expr("cast(event_id % 9 as int)").alias("h"),
        F.expr("cast(event_id % 10 div 6 as int)").alias("block"),
        F.expr("cast(event_id % 10 div 3 as int)").alias("line"),
    )


@register("img1_word_ranges", f'WITH {_WORDS_SQL} SELECT image_id, word_ix, sep, start, "end" FROM ranges')
def img1r(spark, sf):
    return images.word_ranges(_words(spark, sf)).select("image_id", "word_ix", "sep", "start", "end")


@register("img1_assemble", f"WITH {_WORDS_SQL} SELECT image_id, string_agg(sep || text, '' ORDER BY word_ix) AS text FROM seps GROUP BY 1")
def img1a(spark, sf):
    return images.assemble(_words(spark, sf))


@register(
    "img2_redaction_boxes",
    f"WITH {_WORDS_SQL} SELECT DISTINCT image_id, x, y, w, h FROM words WHERE text LIKE '%@%'",
)
def img2(spark, sf):
    return images.redaction_boxes(_words(spark, sf), ScanConfig(disabled_categories=_NO_CONTACT))[1]


@register(
    "img2_image_status",
    f"WITH {_WORDS_SQL} SELECT image_id, CASE WHEN bool_or(text LIKE '%@%') THEN 'boxes' ELSE 'no_secrets' END AS status FROM words GROUP BY 1",
)
def img2s(spark, sf):
    return images.redaction_boxes(_words(spark, sf), ScanConfig(disabled_categories=_NO_CONTACT))[0]


_NO_CONTACT = tuple(b for b in fixed_values.BUCKETS if b != "pii_contact")


@register(
    "jn2_boxes_for_spans",
    f'WITH {_WORDS_SQL}, spans AS (SELECT image_id, unnest([3, 20]) AS a, unnest([12, 31]) AS b FROM (SELECT DISTINCT image_id FROM words)) '
    'SELECT DISTINCT r.image_id, x, y, w, h FROM ranges r JOIN spans s ON s.image_id = r.image_id AND r.start < s.b AND s.a < r."end"',
)
def jn2(spark, sf):
    words = _words(spark, sf)
    spans = words.filter("word_ix = 0").select(
        "image_id", F.inline(F.expr("array(named_struct('start', 3, 'end', 12), named_struct('start', 20, 'end', 31))"))
    )
    return images.boxes_for_spans(images.word_ranges(words), spans)


@register(
    "img3_clip_boxes",
    f"WITH {_WORDS_SQL} SELECT * FROM (SELECT image_id, least(x, 50) AS x0, least(y, 40) AS y0, least(x + w, 50) AS x1, least(y + h, 40) AS y1 FROM words) WHERE x0 < x1 AND y0 < y1",
)
def img3(spark, sf):
    return images.clip_boxes(_words(spark, sf).withColumns({"width": F.lit(50), "height": F.lit(40)}))


# ---- batch forms of the streams ------------------------------------------

_CHUNK = (
    "CASE WHEN turn % 2 = 0 THEN concat(CASE WHEN turn > 0 THEN '1~' ELSE '' END, 'out ', {esc}, '[200~', text) "
    "ELSE concat(text, {esc}, '[20') END"
)


@register(
    "str2_reassemble",
    "SELECT session, payload_no, strlen(payload) AS n_bytes, strlen(payload) > 300 AS overflowed, CASE WHEN strlen(payload) <= 300 THEN payload END AS payload FROM ("
    "SELECT session, unnest(range(1, len(ps) + 1)) AS payload_no, unnest(ps) AS payload FROM (SELECT session, regexp_extract_all(s, '(?s)' || chr(27) || '\\[200~(.*?)' || chr(27) || '\\[201~', 1) AS ps FROM ("
    f"SELECT conv_id AS session, string_agg({_CHUNK.replace('{esc}', 'chr(27)')}, '' ORDER BY turn) AS s FROM conversations GROUP BY 1)))",
)
def str2(spark, sf):
    """Markers cut in two by the chunk bounds, with a small limit so that STR3 shows."""
    chunks = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.expr(_CHUNK.replace("{esc}", "char(27)")).alias("chunk")
    )
    return reassembly.reassemble(chunks, limit=300)


@register(
    "str3_pass_through",
    f"SELECT conv_id AS session, md5(string_agg({_CHUNK.replace('{esc}', 'chr(27)')}, '' ORDER BY turn)) AS bytes, "
    f"cast(sum(strlen({_CHUNK.replace('{esc}', 'chr(27)')})) AS BIGINT) AS n_bytes FROM conversations GROUP BY 1",
)
def str3(spark, sf):
    """Nothing is lost: with a redactor that changes nothing, every session comes out byte for byte."""
    chunks = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.expr(_CHUNK.replace("{esc}", "char(27)")).alias("chunk")
    )
    parts = reassembly.redact_payloads(chunks, lambda text: text, limit=300)
    ordered = F.sort_array(F.collect_list(F.struct("segment", "seq", "text")))
    whole = F.array_join(F.transform(ordered, lambda p: p["text"]), "")
    return parts.groupBy("session").agg(
        F.md5(whole).alias("bytes"), F.sum(F.octet_length("text")).alias("n_bytes")
    )


@register(
    "udf5_payload_redactor",
    "SELECT session, payload_no, length(payload) AS n_chars, md5(replace(payload, 'e', '*')) AS redacted FROM ("
    "SELECT session, unnest(range(1, len(ps) + 1)) AS payload_no, unnest(ps) AS payload FROM (SELECT session, regexp_extract_all(s, '(?s)' || chr(27) || '\\[200~(.*?)' || chr(27) || '\\[201~', 1) AS ps FROM ("
    f"SELECT conv_id AS session, string_agg({_CHUNK.replace('{esc}', 'chr(27)')}, '' ORDER BY turn) AS s FROM conversations GROUP BY 1))) "
    "WHERE payload <> ''",
)
def udf5(spark, sf):
    """A redactor of the caller's own on every payload."""
    chunks = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.expr(_CHUNK.replace("{esc}", "char(27)")).alias("chunk")
    )
    return reassembly.redact_payloads(chunks, lambda text: F.replace(text, F.lit("e"), F.lit("*"))).filter("kind = 'payload'").select(
        "session",
        F.expr("(segment + 1) div 2").alias("payload_no"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.md5("text").alias("redacted"),
    )


@register(
    "str4_redaction_counts",
    "SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, cast(sum(c) AS BIGINT) AS count FROM ("
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS window_start, event_id % 5 AS c FROM events, range(0, 4) AS r(k)) GROUP BY 1",
)
def str4(spark, sf):
    log = table(spark, sf, "events").select("ts", F.expr("event_id % 5").alias("count"))
    counts = redaction.redaction_counts(log, "24 hours", "6 hours")
    return counts.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "count",
    )


@register(
    "str1_redact_messages",
    # turns hold no address, card, key or phone number of these rules
    "SELECT conv_id, turn, regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[EMAIL_ADDRESS]', 'g') AS text FROM conversations",
)
def str1(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("doc_id", F.struct("conv_id", "turn"))
    out = redaction.redact_stream(turns, ScanConfig(style="typed"), base.some_rules(spark, base.named("Email Address")))
    return out.select("doc_id.conv_id", "doc_id.turn", "text")


# ---- evaluation ----------------------------------------------------------

_EXPECTED = {0: "AWS Access Key ID", 2: "Visa Card", 3: "Email Address", 4: "IPv4 Address", 6: "AWS Access Key ID"}


def _sections(spark, sf):
    docs = planted(spark, sf)
    k = F.col("doc_id") % (len(base.PLANTED_LINES) + 2)
    want = F.array().cast("array<string>")
    for i, name in _EXPECTED.items():
        want = F.when(k == i, F.array(F.lit(name))).otherwise(want)
    return docs.select("doc_id", F.col("doc_id").alias("section"), want.alias("expected"), F.col("text").alias("body"))


@register(
    "eval1_recall",
    f"WITH {PLANTED_SQL}, hits AS ({gated_sql(_SOME_ROWS)}) SELECT p.doc_id AS section, CASE p.doc_id % 20 WHEN 2 THEN 'Visa Card' ELSE 'AWS Access Key ID' END AS missed FROM planted p "
    "WHERE p.doc_id % 20 = 6 OR (p.doc_id % 20 = 2 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = p.doc_id AND h.name = 'Visa Card'))",
)
def eval1(spark, sf):
    """The allow-listed key and cards with a bad check digit are the only misses."""
    return evaluate.recall(_sections(spark, sf), ScanConfig(disabled_categories=_FEW))


_FEW = tuple(b for b in fixed_values.BUCKETS if b not in ("legacy", "pii_contact", "pii_financial"))


@register("eval2_round_trip", "SELECT doc_id, '' AS fired FROM documents WHERE doc_id < 0")
def eval2(spark, sf):
    """A redacted copy holds no finding, so no row is left."""
    cfg = ScanConfig(disabled_categories=_FEW)
    return evaluate.round_trip(planted(spark, sf), cfg).select("doc_id", F.array_join("fired", "|").alias("fired"))


_EVAL3_RULES = base.rule_rows(lambda r: r[1] == "pii_contact")


@register(
    "eval3_false_positives",
    f"SELECT doc_id, string_agg(DISTINCT name, '|' ORDER BY name) AS fired FROM ({gated_sql(_EVAL3_RULES, 'documents')}) GROUP BY 1",
)
def eval3(spark, sf):
    out = evaluate.false_positives(table(spark, sf, "documents"), ScanConfig(disabled_categories=_NO_CONTACT))
    return out.select("doc_id", F.array_join(F.array_sort("fired"), "|").alias("fired"))


@register("eval4_fixed_point", "SELECT count(*) AS changed FROM documents WHERE doc_id < 0")
def eval4(spark, sf):
    cfg = ScanConfig(style="placeholder", disabled_categories=_NO_CONTACT)
    return evaluate.fixed_point(planted(spark, sf), cfg).agg(F.count("*").alias("changed"))


_TOK = (
    f"SELECT {entropy_sql('value')} AS score FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_.\\-]+')) AS value FROM documents) WHERE strlen(value) BETWEEN 14 AND 256"
)


@register(
    "eval5_monotone",
    f"SELECT count(*) FILTER (score >= 3.0) AS at_low, count(*) FILTER (score >= 3.6) AS at_high FROM ({_TOK})",
)
def eval5(spark, sf):
    return evaluate.monotone(table(spark, sf, "documents"), 3.0, 3.6, 14, 256)


__all__ = ["CHECK_SQL", "name_to_tag"]
