"""Streams run to their end over written tables, sinks, and the log that is kept small."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from veilspan import ScanConfig
from veilspan.plans import scan as scan_plan
from veilspan.sources import documents, redaction_log
from veilspan.streaming import reassembly, redaction
from workload import base
from workload.base import PLANTED_SQL, planted, register, shared_folder, table
from workload.reports import _CHUNK

_TEXT_SQL = _CHUNK.replace("{esc}", "chr(27)")
_PAYLOADS_SQL = (
    "SELECT session, unnest(range(1, len(ps) + 1)) AS payload_no, unnest(ps) AS payload FROM (SELECT session, "
    "regexp_extract_all(s, '(?s)' || chr(27) || '\\[200~(.*?)' || chr(27) || '\\[201~', 1) AS ps FROM ("
    f"SELECT conv_id AS session, string_agg({_TEXT_SQL}, '' ORDER BY turn) AS s FROM conversations GROUP BY 1))"
)


def _chunks(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session"),
        F.col("turn").cast("bigint").alias("seq"),
        F.expr(_CHUNK.replace("{esc}", "char(27)")).alias("chunk"),
    )


def _delivered(spark, sf):
    """Chunks as an at-least-once source gives them: every third one twice."""
    once = _chunks(spark, sf)
    return once.unionByName(once.filter("(session + seq) % 3 = 0"))


@contextmanager
def _few_states(spark, n: int = 8):
    """State is kept in as many stores as there are shuffle partitions when a stream begins: ``n``, or one a core."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(n, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@register("str2_repeated_chunks", f"SELECT session, payload_no, md5(payload) AS payload FROM ({_PAYLOADS_SQL}) WHERE strlen(payload) <= 300")
def str2_repeated(spark, sf):
    """Repeats do not change the batch result."""
    found = reassembly.reassemble(_delivered(spark, sf), limit=300).filter("not overflowed")
    return found.select("session", "payload_no", F.md5("payload").alias("payload"))


@register(
    "str3_overflows",
    f"SELECT session, payload_no, strlen(payload) AS n_bytes FROM ({_PAYLOADS_SQL}) WHERE strlen(payload) > 300 UNION ALL "
    "SELECT session, n + 1, strlen(rest) FROM (SELECT session, len(regexp_extract_all(s, '(?s)' || chr(27) || '\\[200~.*?' || chr(27) || '\\[201~')) AS n, "
    "regexp_extract(regexp_replace(s, '(?s)' || chr(27) || '\\[200~.*?' || chr(27) || '\\[201~', '', 'g'), '(?s)' || chr(27) || '\\[200~(.*)', 1) AS rest "
    f"FROM (SELECT conv_id AS session, string_agg({_TEXT_SQL}, '' ORDER BY turn) AS s FROM conversations GROUP BY 1)) WHERE strlen(rest) > 300",
)
def str3_overflows(spark, sf):
    """The side table of payloads above the limit, finished or not."""
    return reassembly.overflows(_delivered(spark, sf), limit=300)


@register(
    "str3_unframed",
    f"SELECT conv_id AS session, md5(replace(replace(string_agg({_TEXT_SQL}, '' ORDER BY turn), chr(27) || '[200~', ''), chr(27) || '[201~', '')) AS bytes "
    "FROM conversations GROUP BY 1",
)
def str3_unframed(spark, sf):
    """Every session without its markers, byte for byte; no payload here holds a marker of its own."""
    parts = reassembly.redact_payloads(_chunks(spark, sf), lambda text: text, framed=False)
    ordered = F.sort_array(F.collect_list(F.struct("segment", "seq", "text")))
    return parts.groupBy("session").agg(F.md5(F.array_join(F.transform(ordered, lambda p: p["text"]), "")).alias("bytes"))


@register(
    "str2_state_stream",
    f"SELECT session, payload_no, CASE WHEN strlen(payload) > 300 THEN 'overflow' ELSE md5(replace(payload, 'e', '*')) END AS redacted "
    f"FROM ({_PAYLOADS_SQL}) WHERE payload <> ''",
)
def str2_stream(spark, sf):
    """A stream in micro-batches that begin in the middle of the sessions, with repeats, to its end."""
    path = shared_folder(spark, "chunks")
    # every delivery lies within the idle time: the watermark of a long session must not make the others' first chunks late
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(seq % 8 as int), 0)")
    sent = _delivered(spark, sf).withColumn("ts", at)
    # three deliveries: late chunks first, then the first ones, then the rest with the repeats
    part = F.when(F.col("seq") >= 3, F.lit(0)).when(F.col("seq") == 0, F.lit(1)).otherwise(F.lit(2))
    for i in range(3):
        sent.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = reassembly.redact_payload_stream(live, lambda text: text.replace("e", "*"), limit=300)
    with _few_states(spark):
        query = (
            out.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{path}-out")
    # a payload above the limit may still have been open at the end: those that were closed have an end marker behind them
    closed = reassembly.reassemble(_chunks(spark, sf), limit=300).select("session", "payload_no")
    kinds = got.filter("kind in ('payload', 'overflow')")
    shown = F.when(F.col("kind") == "overflow", "overflow").otherwise(F.md5("text"))
    return kinds.join(closed, ["session", "payload_no"], "left_semi").select("session", "payload_no", shown.alias("redacted"))


@register(
    "str1_gated_messages",
    "SELECT conv_id, turn, CASE WHEN strlen(text) > 300 THEN NULL ELSE "
    "regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[EMAIL_ADDRESS]', 'g') END AS text, "
    "strlen(text) > 300 AS too_large FROM conversations",
)
def str1_gated(spark, sf):
    """Messages above the size limit are withheld and marked."""
    turns = table(spark, sf, "conversations").withColumn("doc_id", F.struct("conv_id", "turn"))
    few = base.some_rules(spark, base.named("Email Address"))
    out = redaction.redact_stream(turns, ScanConfig(style="typed", size_limit=300), few)
    return out.select("doc_id.conv_id", "doc_id.turn", "text", "too_large")


_EPOCHS = 4


@register(
    "str5_exactly_once",
    f"SELECT event_id % {_EPOCHS} AS epoch, cast(sum(event_id % 5) AS BIGINT) AS count FROM events GROUP BY 1 HAVING sum(event_id % 5) > 0",
)
def str5(spark, sf):
    """Every epoch of a stream is logged, the even ones twice; the log has one row for each."""
    path = shared_folder(spark, "log")
    write = redaction.count_sink(path, "events")
    counts = table(spark, sf, "events").select("event_id", F.expr("event_id % 5").alias("n"))
    for epoch in [*range(_EPOCHS), *range(0, _EPOCHS, 2)]:
        write(counts.filter(F.col("event_id") % _EPOCHS == epoch), epoch)
    lines = spark.read.schema("ts string, count long, query string, epoch long").json(path)
    return lines.filter("query = 'events'").select("epoch", "count")


@register(
    "snk3_append_log",
    "SELECT cast(sum(event_id % 5) AS BIGINT) AS total, count(*) AS n FROM events WHERE event_id % 5 > 0",
)
def snk3(spark, sf):
    """Two appends of (ts, count), without the zeros, read back."""
    path = shared_folder(spark, "log")
    log = table(spark, sf, "events").select("event_id", "ts", F.expr("event_id % 5").alias("count"))
    for half in (0, 1):
        redaction_log.append_redaction_log(log.filter(F.col("event_id") % 2 == half).select("ts", "count"), path)
    back = redaction_log.read_redaction_log(spark, path)
    return back.agg(F.sum("count").alias("total"), F.count("*").alias("n"))


@register(
    "snk4_rewritten_log",
    "WITH lines AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS n FROM events) "
    "SELECT 'small' AS log, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM lines UNION ALL "
    "SELECT 'large', count(*), min(event_id), max(event_id) FROM lines WHERE r > n // 2",
)
def snk4_rewrite(spark, sf):
    """A log on both sides of the limit: left alone, and rewritten without its older half."""
    events = table(spark, sf, "events").select("ts", (F.col("event_id") + 1).alias("count"))
    rows = []
    for name, limit in (("small", 1 << 40), ("large", 100)):
        path = shared_folder(spark, "log")
        redaction_log.append_redaction_log(events.repartitionByRange("count"), redaction_log.current_folder(spark, path))
        folder = redaction_log.rewrite_log(spark, path, limit)
        if (folder == f"{path}/log-0") != (name == "small") or folder != redaction_log.current_folder(spark, path):
            raise AssertionError("the manifest does not name the folder that was written")
        kept = redaction_log.read_redaction_log(spark, folder).select((F.col("count") - 1).alias("event_id"))
        rows.append(kept.agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last")).withColumn("log", F.lit(name)))
    return rows[0].unionByName(rows[1])


@register(
    "snk2_write_redacted",
    f"WITH {PLANTED_SQL} SELECT doc_id, md5(regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b', '[REDACTED]', 'g')) AS text "
    "FROM planted",
)
def snk2(spark, sf):
    """Redacted documents, written under their key and read again."""
    path = shared_folder(spark, "redacted")
    few = base.some_rules(spark, base.named("Email Address"))
    # one rule only, and no allow-list entry speaks of these addresses
    documents.write_redacted(scan_plan.redact_table(planted(spark, sf), ScanConfig(), few), path)
    return spark.read.parquet(path).select("doc_id", F.md5("text").alias("text"))


