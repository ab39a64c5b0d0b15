"""Reassembly of chunked payloads on a stream, and its sinks."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilspan import ScanConfig
from veilspan.sources import redaction_log
from veilspan.sources.rules import load_catalog
from veilspan.streaming import reassembly
from veilspan.streaming.redaction import count_sink, redact_stream
from veilspan.streaming.reassembly import END, START, _Session

SCHEMA = "session long, seq long, chunk string, ts timestamp"


def session(rows, unsure="withhold", limit=20, framed=True):
    out = _Session(None, limit, str.upper, 0, unsure, framed)
    for batch in rows:
        out.take(batch)
    out.flush()
    return [(kind, text) for _, kind, text in out.out]


def test_a_late_start_waits_for_the_first_chunk():
    early = [(3, f"t{END}z")]
    first = [(0, "a"), (1, f"b{START}s"), (2, "ecre")]
    assert session([early, first]) == [("outside", "a"), ("outside", "b"), ("outside", START), ("payload", "SECRET"), ("outside", END), ("outside", "z")] or \
        "".join(t for _, t in session([early, first])) == f"ab{START}SECRET{END}z"
    assert [t for k, t in session([early, first]) if k == "payload"] == ["SECRET"]


def test_repeated_chunks_count_once():
    rows = [(0, f"x{START}SEC"), (1, f"ret{END}y")]
    want = session([rows])
    assert session([rows + rows]) == want
    assert "".join(t for _, t in session([rows[:1], rows[:1], rows, rows])) == f"x{START}SECRET{END}y"


def test_text_after_a_lost_chunk_is_withheld_to_the_next_marker():
    got = session([[(0, "open text "), (2, f"maybe secret{END} known {START}p{END}")]])
    assert ("withheld", "maybe secret") in got and ("payload", "P") in got
    assert "secret" not in "".join(t for k, t in got if k != "withheld")
    torn = session([[(0, f"{START}SEC"), (2, f"RET{END}ok")]])
    assert [t for k, t in torn if k == "withheld"] == ["SECRET"] and ("outside", "ok") in torn
    passed = session([[(0, f"{START}sec"), (2, f"ret{END}ok")]], unsure="pass")
    assert ("payload", "SECRET") in passed


def test_a_chunk_that_was_given_up_is_withheld_once():
    s = _Session(None, 5, str.upper, 0, "withhold")
    s.take([(0, "a"), (2, "0123456789")])  # over the limit: chunk 1 is given up
    s.take([(1, "late")])
    s.take([(1, "late"), (0, "a"), (2, "0123456789")])
    assert [(k, t) for _, k, t in s.out].count(("withheld", "late")) == 1
    assert "late" not in "".join(t for _, k, t in s.out if k != "withheld")


def test_overflow_is_told_once():
    s = _Session(None, 20, str.upper)
    s.take([(0, f"{START}" + "y" * 30)])
    assert s.take_overflow() == [1] and s.take_overflow() == []
    s.take([(1, f"yy{END}{START}" + "z" * 40 + END)])
    assert s.take_overflow() == [2] and s.take_overflow() == []


def test_unframed_text_has_no_markers():
    rows = [[(0, f"a{START}hel"), (1, f"lo{END}\r{START}" + "A" * 30), (2, f"\x1b[2{END}.")]]
    got = session(rows, framed=False)
    assert "".join(t for _, t in got) == "aHELLO\r" + "A" * 30 + "\x1b[2."


def chunks(rng, sessions=6):
    """Rows of whole sessions, cut anywhere, also inside markers."""
    rows, whole = [], {}
    for k in range(sessions):
        text = "".join(rng.choice(["plain ", START + "one two" + END, START + "L" * 40 + END, "\x1b[2", "é", START + START + "x" + END, END]) for _ in range(12))
        text += rng.choice(["", START + "never closed"])
        whole[k] = text
        seq = at = 0
        while at < len(text):
            n = rng.randrange(1, 9)
            rows.append((k, seq, text[at : at + n]))
            seq, at = seq + 1, at + n
    return rows, whole


@pytest.mark.parametrize("framed", [True, False])
def test_stream_gives_the_batch_result(spark, tmp_path, framed):
    rng = random.Random(21 + framed)
    rows, whole = chunks(rng)
    table = spark.createDataFrame(rows, "session long, seq long, chunk string")
    batch = reassembly.redact_payloads(table.union(table), F.upper, limit=20, framed=framed)
    want = {}
    for r in batch.orderBy("session", "segment", "seq").collect():
        want[r.session] = want.get(r.session, "") + r.text
    big = {(r.session, r.payload_no) for r in reassembly.overflows(table, 20).collect()}
    assert big

    # repeats, any order, and a first micro-batch that starts in the middle
    sent = rows + rng.sample(rows, len(rows) // 3)
    rng.shuffle(sent)
    src = tmp_path / "in"
    for i in range(4):
        part = [(k, q, c, None) for k, q, c in sent[i::4] if i or q >= 3] + [(k, q, c, None) for k, q, c in sent[0::4] if i == 3 and q < 3]
        df = spark.createDataFrame(part, SCHEMA).withColumn("ts", F.lit(f"2024-01-01 00:0{i}:00").cast("timestamp"))
        df.coalesce(1).write.parquet(str(src / f"part{i}"))
    end = spark.createDataFrame([(99, 0, "end", None)], SCHEMA).withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    end.coalesce(1).write.parquet(str(src / "part4"))
    last = spark.createDataFrame([(99, 1, "end", None)], SCHEMA).withColumn("ts", F.lit("2024-01-03").cast("timestamp"))
    last.coalesce(1).write.parquet(str(src / "part5"))
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = reassembly.redact_payload_stream(live, str.upper, limit=20, framed=framed)
    got, told = {}, set()

    def keep(df, epoch):
        for r in df.orderBy("session", "piece_no").collect():
            if r.kind == "overflow":
                told.add((r.session, r.payload_no))
            else:
                assert r.withheld is None and r.kind != "late"
                got[r.session] = got.get(r.session, "") + r.text

    query = out.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got.pop(99, None)
    assert got == want
    assert told == big


def test_a_batch_that_is_run_again_is_logged_once(spark, tmp_path):
    write = count_sink(str(tmp_path / "log"), "mail")
    other = count_sink(str(tmp_path / "log"), "chat")
    for sink, n, epoch in ((write, 3, 0), (write, 0, 1), (write, 4, 2), (write, 4, 2), (other, 5, 2), (write, 3, 0)):
        sink(spark.createDataFrame([(n,)], "n int"), epoch)
    log = redaction_log.read_redaction_log(spark, str(tmp_path / "log"))
    assert sorted(r["count"] for r in log.collect()) == [3, 4, 5]


def test_a_large_log_loses_its_older_half(spark, tmp_path):
    root = str(tmp_path / "log")
    for i in range(5):
        rows = spark.range(i * 10, i * 10 + 10, 1, 1).select(F.lit("2024-01-01").cast("timestamp").alias("ts"), (F.col("id") + 1).alias("count"))
        redaction_log.append_redaction_log(rows, redaction_log.current_folder(spark, root))
    counts = lambda: sorted(r["count"] for r in redaction_log.read_redaction_log(spark, redaction_log.current_folder(spark, root)).collect())
    before = redaction_log.rewrite_log(spark, root)  # below a megabyte
    assert before.endswith("log-0") and counts() == list(range(1, 51))
    assert redaction_log.rewrite_log(spark, root, limit=100) != before
    assert counts() == list(range(26, 51))
    redaction_log.append_redaction_log(rows.withColumn("count", F.col("count") + 100), redaction_log.current_folder(spark, root))
    assert len(counts()) == 35
    redaction_log.rewrite_log(spark, root, limit=100)
    assert counts() == [*range(43, 51), *range(141, 151)]


def test_messages_above_the_limit_are_withheld(spark, tmp_path):
    rows = [(1, "mail a@b.co"), (2, "mail a@b.co " + "x" * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "in"))
    catalog = load_catalog(spark).filter("name = 'Email Address'")
    want = {"quarantine": None, "pass": rows[1][1], "scan": "mail [REDACTED] " + "x" * 50}
    for policy, text in want.items():
        out = redact_stream(stream, ScanConfig(size_limit=30), catalog, policy)
        query = out.writeStream.format("memory").queryName(f"gated_{policy}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = {r.doc_id: (r.text, r.too_large) for r in spark.table(f"gated_{policy}").collect()}
        assert got == {1: ("mail [REDACTED]", False), 2: (text, policy != "scan")}


class _State:
    """A value or list of the state store that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def clear(self):
        self.put([])


class _Value(_State):
    def get(self):
        self.calls += 1
        return self.rows[0] if self.rows else None

    def update(self, row):
        self.put([row])


class _Handle:
    def __init__(self):
        self.states, self.timers = [], []

    def getValueState(self, name, schema):
        self.states.append(_Value())
        return self.states[-1]

    def getListState(self, name, schema):
        self.states.append(_State())
        return self.states[-1]

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_batch_of_a_session_takes_few_calls_and_gives_rows():
    handle, text = _Handle(), f"a{START}one{END}b{START}" + "x" * 30 + f"{END}c{START}two{END}!"
    worker = reassembly.Reassembler(600_000, 20, str.upper, 0, "withhold", True, 1000)
    worker.init(handle)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    chunk = Row("session", "seq", "ts", "chunk")
    sent = [chunk(7, i, datetime(2024, 1, 1), text[2 * i : 2 * i + 2]) for i in range((len(text) + 1) // 2)]
    got = []
    for batch in (sent[20:], sent[3:20] + sent[25:], sent[:2], sent[:3] + sent[:1]):
        before = sum(s.calls for s in handle.states)
        got += list(worker.handleInputRows((7,), iter(batch), clock))
        assert sum(s.calls for s in handle.states) - before <= 6
        assert handle.timers == [int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000) + 600_000]
    got += list(worker.handleExpiredTimer((7,), clock, None))
    assert "".join(r.text for r in got if r.kind != "overflow") == text.replace("one", "ONE").replace("two", "TWO")
    assert [r.payload_no for r in got if r.kind == "overflow"] == [2]
    assert not any(s.rows for s in handle.states)
