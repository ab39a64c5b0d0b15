import random
import re
import time

from pyspark.sql import functions as F

from veilspan import ScanConfig
from veilspan.functions import windows
from veilspan.functions.arrays import count_le, prefix_max, prefix_sum
from veilspan.functions.regex import locating_regex
from veilspan.functions.spans import locate
from veilspan.operators import allowlist, entropy, images, redact, reports, select, softwrap
from veilspan.plans.guards import guard_for
from veilspan.plans.scan import redact_table
from veilspan.sources import redaction_log
from veilspan.sources.corpus import parse_sections
from veilspan.sources.fixed_rules import RULES
from veilspan.sources.ocr import read_ocr_words
from veilspan.sources.rules import load_catalog, load_custom_patterns, validate_rules
from veilspan.streaming import reassembly


def test_prefix_scans_and_search(spark):
    rng = random.Random(3)
    data = [(i, sorted(rng.randrange(50) for _ in range(n))) for i, n in enumerate((0, 1, 2, 7, 33))]
    df = spark.createDataFrame(data, "id int, v array<int>")
    for r in df.select(
        "v",
        prefix_sum(F.col("v")).alias("s"),
        prefix_max(F.reverse("v")).alias("m"),
        F.transform(F.sequence(F.lit(-1), F.lit(51)), lambda x: count_le(F.col("v"), x)).alias("c"),
    ).collect():
        assert r["s"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))]
        assert r["m"] == [max(r["v"])] * len(r["v"]) if r["v"] else r["m"] == []
        assert r["c"] == [sum(v <= x for v in r["v"]) for x in range(-1, 52)]


def fold(spans, by_name):
    out = []
    for s, e, n in sorted(spans, key=lambda x: x[0]):
        touch = out and s == out[-1][1] and (not by_name or out[-1][2] == n)
        if out and (s < out[-1][1] or touch):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, n])
    return [tuple(x) for x in out]


def test_merge_agrees_with_a_plain_fold(spark):
    rng = random.Random(5)
    cases = []
    for i in range(300):
        spans = []
        for _ in range(rng.randrange(0, 9)):
            s = rng.randrange(0, 20)
            spans.append((s, s + rng.randrange(1, 6), rng.choice("AB")))
        cases.append((i, spans))
    df = spark.createDataFrame(cases, "id int, spans array<struct<start:int,end:int,name:string>>")
    for style in ("marker", "typed"):
        rows = df.select("id", redact.merge_spans(F.col("spans"), style).alias("m")).collect()
        for r in rows:
            want = fold(cases[r["id"]][1], style == "typed")
            assert [tuple(x) for x in r["m"]] == want


def test_allow_list_containment(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        allow = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(20) for _ in range(rng.randrange(4)))]
        s = rng.randrange(20)
        rows.append((i, allow, s, s + rng.randrange(1, 6)))
    df = spark.createDataFrame(rows, "id int, a array<struct<start:int,end:int>>, s int, e int")
    got = df.select("*", allowlist.is_allowed(allowlist.allow_index(F.col("a")), F.col("s"), F.col("e")).alias("x"))
    for r in got.collect():
        assert r["x"] == any(a[0] <= r["s"] and r["e"] <= a[1] for a in r["a"])


def test_dewrap_cases(spark):
    cases = [
        ("abcdef\nghi", "abcdefghi"),
        ("abcdef\r\nghi", "abcdefghi"),
        ("abc\nghi", "abc\nghi"),
        ("ends here.\nNew line", "ends here.\nNew line"),
        ("abcdefgh\nKEY=value", "abcdefgh\nKEY=value"),
        ("abcdefgh\nabc==", "abcdefghabc=="),
        ("abcdef \nghi", "abcdef \nghi"),
    ]
    rows = spark.createDataFrame(cases, "t string, want string").withColumn("got", softwrap.dewrap(F.col("t")))
    assert [r["t"] for r in rows.collect() if r["got"] != r["want"]] == []


def test_every_rule_has_a_java_form_and_a_sound_guard():
    assert len(RULES) == 204
    for _, name, _, _, pattern, _ in RULES:
        locating_regex(pattern)
        assert guard_for(pattern) is not None, name


def test_rule_tables(spark, tmp_path):
    catalog = load_catalog(spark)
    assert select.apply_preset(catalog, "minimal").count() == 72
    assert select.filter_buckets(catalog, ["legacy"]).count() == 204 - 35
    catalog.drop("has_secret_group", "single_line", "softwrap").write.json(str(tmp_path / "rules"))
    assert load_catalog(spark, str(tmp_path / "rules")).count() == 204
    rules = [("ok", "c", "HIGH", "a+b"), ("bad", "c", "low", "a("), ("empty", "c", "low", ""), ("zero", "c", "low", "a*")]
    good, rejected = validate_rules(spark.createDataFrame(rules, "name string, category string, severity string, regex string"))
    assert [(r["name"], r["severity"]) for r in good.collect()] == [("ok", "High")]
    assert {r["name"] for r in rejected.collect()} == {"bad", "empty", "zero"}
    missing, errors = load_custom_patterns(spark, str(tmp_path / "none.json"))
    assert missing.count() == 0 and errors.count() == 0


def test_log_and_corpus(spark, tmp_path):
    log = [("2024-01-30T12:00:00+00:00", 1), ("2024-01-30T00:00:00+00:00", 2), ("2024-01-28T00:00:00+00:00", 4),
           ("2023-12-01T00:00:00+00:00", 8), ("2024-02-05T00:00:00+00:00", 16), ("bad", 32)]
    table = redaction_log.parse_log(spark.createDataFrame(log, "ts string, count long"))
    got = redaction_log.age_buckets(table, "2024-01-31 00:00:00").first()
    assert tuple(got) == (1, 7, 7, 15, 31)
    lines = ["# doc", "# === a one ===", "# expect: X", "# expect: (none)", "body 1  ", "# note", "# === two ===", "b2"]
    rows = [("f", i // 3, i, x) for i, x in enumerate(lines)]
    sections = parse_sections(spark.createDataFrame(rows, "file string, block long, line_no long, line string"))
    got = [tuple(r) for r in sections.orderBy("section_no").select("section", "expected", "body").collect()]
    assert got == [("a one", ["X"], "body 1\n"), ("two", [], "b2\n")]


def test_reassembly_over_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(reassembly, "BLOCK_ROWS", 3)
    s, e = reassembly.START, reassembly.END
    stream = f"abc{s}hello{s}x{e}mid{e}{s}é second{e}{s}{'o' * 50}{e}{s}open"
    rng, chunks, i = random.Random(1), [], 0
    while i < len(stream):
        n = rng.choice([1, 1, 2, 3, 7])
        chunks.append((1, len(chunks), stream[i : i + n]))
        i += n
    rows = reassembly.reassemble(spark.createDataFrame(chunks, "session long, seq long, chunk string"), limit=20)
    got = [(r["payload"], r["overflowed"]) for r in rows.orderBy("payload_no").collect()]
    assert got == [(f"hello{s}x", False), ("é second", False), (None, True)]


def test_no_byte_of_a_chunked_text_is_lost(spark, monkeypatch):
    monkeypatch.setattr(reassembly, "BLOCK_ROWS", 3)
    s, e = reassembly.START, reassembly.END
    rng, chunks, want = random.Random(5), [], {}
    for session in range(6):
        parts = [rng.choice(["out", s, e, "é", "ab" * 9, "", s[:3], "x" * 40]) for _ in range(40)]
        stream, i, seq = "".join(parts) + f"{e}{s}rest" * (session % 2), 0, 0
        want[session] = stream
        while i < len(stream):
            n = rng.choice([0, 1, 1, 2, 5, 30])
            chunks.append((session, seq, stream[i : i + n]))
            i, seq = i + n, seq + 1
    df = spark.createDataFrame(chunks, "session long, seq long, chunk string").repartition(4)
    for redact in (lambda c: c, F.upper):
        rows = reassembly.redact_payloads(df, redact, limit=20).orderBy("session", "segment", "seq").collect()
        got = {k: "".join(r["text"] for r in rows if r["session"] == k) for k in want}
        assert {k: v.lower() for k, v in got.items()} == want
    kinds = {r["kind"] for r in rows}
    assert kinds == {"outside", "payload", "over", "open"}
    assert all(r["text"] == r["text"].upper() for r in rows if r["kind"] == "payload")


def test_stream_session_reads_in_order_and_lets_go():
    s, e = reassembly.START, reassembly.END
    whole = f"a{s}one{e}b{s}{'x' * 50}{e}c{s[:4]}{s}open"
    rng = random.Random(2)
    for size in (1, 3, 1000):
        parts = [whole[i : i + size] for i in range(0, len(whole), size)]
        rows = [(i + 7, p) for i, p in enumerate(parts)]
        kept, out = None, []
        half = max(1, len(rows) // 2)
        for batch in (rows[:1], rows[1:half], rows[half:] if len(rows) > 1 else []):
            rng.shuffle(batch)  # in any order within a batch
            session = reassembly._Session(kept, 20, str.upper)
            session.take(batch)
            kept = session.kept()
            out += session.out
        session = reassembly._Session(kept, 20, str.upper)
        session.flush()
        out += session.out
        assert "".join(t for _, _, t in out) == whole.replace("one", "ONE")
        assert [t for _, k, t in out if k == "payload"] == ["ONE"]
    gap = reassembly._Session(None, 20, str.upper)
    gap.take([(0, f"{s}he"), (2, "lo" + "y" * 30)])  # chunk 1 is lost
    gap.flush()
    assert "".join(t for _, _, t in gap.out) == f"{s}helo" + "y" * 30


def test_merged_rules_have_their_own_numbers(spark):
    one = load_catalog(spark).limit(1)
    user = spark.createDataFrame([("A", "c", "High", "a1"), ("B", "c", "High", "b1")], "name string, category string, severity string, regex string")
    assert [r["ord"] for r in select.merge_rules(one, user).orderBy("ord").collect()] == [0, 1, 2]
    assert [r["ord"] for r in select.merge_rules(one.limit(0), user).orderBy("ord").collect()] == [0, 1]


def test_profile_keeps_groups_without_a_name(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (3, "en")], "doc_id long, lang string")
    findings = spark.createDataFrame([(1, "PII"), (1, "PII"), (3, "PII")], "doc_id long, category string")
    got = {(r["lang"], r["findings"], r["leaky_docs"], r["docs"]) for r in reports.leak_profile(findings, docs, "lang").collect()}
    assert got == {(None, 2, 1, 2), ("en", 1, 1, 1)}


def test_ocr_file_to_boxes(spark, tmp_path):
    head = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n"
    rows = [f"5\t1\t1\t1\t1\t{i}\t{10 * i}\t5\t8\t6\t90\t{w}\n" for i, w in enumerate(["mail", "a@b.co", "now"])]
    (tmp_path / "scan.tsv").write_text(head + "".join(rows))
    words = read_ocr_words(spark, str(tmp_path))
    assert [r["word_ix"] for r in words.orderBy("word_ix").collect()] == [0, 1, 2]
    text = images.assemble(images.word_ranges(words)).first()["text"]
    assert text == "mail a@b.co now"


def test_a_leading_run_is_tried_once(spark):

    from veilspan.functions.regex import FLAGS, to_java

    email = next(r[4] for r in RULES if r[1] == "Email Address")
    login = r"\b[A-Za-z0-9._%+-]+:[A-Za-z0-9!@#$%^&*()_+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    rng = random.Random(8)
    parts = ["a", "é", ".", "-", "%", "@", "b.co", ":", "x@y.org", " ", "_", "a.a@", "ß."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, text string")
    for pattern in (email, login):
        assert "\\G" in locating_regex(pattern)[0]
        plain = F.regexp_extract_all("text", F.lit(FLAGS + to_java(pattern)), F.lit(0))
        got = F.transform(locate(F.col("text"), pattern), lambda s: s["value"])
        assert df.select(plain.alias("want"), got.alias("got"), "text").filter("want <> got").collect() == []
    long = spark.createDataFrame([("@ " + "a." * 200_000,)], "text string")
    start = time.time()
    assert long.select(F.size(locate(F.col("text"), email)).alias("n")).first()["n"] == 0
    assert time.time() - start < 10  # from every boundary it would take hours


def test_running_sum_crosses_blocks(spark):
    df = spark.range(0, 50).withColumn("k", F.col("id") % 2)
    out = windows.running_sum(df, ["k"], F.floor(F.col("id") / 7), [F.col("id")], F.col("id"), "s")
    for r in out.collect():
        assert r["s"] == sum(x for x in range(r["id"] + 1) if x % 2 == r["k"])


def test_stream_redacts_and_reassembles(spark, tmp_path):
    from veilspan.streaming.redaction import redact_stream

    src = tmp_path / "in"
    spark.createDataFrame([(1, "mail a@b.co"), (2, "none")], "doc_id long, text string").write.json(str(src))
    catalog = load_catalog(spark).filter("name = 'Email Address'")
    stream = spark.readStream.schema("doc_id long, text string").json(str(src))
    query = (
        redact_stream(stream, ScanConfig(), catalog).writeStream.format("memory").queryName("redacted_out")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r["doc_id"]: r["text"] for r in spark.sql("SELECT * FROM redacted_out").collect()}
    assert got == {1: "mail [REDACTED]", 2: "none"}

    chunks = tmp_path / "chunks"
    s, e = reassembly.START, reassembly.END
    rows = [(1, 0, f"x{s}he"), (1, 1, f"llo{e[:3]}"), (1, 2, f"{e[3:]}tail")]
    df = spark.createDataFrame(rows, "session long, seq long, chunk string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(chunks))
    live = spark.readStream.schema(df.schema).parquet(str(chunks))
    query = (
        reassembly.reassemble_stream(live).writeStream.format("memory").queryName("payloads_out")
        .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert [r["payload"] for r in spark.sql("SELECT * FROM payloads_out").collect()] == ["hello"]


def test_occurrences_of_tokens_inside_longer_runs(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = ["".join(rng.choices("abé1", k=rng.randint(3, 5))) for _ in range(6)]
        words = [rng.choice(base) + rng.choice(["", "", *base]) for _ in range(12)]
        texts.append((" ".join(words), rng.sample(words, 3) + rng.sample(base, 2)))
    rows = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(texts)], "id int, text string, tokens array<string>")
    runs = locate(F.col("text"), "[a-zé0-9]+")
    found = rows.select("id", entropy.occurrences(runs, F.col("tokens")).alias("o")).collect()
    for row in found:
        text, tokens = texts[row["id"]]
        raw, want = text.encode(), set()
        for run in re.finditer(rb"[^ ]+", raw):
            for token in {t.encode() for t in tokens}:
                for m in re.finditer(re.escape(token), run.group()):
                    want.add((run.start() + m.start(), run.start() + m.end(), token.decode()))
        assert [(s["start"], s["end"], s["value"]) for s in row["o"]] == sorted(want)


def test_many_distinct_tokens_take_linear_time(spark):
    cfg = ScanConfig(enable_entropy=True)

    def seconds(n):
        rng = random.Random(n)
        words = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz0123456789", 25 + i % 10)) for i in range(n)]
        docs = spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")
        start = time.monotonic()
        out = redact_table(docs, cfg).select("n", "text").first()
        assert out["n"] == n and words[7] not in out["text"]
        return time.monotonic() - start

    seconds(100)
    small, large = seconds(5000), seconds(10000)
    assert large < 2.5 * small + 2
