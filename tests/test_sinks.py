import os

from pyspark.sql import functions as F

from veilspan.operators import deep
from veilspan.sources import documents, redaction_log
from veilspan.streaming.redaction import count_sink


def test_findings_and_log_round_trip(spark, tmp_path):
    ddl = "doc_id long, source string, category string, value string"
    rows = [(1, "pattern", "A", "x"), (2, "deep", None, None)]
    documents.write_findings(spark.createDataFrame(rows, ddl), str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert "value" not in back.columns
    assert {r["category"] for r in back.collect()} == {"A", "deep"}

    path = str(tmp_path / "log")
    write = count_sink(path)
    for n in (3, 0, 4):
        write(spark.createDataFrame([(n,)], "n int"), 0)
    log = redaction_log.read_redaction_log(spark, path)
    assert sorted(r["count"] for r in log.collect()) == [3, 4]


def test_long_word_list_gives_the_same_runs(spark, monkeypatch):
    words = [f"w{chr(97 + i)}x" for i in range(14)]
    docs = spark.createDataFrame(
        [(1, "go " + " ".join(words[:13]) + ", stop"), (2, " ".join(words[:11]))], "doc_id long, text string"
    )
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    narrow = [tuple(r) for r in deep.mnemonic_table(docs, listed).collect()]
    monkeypatch.setattr(deep, "WORDLIST_LIMIT", 3)
    looked_up = [tuple(r) for r in deep.mnemonic_table(docs.union(docs.limit(0)), listed).collect()]
    monkeypatch.setattr(deep, "WORD_SET_LIMIT", 3)
    joined = [tuple(r) for r in deep.mnemonic_table(docs, listed).collect()]
    assert narrow == looked_up == joined == [(1, 3, 3 + 13 * 4, 13)]


def test_gates(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abcdef")], "doc_id long, text string")
    keep, apart = documents.size_gate(docs, limit=3, policy="pass")
    assert [r["doc_id"] for r in keep.collect()] == [1]
    assert [(r["doc_id"], r["passed"]) for r in apart.collect()] == [(2, True)]
    raw = docs.select("doc_id", F.expr("concat(cast(text as binary), X'FF')").alias("raw"))
    good, bad = documents.valid_utf8_gate(raw)
    assert good.count() == 0 and bad.count() == 2


def test_ocr_words_of_splits_read_in_another_order(spark):
    from veilspan.sources.ocr import parse_ocr_lines

    def line(word):
        return "\t".join(["5", "1", "1", "1", "1", "1", "0", "0", "5", "5", "90", word])

    rows = [("a", 4096, 0, line("third")), ("a", 0, 8589934592, line("first")), ("a", 0, 8589934593, line("second")), ("b", 0, 7, line("own"))]
    words = parse_ocr_lines(spark.createDataFrame(rows, "image_id string, block_start long, line_no long, line string"))
    got = [(r["image_id"], r["word_ix"], r["text"]) for r in words.orderBy("image_id", "word_ix").collect()]
    assert got == [("a", 0, "first"), ("a", 1, "second"), ("a", 2, "third"), ("b", 0, "own")]


def test_files_of_one_write_are_in_the_order_of_their_parts(spark, tmp_path):
    path = str(tmp_path / "log")
    counts = spark.range(1, 1001).select(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.col("id").alias("count"))
    at = 1_700_000_000
    # two writes of several files each, whose tasks ended last part first
    for half in (counts.filter("count <= 400"), counts.filter("count > 400")):
        before = set((tmp_path / "log" / "log-0").glob("part-*"))
        redaction_log.append_redaction_log(half.repartitionByRange(4, "count"), redaction_log.current_folder(spark, path))
        files = sorted(set((tmp_path / "log" / "log-0").glob("part-*")) - before, reverse=True)
        assert len(files) == 4
        for file in files:
            at += 10
            os.utime(file, (at, at))
    for want in (range(501, 1001), range(751, 1001)):
        kept = redaction_log.read_redaction_log(spark, redaction_log.rewrite_log(spark, path, 100))
        assert sorted(r["count"] for r in kept.collect()) == list(want)
