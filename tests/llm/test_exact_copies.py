"""Content sort against brute force."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from veilspan.llm import content_sort

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


def got(spark, rows, partitions=3):
    docs = spark.createDataFrame([(*r, 1, b"x", None) for r in rows], "doc_id long, text string, mix int, norm binary, head string")
    out = content_sort.exact_copies(docs.repartition(partitions))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def cases():
    rng = random.Random(5)
    rows = [(i, rng.choice(["Same text", "same TEXT", "", None, "É same", "é same", "x" * 30 + str(i % 3)])) for i in range(60)]
    rows += [(None, "only nulls"), (None, "Only nulls"), (None, "same text"), (7, "same text"), (7, "same text")]
    rows += [(1000 + i, ("long text of many words " * 9000) + str(i % 2)) for i in range(6)]
    rows += [(2000 + i, f"alone {i}") for i in range(300)]
    return rows


def test_rows_equal_brute_force(spark):
    assert got(spark, cases()) == brute(cases())


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_a_group_over_many_ranges_is_one(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(i, "Hot") for i in range(900)] + [(i, f"t{i % 5}") for i in range(50)] + [(i, "hot") for i in range(900, 950)]
        assert got(spark, rows, 5) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_ranges_of_equal_hashes_are_told_apart_by_content(spark, monkeypatch):
    real = content_sort._normalised
    monkeypatch.setattr(content_sort, "_normalised", lambda d: real(d).withColumn("mix", F.lit(b"")))
    rows = [(i, "a common beginning of all texts " + str(i % 4)) for i in range(80)]
    assert got(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert got(spark, []) == []
