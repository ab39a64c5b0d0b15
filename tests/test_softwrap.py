"""Entropy tokens over soft wraps against brute force, and their cost on a long row."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from veilspan import ScanConfig
from veilspan.operators.softwrap import WRAP
from veilspan.plans.scan import scan
from veilspan.sources.rules import load_catalog


def entropy(t):
    return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))


def tokens(text):
    return [t for t in dict.fromkeys(re.findall(r"[\w.\-]+", text)) if 20 <= len(t) <= 256 and entropy(t) >= 3.8]


def brute(text):
    """(start, value) of the tokens that only the rejoined text has, in the order they are taken."""
    joined, back, at = "", [], 0
    for m in re.finditer(WRAP, text):
        back += range(at, m.start())
        joined += text[at : m.start()]
        at = m.end()
    back += range(at, len(text))
    joined += text[at:]
    known, seen, out = tokens(text), set(), []
    for t in tokens(joined):
        if t in known:
            continue
        for m in re.finditer(re.escape(t), joined):
            a, b = back[m.start()], back[m.end() - 1] + 1
            if "\n" in text[a:b] and not any(p in known for p in re.split("[\r\n]", text[a:b]) if p):
                if a not in seen:
                    seen.add(a)
                    known.append(t)
                    out.append((a, t))
    return sorted(out)


def texts():
    rng = random.Random(12)
    alphabet = "abcdefghijkmnpqrstuvwxyz23456789"
    long = ["".join(rng.sample(alphabet, 24)) for _ in range(6)]
    short = ["".join(rng.sample(alphabet, 11)) for _ in range(6)]
    out = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(2, 9)):
            kind = rng.randrange(5)
            a, b = rng.choice(short), rng.choice(short)
            # two halves, a token and a tail, a token that is another's half, a plain word, a token alone
            parts.append([f"{a}\n{b}", f"{rng.choice(long)}\n{a}", f"{a}{b}\n{a}", "plain words", rng.choice(long)][kind])
        out.append(rng.choice([" ", "  ", ", "]).join(parts))
    return out


def test_wrapped_tokens_equal_brute_force(spark):
    data = texts()
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)
    none = load_catalog(spark).filter("false")
    found = scan(docs, ScanConfig(enable_entropy=True), catalog=none).filter("source = 'softwrap_entropy'")
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["value"]))
    want = {i: b for i, t in enumerate(data) if (b := brute(t))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert len(want) > 100


def test_many_wrapped_tokens_take_linear_time(spark):
    none = load_catalog(spark).filter("false")

    def seconds(n):
        rng = random.Random(n)
        text = " ".join("".join(rng.sample("abcdefghijkmnpqrstuvwxyz23456789", 30)) for _ in range(n))
        text = re.sub(r"(\w{15})(\w{15})", r"\1\n\2", text)
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.monotonic()
        found = scan(docs, ScanConfig(enable_entropy=True), catalog=none).filter("source = 'softwrap_entropy'")
        assert found.agg(F.count("*")).first()[0] == n
        return time.monotonic() - start

    seconds(100)
    small, large = seconds(4000), seconds(8000)  # 250 KB
    assert large < 3 * small + 3
