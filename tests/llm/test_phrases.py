"""Phrase collocations against brute force."""

import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from veilspan.llm import phrases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, longest=3, least=10, top=2000, covered=50):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), b in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i : i + k])
                if 100 * b >= covered * counts[part]:
                    gone.add(part)
    by_lang = {}
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            cuts = [
                (10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]])
                for k in range(1, len(w))
            ]
            score, _, left, right = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, i, p.decode(), -a, left, right, total[lang], -score)
        for lang, found in by_lang.items()
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def rows():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "Ünder", "École", "x", "漢字", "a\x0bb", "d.e", "q r", "zz z"]
    out = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", " . "]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "de", None, "und"]), text))
    out += [("en", None), (None, ""), ("de", " \t "), ("en", "...!?"), ("en", "New York City " * 40), ("en", "new york " * 3)]
    out += [("fr", "mot " * 5000 + "x" * 100_000)] * 2 + [("en", "one two three four. " * 12)] * 3
    return out


def run(spark, data, **options):
    docs = spark.createDataFrame(
        [(i, t, lang, 5, "c", 1) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string, n int, phrase string, a int"
    )
    out = phrases.collocations(docs.repartition(4), **options)
    assert dict(out.dtypes) == dict(lang="string", rank="bigint", phrase="string", a="bigint", l="bigint", r="bigint", n="bigint", score="bigint")
    return sorted(map(tuple, out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_equals_brute_force(spark):
    want = brute(rows())
    assert len(want) > 50
    assert run(spark, rows()) == want


def test_longer_phrases_and_a_short_list(spark):
    assert run(spark, rows(), longest=4, min_count=6, top=7) == brute(rows(), 4, 6, 7)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_texts_with_equal_fingerprints_are_told_apart(monkeypatch):
    """A task's phrases stay exact where all fingerprints collide."""
    import pyarrow as pa

    texts = [b"a b a c. a b", b"b a  b", b"aa b"]
    monkeypatch.setattr(phrases, "_mixed", lambda h, salt: h & np.uint64(1))
    grams = phrases.Grams(texts, ["x", "y", "x"], phrases._Tables())
    at = grams.places(2)
    out = phrases._named(grams, 2, at, grams.fingerprints(2, at), pa.array([7, 8, 9]))
    got = {(r["lang"], r["phrase"].decode()): (r["count"], r["doc_id"]) for r in out.to_pylist()}
    assert got == {
        ("x", "a b"): (2, 7), ("x", "b a"): (1, 7), ("x", "a c"): (1, 7), ("y", "b a"): (1, 8), ("y", "a b"): (1, 8), ("x", "aa b"): (1, 9)
    }


@pytest.mark.parametrize("n", [1, 2, 3])
def test_fingerprints_depend_on_the_words_alone(n):
    a = phrases.Grams([b"zzz. One  two\tthree"], ["en"], phrases._Tables())
    b = phrases.Grams([b"q", b"one two three"], ["de", "en"], phrases._Tables())
    assert a.fingerprints(n, np.array([1])) == b.fingerprints(n, np.array([1]))
    c = phrases.Grams([b"one two thref"], ["en"], phrases._Tables())
    assert a.fingerprints(3, np.array([1])) != c.fingerprints(3, np.array([0]))
