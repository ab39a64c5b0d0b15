"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from veilspan.llm import queries, runs


def brute_runs(w, least=6, times=4):
    """All maximal runs, by start, then period."""
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p) and (i, j + p) not in out:
                out[i, j + p] = p
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return [x for i, x in enumerate(w) if i not in gone]


def words_like(rng, n, sigma):
    out = []
    while len(out) < n:
        unit = [rng.randrange(1, sigma + 1) for _ in range(rng.randrange(1, 7))]
        out += unit * rng.choice([1, 1, 2, 4, 5, 9]) + [rng.randrange(1, sigma + 1) for _ in range(rng.randrange(4))]
    return out[:n]


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (5, 3), (20, 2)])
def test_runs_equal_brute_force(limits):
    rng = random.Random(sum(limits))
    for k in range(250):
        w = words_like(rng, rng.randrange(90), rng.choice([1, 2, 3, 8]))
        found = runs.word_runs(np.array(w, "i8"), *limits)
        assert list(map(tuple, found.tolist())) == brute_runs(w, *limits), w


def test_common_prefixes_equal_brute_force():
    rng = random.Random(4)
    for sigma in (1, 2, 5):
        w = [rng.randrange(sigma) for _ in range(150)]
        tree = runs.SuffixTree(np.array(w))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(151), np.arange(151)))
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(150) if max(a, b) + k >= 150 or w[a + k] != w[b + k]), 150) for a, b in zip(i, j)]
        assert tree.common_prefix(i, j).tolist() == want
        assert tree.order.tolist() == sorted(range(151), key=lambda s: w[s:])


def texts():
    rng = random.Random(9)
    out = [None, "", " \t\n", "one", "a b c " * 50, "ha " * 6, "ha " * 5, "x\x1cy " * 8, "É é " * 30, "漢 字\x0b" * 9]
    for _ in range(300):
        out.append(" ".join("w" + str(x) for x in words_like(rng, rng.randrange(120), rng.choice([2, 5, 60]))))
    return out + ["lorem ipsum dolor " * 3000 + " ".join(map(str, range(30000))), "z" * 200_000]


def rows(spark):
    data = [(i, t, 1, "r") for i, t in enumerate(texts())] + [(None, "ho " * 9, 1, ""), (4, "a b c " * 50, 1, "")]
    return spark.createDataFrame(data, "doc_id long, text string, n_runs int, runs string").repartition(3)


def test_documents_equal_brute_force(spark):
    docs = rows(spark)
    out = runs.periodic_runs(docs)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    want = []
    for r in docs.collect():
        w = [x.decode() for x in (r.text or "").encode().split()]
        found = brute_runs(w) if len(w) < 5000 else [(0, 9000, 3)]
        want.append((r.doc_id, found, " ".join(collapsed(w, found))))
    assert got == sorted(want, key=repr)


def test_the_query_equals_brute_force(spark, tmp_path):
    rows(spark).filter("doc_id is null or length(text) < 5000 or text is null").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, tuple(r)[1:])
    planted = 0
    for i, t in [*enumerate(texts()), (None, "ho " * 9)]:
        if t is not None and len(t) >= 5000:
            continue
        w = [x.decode() for x in (t or "").encode().split()]
        n = len(w)
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute_runs(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (
            len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(collapsed(w, found))),
        )
        assert got[i] == want, i
    assert planted > 20


def test_no_rows(spark):
    assert runs.periodic_runs(rows(spark).limit(0)).collect() == []
