"""Stages of the pipeline, against brute force."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from veilspan.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_components(rows):
    """Smallest position of each row's component, over all pairs."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if root[a] != root[b] and similarity(sets[a], sets[b]) >= 0.8:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def copy_pairs(rng, n, low, high, n_words=5000):
    """Texts of 300 words and their copies with single words changed or a passage appended, of a similarity in a band."""
    words = [f"w{i}" for i in range(n_words)]
    out = []
    while len(out) < 2 * n:
        text = rng.choices(words, k=300)
        copy = list(text)
        if len(out) % 4:
            for at in rng.sample(range(300), rng.randrange(4, 12)):
                copy[at] = rng.choice(words)
        else:
            copy += rng.choices(words, k=rng.randrange(40, 100))
        a, b = " ".join(text), " ".join(copy)
        if low <= similarity(shingles(a), shingles(b)) < high:
            out += [a, b]
    return out


def test_near_dedup_keeps_one_of_each_pair_around_the_threshold(spark):
    rng = random.Random(5)
    near, apart = copy_pairs(rng, 60, 0.8, 0.85), copy_pairs(rng, 60, 0.75, 0.8)
    rows = list(enumerate(near + apart))
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert got == set(range(0, 120, 2)) | set(range(120, 240))


@pytest.mark.parametrize("chunks", [{}, {"chunk_nodes": 5}, {"chunk_shingles": 700}])
def test_near_copies_equal_brute_force(spark, chunks):
    rng = random.Random(6)
    base = copy_pairs(rng, 8, 0.7, 0.95)
    dense = [base[0].replace(f"{w} ", "", 1) for w in base[0].split()[:40:2]]  # a dense group
    chain = [base[2].split()[i : i + 250] for i in range(0, 50, 6)]  # only neighbours are near
    odd = [None, "", "  \n", "one", "One ", "two words", "a b c d e", "A b  c d e", "a b c d e f", "漢字"]
    texts = [*base, *dense, *(" ".join(c) for c in chain), *odd, base[4].upper(), base[4]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows.sort()
    got = {}
    for r in near_copies.near_copies(frame(spark, [*rows, rows[3], (None, base[0])]), **chunks).collect():
        got.setdefault(r.component, set()).add(r.doc_id)
    want = {}
    for (i, _), root in zip(rows, brute_components(rows)):
        want.setdefault(root, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_candidates_are_of_near_simhashes_or_of_a_band_key(spark):
    rng = random.Random(9)
    text = rng.choices([f"w{i}" for i in range(5000)], k=4000)
    sets = [near_copies.shingle_set(" ".join(t).encode()) for t in (text, [*text[:-1], "other"], text[::-1])]
    near, copy, far = (near_copies.of_hashes(s) for s in sets)
    assert bin((near[0] ^ copy[0]) % 2**64).count("1") <= 3
    # 1 and 2 have no key in common, 3 and 4 no fingerprint, 5 is alone, 6 has neither
    rows = [(1, [1], near), (2, [2], copy), (3, [3], far), (4, [3, 4], [~far[0]]), (5, [5], [0x5555]), (6, [], [])]
    nodes = spark.createDataFrame(rows, "node long, keys array<long>, fps array<long>")
    assert {frozenset((r.a, r.b)) for r in near_copies.candidate_links(nodes).collect()} == {frozenset((1, 2)), frozenset((3, 4))}


def test_link_sets_are_exact_at_the_threshold():
    at = [np.arange(8, dtype="u8"), np.arange(10, dtype="u8"), np.arange(100, 107, dtype="u8"), np.arange(100, 109, dtype="u8")]
    assert near_copies.link_sets(at).tolist() == [0, 0, 2, 3]


def test_near_dedup_drops_only_rows_linked_to_a_kept_row(spark):
    rng = random.Random(7)
    a, near_a, b, near_b = copy_pairs(rng, 2, 0.8, 0.95)
    c, d, e = (" ".join(rng.choices("abcdefgh", k=40)) for _ in range(3))
    # one id with several texts: a copy of a smaller id, texts of its own, and a repeated row
    rows = [(1, a), (2, near_a), (2, b), (2, c), (2, c), (3, near_b), (3, d), (None, a), (None, a), (4, None), (4, " "), (5, e)]
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()
    kept = sorted(((r.doc_id, r.text) for r in got if r.text and r.text.strip()), key=str)
    assert kept == sorted([(1, a), (2, b), (2, c), (3, d), (None, a), (None, a), (5, e)], key=str)
    assert [r.doc_id for r in got if not r.text or not r.text.strip()] == [4]


def corpus():
    """Documents and labels: toxic ones, shared lines, near copies around 0.8, nulls, empty texts, repeated ids."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(500):
        text = rng.choices(words, k=rng.randrange(30, 60))
        bad = i % 5 == 0
        if bad:
            for w in rng.sample(["vile", "foul", "grim"], 2):
                text.insert(rng.randrange(len(text)), w)
        body = " ".join(text)
        rows.append((i, body if i % 7 else "a line that many of the documents hold\n" + body))
        labels.append((i, 0, int(bad)))
    texts = copy_pairs(rng, 10, 0.8, 0.85, 80) + copy_pairs(rng, 10, 0.75, 0.8, 80)
    rows += enumerate(texts, 1000)
    rows += [(2000, None), (2001, ""), (1000, "w1 w2 w3 another w4 w5 w6"), rows[1], (None, texts[0]), (None, None)]
    return rows, labels


def lines_kept(rows):
    def key(line):
        return line.strip(" \t\r").lower()

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    stays = lambda i, x: i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i
    return [(i, "\n".join(x for x in (t or "").split("\n") if stays(i, x))) for i, t in rows]


def heads_kept(rows):
    named = sorted((r for r in set(rows) if r[0] is not None), key=lambda r: (r[0], r[1]))
    root = brute_components(named)
    return [named[at] for at in sorted(set(root))] + [r for r in rows if r[0] is None]


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows, labels = corpus()
    sf = str(tmp_path)
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    toxic = {i for i, _, bad in labels if bad}
    clean = [r for r in rows if r[0] not in toxic]
    lined = lines_kept(clean)
    want = [clean, lined, heads_kept(lined)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, sf).write.parquet(f"{sf}/{i}")
        docs = spark.read.parquet(f"{sf}/{i}")
        got = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "mixing":  # each row once at least and twice at most
            once = Counter(want[2])
            assert got.keys() == once.keys() and all(once[r] <= n <= 2 * once[r] for r, n in got.items())
        else:
            assert got == Counter(want[i]), name
    out = corpus_pipeline.run(spark, sf).collect()
    final = {(r.doc_id, r.decoded_sha256) for r in out}
    assert final == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want[2]}
    assert len(out) == sum(got.values())
