"""Vector searches and chat rendering against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from veilspan.llm import ann, chat, topk


def vectors(spark, n=700, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(8, dim))[rng.integers(0, 8, n)]
    v[5] = v[6] = v[7]
    rows = [(i, x.astype("float32").tolist(), 1) for i, x in enumerate(v)]
    rows += [
        (9000, None, 1),
        (9001, [float("nan")] * dim, 1),
        (9002, [None] * dim, 1),
        (9003, [math.inf] * dim, 1),
        (9004, [0.0] * dim, 1),
        (9005, [], 1),
        (9006, [1.0, 2.0], 1),
        (9007, [2.0, -2.0], 1),
        (None, rows[0][1], 1),
        rows[3],
        (4, [9.0] * dim, 1),  # the smaller of two vectors of an id counts
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), rows


def usable(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [float(np.float32(a)) for a in v]
        if zero or any(x):
            out[i] = min(out.get(i, x), x)
    return out


def brute(vecs, every, k, score):
    out = set()
    for q, x in vecs.items():
        if q % every == 0:
            same = [(-score(x, y), i) for i, y in vecs.items() if i != q and len(y) == len(x)]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(same)[:k])}
    return out


def test_exact_top_k(spark):
    df, rows = vectors(spark)
    vecs = {i: [math.floor(256 * x) for x in v] for i, v in usable(rows, True).items()}
    want = brute(vecs, 10, 5, lambda a, b: sum(x * y for x, y in zip(a, b)))
    for blocks in ({}, {"candidate_block": 100, "query_block": 16, "dim_block": 5}):
        got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 5, **blocks)
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_multi_index_recall(spark):
    df, rows = vectors(spark, n=1500)
    vecs = usable(rows, False)
    want = {}
    for q, _, i, _ in brute(vecs, 10, 20, lambda a, b: float(np.dot(a, b))):
        want.setdefault(q, set()).add(i)
    whole = None
    for blocks in ({}, {"candidate_block": 200, "query_block": 20}):
        got = ann.approximate_top_k(df, F.col("vec_id") % 10 == 0, 20, **blocks).collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, {})[r.vec_id] = r.score
        assert found.keys() == want.keys()
        assert all(len(found[q]) == len(want[q]) for q in want)
        assert sum(len(want[q] & found[q].keys()) for q in want) >= 0.9 * sum(map(len, want.values()))
        assert all(abs(s - np.dot(vecs[q], vecs[i])) < 1e-9 for q in found for i, s in found[q].items())
        rank = {(r.query_id, r["rank"], r.vec_id) for r in got}
        assert whole in (None, rank)  # how rows are dealt changes nothing
        whole = rank
    assert ann.approximate_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_traverse_takes_the_best_pairs_first():
    rng = np.random.default_rng(3)
    index = ann.MultiIndex(rng.normal(size=(6, 3)), rng.normal(size=(7, 4)), rng.integers(0, 5, 42))
    q = rng.normal(size=7)
    summed = ((index.first @ q[:3])[:, None] + (index.second @ q[3:])[None, :]).ravel()
    order = np.argsort(-summed)
    for want in (0, 1, 10, 40, 10**6):
        marked = index.traverse(q, want)
        n = int(marked.sum())
        assert set(np.flatnonzero(marked)) == set(order[:n])
        assert index.cells[marked].sum() >= min(want, index.cells.sum())


def render(rows, block):
    def plain(s):
        return s.replace("<|", "< |").replace("|>", "| >")

    rows = {(c, t, r if r is not None else "unknown", x or "") for c, t, r, x in rows}
    out = set()
    for conv in {r[0] for r in rows}:
        speakers = {r[2] for r in rows if r[0] == conv} - {"system"}
        part = lambda t: -1 if t is None else t // block
        for p in {part(r[1]) for r in rows if r[0] == conv}:
            turns = sorted((r for r in rows if r[0] == conv and part(r[1]) == p), key=lambda r: (r[1] or 0, r[2], r[3]))
            for who in speakers:
                text, masks = "", []
                for _, _, role, said in turns:
                    head = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={plain(role)}|>\n"
                    body = plain(said) + "<|end|>\n"
                    if role == who:
                        masks.append((len(text + head), len(text + head + body) - 1))
                    text += head + body
                out.add((conv, who, p, len(turns), text, tuple(masks)))
    return out


def test_every_speaker_gets_a_perspective(spark):
    rng = random.Random(0)
    names = ["user", "assistant", "system", "Zoë 🤦🏼‍♂️", None, "x<|end|>"]
    rows = [(c, t, rng.choice(names), f"turn {t} 漢 <|end|>") for c in range(9) for t in range(rng.randrange(1, 30))]
    rows += [(50, 0, "system", "alone"), (51, 0, "user", None), (51, 0, "user", None), (51, 0, "bot", "tie"), (51, None, "user", "when")]
    rows += [(None, 0, "user", "no id"), (None, 1, "user", "no id")]
    rows += [(60, t, "ab"[t % 2], "long") for t in range(1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    for block in (8, 256):
        got = chat.rotate_perspectives(df, block_turns=block)
        assert {
            (r.conv_id, r.speaker, r.part, r.n_turns, r.text, tuple((m.start, m.end) for m in r.masks))
            for r in got.collect()
        } == render(rows, block)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
