"""Operators on texts, against the libraries or brute force."""

import base64
import hashlib
import random
import re

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import bpe, line_dedup, mixing, pii, simhash, token_counts, toxicity
from veilspan.llm.queries import PIECES, RANKS

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, _k0 string"
ODD = [
    None,
    "",
    " ",
    "  two  blanks ",
    "a\n\nb \n c\n",
    "\n",
    "▁▁ literal ▁x",
    "ünïcödé 漢字かな交じり文 🤦🏼‍♂️ <s> <0x0A> <|endoftext|>",
    "x" * 5000,
    "ab" * 3000 + " 漢" * 700,
    " " * 3000 + "end",
    "tab\there\r\nand 12345678901234567890",
    "it's they'll I'd WE'RE",
]


def texts():
    rng = random.Random(3)
    words = ["the", "Is", "ander", "übung", "élan", "que,", "123", "...", "<s>", "x1y2", "\n", "  "]
    more = ["".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(80))) for _ in range(60)]
    return ODD + more + more[:10]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, 1, "own") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", "en", None, 1, 1, "")], DOCS).repartition(3)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def test_token_counts_equal_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(PIECES))
    want = []
    for r in docs.collect():
        t = r.text or ""
        n = len(sp.encode(t))
        want.append((r.doc_id, len(t.encode()), n, n > 100))
    got = token_counts.token_counts(docs, P.path(PIECES), limit=100)
    assert by_id(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(
        want, key=lambda r: (r[0] is not None, r)
    )
    assert token_counts.token_counts(docs.limit(0), P.path(PIECES)).count() == 0


def test_bpe_equals_the_library_and_decodes(spark, docs, monkeypatch):
    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.round_trip(docs, P.path(RANKS), P.PATTERN)
    assert by_id(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(
        want, key=lambda r: (r[0] is not None, r)
    )
    back = bpe.decode(bpe.encode(docs, P.path(RANKS), P.PATTERN), P.path(RANKS), P.PATTERN)
    assert by_id(back, "doc_id", "text") == by_id(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text"
    )
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert by_id(bpe.decode(odd, P.path(RANKS), P.PATTERN), "doc_id", "text") == [(1, None), (2, "")]
    # a long word goes by the heap, with the same result
    codec = bpe.Codec(open(P.path(RANKS), "rb").read(), P.PATTERN)
    for word in ("anderungen", "élan" * 9, "ab" * 40):
        b = word.encode()
        assert bpe.merge_long(b, ranks) == codec._merged([b])[1].tolist() == enc._encode_single_piece(b)


# ---- line dedup ------------------------------------------------------------


def lines_brute(rows, min_chars=20, min_docs=3):
    def key(line):
        k = line.strip(" \t\n\v\f\r")
        return re.sub("[A-Z]", lambda m: m.group().lower(), k)

    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((d, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    pool = [f"Line number {i} of the SHARED pool é" for i in range(12)] + ["short", "", "ÀÉ" * 10, "àé" * 10]
    rows = [
        (d, "\n".join(rng.choice(["", "  ", "\t"]) + rng.choice(pool) + rng.choice(["", " \r"]) for _ in range(n % 9)))
        for d, n in enumerate(range(300))
    ]
    rows += [(d, "a line that is found in every document") for d in range(300, 700)]
    rows += [(5, "another text of the same id\n" + pool[0]), rows[8], (None, pool[0]), (9000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bitmap string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # many partitions, so that keys straddle
        got = line_dedup.dedup_lines(df)
        assert by_id(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == lines_brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# ---- simhash ---------------------------------------------------------------


def print_brute(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_brute(prints):
    """prints: (doc, fp); the smallest reachable id of each."""
    head = {d: d for d, _ in prints}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 3:
                a_, b_ = sorted((find(a), find(b)))
                head[b_] = a_
    return {d: find(d) for d, _ in prints}


def test_simhash_equals_brute_force(spark, docs):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    rng = random.Random(2)
    rows = [(1000 + i, " ".join(base * 30 + [rng.choice(base)] * (i % 3))) for i in range(60)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    for chunk in (2048, 4):  # the second splits groups into many chunks
        got = simhash.near_duplicates(more, chunk=chunk).collect()
        prints = [(r.doc_id, print_brute(r.text)) for r in more.collect()]
        assert sorted((r.doc_id or -1, r.fp % 2**64) for r in got) == sorted((d or -1, x) for d, x in prints)
        want = classes_brute(sorted({p for p in prints if p[0] is not None}))
        assert {(r.doc_id, r.component_id) for r in got} == {*want.items(), (None, None)}
    assert simhash.near_duplicates(more.limit(0)).count() == 0


def test_simhash_chains_of_near_prints(spark):
    rng = random.Random(4)
    prints, x = [], rng.getrandbits(64)
    for i in range(400):
        prints.append((i, x))
        x ^= 1 << rng.randrange(64)
        if i % 2:
            x ^= 1 << rng.randrange(64)
        if i % 40 == 39:
            x = rng.getrandbits(64)
    of = {}
    for i, x in prints:
        of.setdefault(x, i)
    rows = [(i, [x - (1 << 64) if x >> 63 else x]) for x, i in of.items()]
    for chunk in (2048, 3):
        found = simhash.links(spark.createDataFrame(rows, "node long, fps array<long>"), chunk)
        got = {r.node: r.label for r in simhash.components(found).collect()}
        want = classes_brute([(i, x) for x, i in of.items()])
        assert {i: got.get(i, i) for i in want} == want


def test_more_fingerprints_link_more_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(300)]
        rows.append((2 * i, " ".join(text)))
        for at in rng.sample(range(300), 5):
            text[at] = rng.choice(words)
        rows.append((2 * i + 1, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = []
    for seeds in (1, 16):
        out = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, seeds=seeds).collect()}
        assert all(c // 2 == d // 2 for d, c in out.items())  # never another text's
        linked.append(sum(out[2 * i + 1] == 2 * i for i in range(60)))
    assert linked[0] < linked[1] and linked[1] >= 45


# ---- mixing ----------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    rows += [(9001, None, "silent"), (9002, "", "silent"), (9003, "one two", None), (None, "a b", "s0"), rows[0]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, tokens int")
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    total = sum(tokens.values())
    block = 300
    dealt = mixing.mix_sources(df, mixing.Mix(max_repeats=3.0, block_tokens=block)).collect()
    got = {}
    for r in dealt:
        got[r.source] = got.get(r.source, 0) + r.n_tokens
    repeats = {s: got[s] / n for s, n in tokens.items() if n}
    assert min(repeats.values()) == 1.0 and repeats["hot"] == 1.0
    assert max(repeats.values()) <= 3.0 + 1e-9 + 2 * block / min(n for n in tokens.values() if n > block)
    passes = {}
    for r in dealt:
        passes.setdefault((r.doc_id, r.source), set()).add(r.epoch)
    assert len(passes) == len({(d, s) for d, _, s in rows})
    assert all(p == set(range(len(p))) for p in passes.values())
    # entropy and a budget below the whole
    n = sum(1 for v in tokens.values() if v)
    mix = mixing.Mix(entropy=0.9, budget=total // 2, block_tokens=block)
    weights = mixing.source_weights(df.selectExpr("source", "cast(regexp_count(coalesce(text, ''), '\\\\S+') as long) n_tokens"), mix).collect()
    import math

    h = -sum(r.weight * math.log(r.weight) for r in weights if r.weight)
    assert abs(sum(r.weight for r in weights) - 1) < 1e-9
    assert abs(h / math.log(n) - 0.9) < 1e-6
    sums = {}
    for r in mixing.mix_sources(df, mix).collect():
        sums[r.source] = sums.get(r.source, 0) + r.n_tokens
    for r in weights:
        if r.tokens:
            assert r.quota <= sums.get(r.source, 0) <= r.quota + 2 * block
    assert mixing.mix_sources(df.limit(0), mix).count() == 0
    kept = mixing.mix_sources(df, mixing.Mix(max_repeats=1.0), keep=("text", "tokens"))
    assert kept.columns[-2:] == ["text", "tokens"]


# ---- toxicity --------------------------------------------------------------


def test_marginals_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(0)
    words = {"a": 1, "b": 2, "c": 3}
    m = toxicity.ToxicityModel(
        words, np.array([0, 2, 2, 0]), *(rng.normal(size=4) for _ in range(4)), rng.normal(size=(2, 2))
    )
    chains = toxicity.Chains(["a b c a x", "", "b. c b!"], words)
    got, pairs = chains.marginals(m, pairs=True)
    e = chains.scores(m)
    want, counts = [], np.zeros((2, 2))
    for lo, hi in ((0, 5), (5, 6), (6, 8)):
        z, mass = 0.0, np.zeros(hi - lo)
        some = np.zeros((2, 2))
        for y in range(2 ** (hi - lo)):
            bits = [y >> i & 1 for i in range(hi - lo)]
            s = sum(e[lo + i] for i, b in enumerate(bits) if b)
            s += sum(m.trans[p, q] for p, q in zip(bits, bits[1:]))
            w = np.exp(s)
            z += w
            mass += w * np.array(bits)
            for p, q in zip(bits, bits[1:]):
                some[p, q] += w
        want += list(mass / z)
        counts += some / z
    assert np.allclose(got, want) and np.allclose(pairs, counts)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            for w in rng.sample(["vile", "foul", "grim"], 2):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = df.select("doc_id", "label")
    labels = labels.union(spark.createDataFrame([(None, 1), (1, None), (0, 0), (99999, 1)], labels.schema))
    model = toxicity.fit(df.drop("label"), labels, F.col("doc_id") % 2 == 0, train_docs=160)
    odd = [(7001, None, 0), (7002, "", 0), (7003, "w1 " * 20000 + "vile foul", 1), (None, "vile. foul", 1)]
    rest = df.filter("doc_id % 2 = 1").union(spark.createDataFrame(odd, df.schema))
    got = toxicity.score(rest.withColumn("score", F.lit("clash")), model, keep=("label",)).collect()
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == bool(r.label) for r in got)
    found = {r.doc_id: r for r in got}
    assert [(s.start, s.end) for s in found[7003].spans] == [(60000, 60009)]
    assert [(s.start, s.end) for s in found[None].spans] == [(0, 4), (6, 10)]
    nothing = toxicity.fit(df.limit(0), labels, F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score(rest, nothing).collect())
    assert toxicity.score(df.limit(0), model).count() == 0


# ---- personal data ---------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            n = len(re.sub("[^0-9]", "", m.group()))
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= n <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group())),
                "phone": 9 <= n <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    parts = ["1", "12", "255", ".", "..", "+", "-", " ", "(", ")", "@", "a", "b-c", ".com", "4111 1111 1111 1111", "é", "+1 (555) 555-0100", "\n", "%", "x@y.z"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == base_brute(text), text
    for text in ("1" * 50000, "a@" * 20000, "1." * 30000, "+1" * 20000, "a" * 50000 + "@", "+1" + " " * 50000):
        pii.base_spans(text)  # linear: a quadratic step would not end here


def test_semi_markov_sums_equal_brute_force():
    import numpy as np

    text = "call +1 (555) 555-0100 4111"
    region = pii.regions(text)[0]
    model = pii.Field()
    lat = pii.lattice(text, region, model.features, grow=True)
    rng = np.random.default_rng(1)
    model.weights = rng.normal(size=(len(model.features), 4)) * 0.3
    model.trans = rng.normal(size=(5, 5))
    scores = pii._potentials(model, lat)
    paths = []

    def walk(i, before, score, path):
        if i == lat.n:
            paths.append((score, path))
            return
        for at, seg in enumerate(lat.segments):
            if seg[0] == i:
                for y in range(5):
                    if np.isfinite(scores[at][y]):
                        walk(i + seg[1], y, score + model.trans[before, y] + scores[at][y], [*path, (at, y)])

    walk(0, 0, 0.0, [])
    z = sum(np.exp(s) for s, _ in paths)
    want = np.zeros((len(lat.segments), 5))
    for s, path in paths:
        for at, y in path:
            want[at, y] += np.exp(s) / z
    assert np.allclose(pii.posteriors(model, lat, scores)[0], want)
    assert pii.best_path(model, lat, scores) == max(paths, key=lambda p: p[0])[1]


def test_personal_data_table(spark):
    rows = [(i, f"mail me at u{i}@mail{i % 9}.example.com or +1 (555) 555-{1000 + i} version {i}.0", 1) for i in range(300)]
    rows += [(i, f"order 12345{i} and ip 10.0.{i % 256}.{i % 200} card 4111 1111 1111 1111 now", 1) for i in range(300, 600)]
    rows += [(601, None, 1), (602, "", 1), (603, "word " * 30000 + "a@b.co", 1), (None, "a@b.co", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = pii.find_personal_data(df, pii.fit(df)).collect()
    for r in got:
        text = {x[0]: x[1] for x in rows}[r.doc_id] or ""
        assert [(s.start, s.end, s.kind) for s in r.spans] == base_brute(text)
        assert all(a.end <= s.start or s.end <= a.start for a in r.added for s in r.spans)
    assert sum(len(r.added) for r in got) == 0  # nothing looks like a missed one here
    # no base pattern takes an umlaut domain; as a whole span it looks like the other addresses
    looks = spark.createDataFrame([(1, "write to u5@mäil3.example.com now")], "doc_id long, text string")
    one = pii.find_personal_data(looks, pii.fit(df)).first()
    assert one.spans == [] and [(a.kind, a.start, a.end) for a in one.added] == [("email", 9, 29)]
    assert pii.find_personal_data(df, pii.fit(df.limit(0))).count() == len(rows)
