"""Steps that were read or searched more often than the job needs."""

import base64
import random

from pyspark.sql import functions as F

from veilspan.operators import deep


def _encoded(text, times):
    for _ in range(times):
        text = "blob " + base64.b64encode(text.encode()).decode()
    return text


def test_all_decoded_levels_come_from_one_reading(spark):
    plain = "login: user7 password: hunter7 and a line of ordinary words, é included"
    torn = base64.b64encode(bytes(range(256))).decode()  # no UTF-8
    flat = "A" * 400  # no entropy
    unpadded = base64.b64encode(plain.encode()).decode().rstrip("=")
    whole = "0123456789 abcdefghijklmnopqrstuvwxyz, ABCDEFGHIJKLMNOPQRSTUVWXYZ."[:66]
    dangling = base64.b64encode(whole.encode()).decode() + "Q"
    rows = [(1, _encoded(plain, 3)), (2, f"{torn} {flat} {unpadded} {unpadded}"), (3, None), (4, "none"), (5, dangling)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = deep.decoded_table(docs)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") == 1 and "Union" not in plan
    got = sorted((r.doc_id, r.depth, r.text, r.readable, r.binary) for r in table.collect())
    want = [(1, d, _encoded(plain, 3 - d), True, False) for d in (1, 2, 3)]
    want += [(2, 1, plain, True, False)] * 2 + [(5, 1, whole, True, False)]
    assert got == sorted(want)


PROSE = "In 1999 they paid 12.5, 13 and 14 (of 2001-2003) for it. A dad-faced bead cafe; IBM, NASA and UN agreed."
TRICKY = [
    PROSE,
    "mac 0A:1b:2C:3d:4E:5f and 0a1b.2C3d.4e5F, host 10.0.200.7.",
    "AB123456 X1234567Z 1234567WA P12345678 G12345678",
    "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\r\nL898902C36UTO7408122F1204159ZE184226B<<<<<10",
    "ÉAB123456 ٣٤ AB١٢٣٤٥٦ 10.0.٠.1 1٢34567W é4111 1111 1111 1111",
    "(555) 555-1234 +1 555 555 1234 dob: 1999-01-02 ſsn 078-05-1120",
    "",
]


def _candidates(spark, rows):
    from veilspan.operators import patterns
    from veilspan.sources.rules import load_catalog

    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return docs, load_catalog(spark), patterns


def test_prose_leaves_few_rules_to_run(spark):
    docs, catalog, patterns = _candidates(spark, [PROSE])
    names = {r.ord: r.name for r in catalog.select("ord", "name").collect()}
    left = {names[r.ord] for r in patterns.candidates(docs, catalog).collect()}
    assert len(left) <= 12, left
    assert not any("MRZ" in n or "MAC" in n or "IPv4" in n for n in left), left


def test_first_characters_and_runs_lose_no_match(spark):
    docs, catalog, patterns = _candidates(spark, TRICKY)
    got = sorted((r.doc_id, r.ord) for r in patterns.matched_rules(docs, catalog).collect())
    plain = catalog.select("ord", "regex").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    from veilspan.functions.regex import java_regex

    jvm = spark._jvm.java.util.regex.Pattern
    want = [(i, r.ord) for r in plain for p in [jvm.compile(java_regex(r.regex))] for i, t in texts.items() if p.matcher(t).find()]
    assert len(want) > 15 and got == sorted(want)


def test_first_characters_are_a_condition_of_the_pattern():
    from veilspan.plans.guards import first_characters

    for unknown in (r"", r"a?", r"[^a]b", r"\p{P}x", r".x", r"(?i)K|K", r"abc", r"(?:a|)[ab]*"):
        assert first_characters(unknown) == "", unknown
    assert first_characters(r"\b(?:x|\d)y") == "(?=[\\x00" + "".join(f"\\x{c:02x}" for c in sorted(b"x0123456789")) + "\\x80-\\x{10FFFF}])"
    assert "\\x41\\x61" in first_characters(r"(?i)\ba?a")


def test_plain_texts_lose_no_match(spark):
    """Rules kept off base64-like texts, in the prefilter and in the decoding worker, cannot match one."""
    from veilspan.operators import deep
    from veilspan.operators.patterns import candidates_of, compile_rule, matching_candidates
    from veilspan.plans.guards import PLAIN, guard_for, quiet_test

    assert guard_for(r"a\s*[:=]\s*\S{2}").beyond and not guard_for(r"a\s*[:=]\s*\S").beyond
    assert guard_for(r"(?:x:|y\.)z").beyond and not guard_for(r"(?:x:|y)z").beyond
    assert not guard_for(r"(?:a\.)?b").beyond and not guard_for(r"[^:]b").beyond and not guard_for("(?i)K").beyond

    words = ["card 4111111111111111", "4111 1111 1111 1111", "AC" + "0af9" * 8, "coolifytoken=", "key=", "pwd", "user", "x" * 30, "q+/", "b==", "password", ":", "\n", "'", "é", "-"]
    rng = random.Random(4)
    texts = ["".join(rng.choice([" ", "", "/"]) + rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(600)]
    rules = deep.probes(0).rules
    few = [r for r in rules if not r.guard.beyond]
    assert 0 < len(few) * 4 <= len(rules)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", F.col("text").rlike(PLAIN).alias("plain"), candidates_of(F.col("text"), rules).alias("cand"),
        matching_candidates(F.col("text"), F.array(*[F.lit(r.ord) for r in rules]), rules).alias("hit"),
    ).collect()
    quiet = quiet_test([r.guard for r in few])
    told = deep._telling(deep.probes(0))
    neighbours = {r.ord for r in rules if r.guard.signs == ("\n",)}  # need a second line, and are no finding without one
    for r in rows:
        # patterns written by hand are findings only beside a key word
        idle = {x.ord for x in rules if x.guard.signs and not any(w in r.text.lower() for w in x.guard.literals)}
        assert set(r.hit) - neighbours - idle <= set(r.cand), r.text
        assert not quiet(r.text.encode()) or r.plain and not set(r.hit) - neighbours, r.text
    assert any(r.plain and r.hit for r in rows) and any(quiet(r.text.encode()) for r in rows)
    blob = b"blob " + b"Zm9vYmFyYmF6" * 9 + b"=="
    assert not told(1, blob) and told(1, blob + b" 4111111111111111") and told(3, b"plain words.") and not told(4, b"plain words.")
    assert told(1, b"abandon " * 12)
    assert compile_rule(0, r"\bx\.y").guard.beyond
