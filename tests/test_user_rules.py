"""User rules: files, validation, ambiguity."""

import pytest

from veilspan.functions.ambiguity import pattern_problem
from veilspan.operators import select
from veilspan.sources.fixed_rules import RULES
from veilspan.sources.rules import compile_errors, load_catalog, load_custom_patterns, save_custom_patterns, validate_rules

RULE = "name string, category string, severity string, regex string"


def test_built_in_rules_are_accepted():
    assert [r[1] for r in RULES if pattern_problem(r[4])] == []


@pytest.mark.parametrize(
    "pattern",
    ["(a|aa)+$", "(a*)*b", "(x+x+)+y", r"(\w+\s?)+!", "(a|a)*b", r"(?i)(k|K)+!", r"(\w|a)+b", "((a?)(a?))*b", r"(\d{2}|\d{3})*x", "(ab|aba|b)*c"],
)
def test_exponential_patterns(pattern):
    assert "exponentially" in pattern_problem(pattern)


@pytest.mark.parametrize("pattern", ["x*x*x*y", "x*" * 8 + "y", "a.*b.*c.*d", r"\s*\s+\s*z"])
def test_polynomial_patterns(pattern):
    assert "grows with about the power" in pattern_problem(pattern)


@pytest.mark.parametrize(
    "pattern",
    ["a+b+c+", "x*x*y", r"(\.[a-z]+)+", "(cat|dog)*x", "(.{1,50}\n)*x", r"\s*=\s*", "x++x*y", "(?:a?){3}b", "(?>a+)+b", "ab+c{2,}", "[aA]+"],
)
def test_harmless_patterns(pattern):
    assert pattern_problem(pattern) is None


def test_large_patterns():
    assert "states" in pattern_problem("[a-z]{1,65000}")
    assert "states" in pattern_problem("(?:[a-z]{100}){200}")
    assert "references" in pattern_problem(r"(b)\1")


def test_ambiguity_agrees_with_counting_ways():
    """The number of ways to read a^n, by brute force over the automaton, grows as told."""
    from veilspan.functions.ambiguity import _Budget, _components, _degree, _exponential, automaton

    def ways(pattern, n):
        a = automaton(pattern)
        bit = automaton("a").chars[1]
        now = {0: 1}
        for _ in range(n):
            nxt = {}
            for p, k in now.items():
                for q, m in a.follow[p].items():
                    if a.chars[q] & bit:
                        nxt[q] = nxt.get(q, 0) + k * m
            now = nxt
        return sum(now.values())

    for pattern, exponential, degree in [("a", False, 0), ("a*b", False, 1), ("a*a*b", False, 2), ("a*a*a*b", False, 3), ("(a|aa)*b", True, None), ("(aa)*b", False, 1), ("(a*)*b", True, None)]:
        a = automaton(pattern)
        comp = _components(a.follow)
        assert _exponential(a, comp, _Budget()) == exponential, pattern
        small, large = ways(pattern, 20), ways(pattern, 40)
        if exponential:
            assert large > 100 * small
        else:
            assert _degree(a, comp, _Budget()) == degree
            assert large / small < 1.1 * 2 ** degree


def test_files_of_rules(spark, tmp_path):
    rows = [(f"r{i}", "c", "high", r"k\d+") for i in range(30)] + [("bad", "c", "low", "(a|aa)+$"), ("open", "c", "low", "(a"), ("none", "c", "low", None)]
    path = str(tmp_path / "rules")
    save_custom_patterns(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RULE + ", pos long"), path)
    for _ in range(2):
        good, errors = load_custom_patterns(spark, path)
        assert [r["name"] for r in good.orderBy("pos").collect()] == [f"r{i}" for i in range(30)]
        assert {r["name"] for r in errors.collect()} == {"bad", "open", "none"}
    merged = select.merge_rules(load_catalog(spark).limit(2), good)
    assert [r["name"] for r in merged.orderBy("ord").collect()][2:] == [f"r{i}" for i in range(30)]
    (tmp_path / "empty.json").write_text("")
    assert [t.count() for t in load_custom_patterns(spark, str(tmp_path / "empty.json"))] == [0, 0]
    (tmp_path / "broken.json").write_text('{"name": "a", "category": "b", "severity": "low", "regex": "x"}\n{"name": \n')
    good, errors = load_custom_patterns(spark, str(tmp_path / "broken.json"))
    assert good.count() == 0 and [r["name"] for r in errors.collect()] == [None]
    with pytest.raises(Exception, match="No FileSystem"):  # not taken for a missing file
        load_custom_patterns(spark, "nosuchscheme-:/x y")


def test_only_bad_patterns_are_left_out(spark):
    patterns = [f"a{i}" for i in range(40)] + ["[z-a]", "(?<secret>x)?", "b*"]
    said = compile_errors(spark, patterns)
    assert {p for p, e in said.items() if e} == {"[z-a]", "(?<secret>x)?", "b*"}
    good, bad = validate_rules(spark.createDataFrame([(p, "c", "low", p) for p in patterns], RULE))
    assert good.count() == 40 and bad.count() == 3


def test_many_rules_of_which_many_do_not_compile(spark):
    kinds = [r"concat('k', id, '[0-9]+')", "concat('(open', id)", "concat('[a-z]{1,65000}', id)"]
    regex = f"CASE id % 3 WHEN 0 THEN {kinds[0]} WHEN 1 THEN {kinds[1]} ELSE {kinds[2]} END"
    made = spark.range(12_000).selectExpr("cast(id as string) AS name", "'c' AS category", "'low' AS severity", f"{regex} AS regex", "id AS pos")
    good, bad = validate_rules(made)
    assert good.count() == 4_000
    said = {r["said"]: r["count"] for r in bad.selectExpr("regexp_extract(error, ': (.*)', 1) AS said").groupBy("said").count().collect()}
    assert said == {"pattern does not compile": 4_000, "pattern has over 10000 states": 4_000}


def test_more_rules_than_branches_match_the_same(spark, monkeypatch):
    from veilspan.operators import patterns

    docs = spark.createDataFrame([(1, "see k17x and k3x, K4 then k170x"), (2, "none"), (3, "k59x\nk5x k5x")], "doc_id long, text string")
    rows = [(i, "custom", f"r{i}", "c", "High", rf"\bk(?P<secret>{i})x" if i % 2 else rf"(?i)k{i}\b", None, True, True, True) for i in range(60)]
    ddl = "ord int, bucket string, name string, category string, severity string, regex string, validator string, has_secret_group boolean, single_line boolean, softwrap boolean"
    catalog = spark.createDataFrame(rows, ddl)
    want = sorted(map(tuple, patterns.match_patterns(docs, catalog).collect()))
    monkeypatch.setattr(patterns, "BRANCHES", 5)
    monkeypatch.setattr("veilspan.functions.build.PARSED", 5)
    assert sorted(map(tuple, patterns.match_patterns(docs, catalog).collect())) == want and len(want) == 6
