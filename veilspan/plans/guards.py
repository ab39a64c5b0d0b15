"""Cheap necessary conditions for a pattern, derived from its own syntax.

A guard never changes results: it is a condition every match must meet.

* literals: one of a few lower-case ASCII strings occurs in the text.  All
  literals of all rules are found in one regex pass (``literals_in``).
* runs: the text has a stretch of characters of one class (digits, capitals and
  digits, hex, letters and digits) with at least n of them.  The longest run of
  each class is measured once per document (``longest_run``).
* beyond: every match holds a character that a plain text (``PLAIN``: letters,
  digits, blanks, ``+``, ``/`` and padding, as a base64 text) does not have there.
* signs: the text has one of these strings, for patterns written by hand.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.build import lit
from veilspan.functions.arrays import empty_array, let
from veilspan.functions.regex import UnsupportedPattern, members, to_java, walk

MAX_ALTERNATIVES = 12
MIN_LITERAL = 3
MAX_LITERAL = 100
MAX_FIRST = 32  # a look-ahead for more characters rules out too little
WIDE = "\\x{130}\\x{131}\\x{17F}\\x{660}-\\x{10FFFF}"  # every digit and case partner outside ASCII; may over-count
_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\r\f\v"


@dataclass(frozen=True)
class RunClass:
    members: frozenset[str]
    java: str
    separators: frozenset[str]
    java_separators: str
    minimum: int  # shorter runs are not worth a test


_SEPARATORS = frozenset(" \t\n\r\f\v./()+-:<")
# single characters below U+0100 are one table in a Java class; ranges are tested one after the other
_JAVA_SEPARATORS = " \\t\\n\\x0B\\f\\r\\x85\\xA0./()+:<\\-"
RUN_CLASSES = {
    "digit": RunClass(frozenset(_DIGITS), _DIGITS, _SEPARATORS, _JAVA_SEPARATORS, 4),
    "upper": RunClass(frozenset(_DIGITS + _UPPER), _DIGITS + _UPPER, _SEPARATORS, _JAVA_SEPARATORS, 6),
    # without separators, as prose with its numbers and sentence ends has few of them
    "number": RunClass(frozenset(_DIGITS + "."), _DIGITS + ".", frozenset(), "", 6),
    "capital": RunClass(frozenset(_DIGITS + _UPPER + "<"), _DIGITS + _UPPER + "<", frozenset(), "", 6),
    "hex": RunClass(frozenset(_DIGITS + "ABCDEFabcdef:-."), _DIGITS + "ABCDEFabcdef:.\\-", frozenset(), "", 12),
    "token": RunClass(
        frozenset(_DIGITS + _UPPER + _UPPER.lower() + "_-+/=."),
        _DIGITS + _UPPER + _UPPER.lower() + "_+/=.\\-", frozenset(), "", 16,
    ),
}
# a text below both has none of the literals of rules that need one of them
RARE_RUNS = {"digit": 6, "token": 16}
_PLAIN = frozenset(_DIGITS + _UPPER + _UPPER.lower() + "+/ ")
PLAIN = f"\\A[{''.join(sorted(_PLAIN))}]*+={{0,2}}\\z"
# a word goes from blank to blank; short words of these characters alone are left out of ``told_words``
WORD = 12
_COMMON = frozenset(_UPPER + _UPPER.lower() + ",.;!?'\"()-")
_MARKS = frozenset(map(chr, range(33, 127))) - _COMMON
_BLANKS = frozenset(" \t\n\r\f\v\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))
JAVA_BLANKS = " \\t\\n\\x0B\\f\\r\\x85\\xA0"
_JAVA_COMMON = "".join(f"\\x{ord(c):02x}" for c in sorted(_COMMON | frozenset(map(chr, range(0xC0, 0x100)))))


@dataclass(frozen=True)
class Guard:
    literals: tuple[str, ...] = ()
    runs: dict[str, int] = field(default_factory=dict, hash=False)
    beyond: bool = False
    signs: tuple[str, ...] = ()


def _chars(op, arg, digits: bool = True) -> frozenset[str] | None:
    """The characters of a one-character element, or None if not enumerable.

    ``digits``: a digit class counts as its ASCII members, where others are measured along.
    """
    if op is C.LITERAL:
        return frozenset(chr(arg))
    if op is not C.IN:
        return None
    out: set[str] = set()
    for kind, value in arg:
        if kind is C.LITERAL:
            out.add(chr(value))
        elif kind is C.RANGE and value[1] - value[0] <= 64:
            out.update(chr(x) for x in range(value[0], value[1] + 1))
        elif kind is C.CATEGORY and value is C.CATEGORY_DIGIT and digits:
            out.update(_DIGITS)
        elif kind is C.CATEGORY and value is C.CATEGORY_SPACE:
            out.update(_SPACE)
        else:
            return None
    return frozenset(out)


def _inlined(seq) -> Iterator[tuple]:
    """The elements of a sequence, those of its plain groups among them."""
    for op, arg in seq:
        if op is C.SUBPATTERN and not any(o is C.BRANCH for o, _ in arg[3]):
            yield from _inlined(arg[3])
        else:
            yield op, arg


def _literals(seq) -> list[tuple[str, ...]]:
    """Sets of alternatives; each set has a member in every match of ``seq``."""
    found: list[tuple[str, ...]] = []
    run: list[str] = [""]

    def flush() -> None:
        nonlocal run
        if run != [""]:
            found.append(tuple(run))
        run = [""]

    for op, arg in _inlined(seq):
        if op is C.AT:
            continue
        chars = _chars(op, arg, digits=False)
        if chars and all(32 < ord(c) < 127 for c in chars):
            options = sorted({c.lower() for c in chars})
            if len(options) * len(run) <= MAX_ALTERNATIVES:
                run = [a + b for a, b in product(run, options)]
                continue
        flush()
        if op is C.SUBPATTERN:
            found += _literals(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            found += _literals(arg[2])
        elif op is C.BRANCH:
            options = [_best(_literals(branch)) for branch in arg[1]]
            if all(options):
                merged = tuple(dict.fromkeys(x for o in options for x in o))
                if len(merged) <= MAX_ALTERNATIVES:
                    found.append(merged)
    flush()
    return found


def _best(options: list[tuple[str, ...]]) -> tuple[str, ...]:
    def score(o: tuple[str, ...]):
        words = min(sum(c.isalpha() or c in "_-" for c in x) for x in o)
        return min(len(x) for x in o), words, -len(o)

    return max(options, key=score, default=())


def _run(seq, cls: RunClass, fold: bool) -> tuple[bool, int, int]:
    """(all inside class and separators, members it must have, longest inside)."""
    inside, current, best = True, 0, 0

    def breaks() -> None:
        nonlocal inside, current, best
        inside, best, current = False, max(best, current), 0

    for op, arg in seq:
        if op is C.AT:
            continue
        chars = _chars(op, arg)
        if chars is not None:
            if fold:
                chars = frozenset(x for c in chars for x in (c.lower(), c.upper()))
            if chars <= cls.members:
                current += 1
            elif not chars <= (cls.members | cls.separators):
                breaks()
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.SUBPATTERN):
            low, inner = (1, arg[3]) if op is C.SUBPATTERN else (arg[0], arg[2])
            ok, n, deep = _run(inner, cls, fold)
            if low:
                best = max(best, deep)
            if ok:
                current += low * n
            else:
                breaks()
        elif op is C.BRANCH:
            parts = [_run(branch, cls, fold) for branch in arg[1]]
            best = max(best, min(p[2] for p in parts))
            if all(p[0] for p in parts):
                current += min(p[1] for p in parts)
            else:
                breaks()
        else:
            breaks()
    return inside, current, max(best, current)


def _beyond(seq, after: int = 0) -> bool:
    """Whether every match of ``seq``, with ``after`` more characters behind it, holds a character no plain text has there.

    Behind a ``=`` of a plain text is one more character at most.
    """
    items = list(seq)
    for i, (op, arg) in enumerate(items):
        rest = after + _parser.SubPattern(seq.state, items[i + 1 :]).getwidth()[0]
        if op is C.BRANCH:
            parts = [_beyond(branch, rest) for branch in arg[1]]
        elif op is C.SUBPATTERN:
            parts = [_beyond(arg[3], rest)]
        elif op is C.ATOMIC_GROUP:
            parts = [_beyond(arg, rest)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            parts = [arg[0] >= 1 and _beyond(arg[2], rest)]
        else:
            chars = _chars(op, arg)
            known = bool(chars) and all(c.isascii() for c in chars)
            parts = [known and chars.isdisjoint(_PLAIN) and ("=" not in chars or rest >= 2)]
        if all(parts):
            return True
    return False


def _blank_free(op, arg) -> bool:
    """A one-character element that takes no blank."""
    if op is C.LITERAL:
        return chr(arg) not in _BLANKS
    if op is not C.IN:
        return False
    if arg[0][0] is C.NEGATE:
        return (C.CATEGORY, C.CATEGORY_SPACE) in arg
    for kind, value in arg:
        if kind is C.LITERAL:
            ok = chr(value) not in _BLANKS
        elif kind is C.RANGE:
            ok = not any(value[0] <= ord(b) <= value[1] for b in _BLANKS)
        else:
            ok = kind is C.CATEGORY and value in (C.CATEGORY_DIGIT, C.CATEGORY_WORD, C.CATEGORY_NOT_SPACE)
        if not ok:
            return False
    return True


def _in_word(seq) -> bool:
    """No part of the sequence takes a blank or tells a blank from the end of the text."""
    for op, arg in seq:
        if op is C.AT:
            ok = arg in (C.AT_BOUNDARY, C.AT_NON_BOUNDARY)
        elif op is C.BRANCH:
            ok = all(map(_in_word, arg[1]))
        elif op is C.SUBPATTERN:
            ok = _in_word(arg[3])
        elif op is C.ATOMIC_GROUP:
            ok = _in_word(arg)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            ok = _in_word(arg[2])
        elif op in (C.ASSERT, C.ASSERT_NOT):
            ok = _in_word(arg[1])
        else:
            ok = _blank_free(op, arg)
        if not ok:
            return False
    return True


def _has_mark(seq) -> bool:
    """Every match of the sequence holds one of ``_MARKS``."""
    for op, arg in seq:
        if op is C.BRANCH:
            parts = [_has_mark(branch) for branch in arg[1]]
        elif op is C.SUBPATTERN:
            parts = [_has_mark(arg[3])]
        elif op is C.ATOMIC_GROUP:
            parts = [_has_mark(arg)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            parts = [arg[0] >= 1 and _has_mark(arg[2])]
        else:
            chars = _chars(op, arg)
            parts = [bool(chars) and chars <= _MARKS]
        if all(parts):
            return True
    return False


def _letterless(seq) -> bool:
    """No part of the sequence takes an ASCII letter."""
    for op, arg in seq:
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if op is C.BRANCH:
            ok = all(map(_letterless, arg[1]))
        elif op is C.SUBPATTERN:
            ok = _letterless(arg[3])
        elif op is C.ATOMIC_GROUP:
            ok = _letterless(arg)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            ok = _letterless(arg[2])
        else:
            chars = _chars(op, arg)
            ok = chars is not None and not any(c.isalpha() for c in chars)
        if not ok:
            return False
    return True


def word_bound(pattern: str) -> tuple[bool, bool, bool]:
    """Whether each match lies in one word and hangs on nothing outside it, whether it lies in one of ``told_words``,
    and whether it has no ASCII letter."""
    tree = None if re.search(r"\\[pP]", pattern) else _tree(_as_python(pattern))
    if tree is None:
        return False, False, False
    in_word = _in_word(tree)
    return in_word, in_word and (tree.getwidth()[0] >= WORD or _has_mark(tree)), _letterless(tree)


def told_words(text: Column) -> Column:
    """A framed text (``locate_marked``) of its words with a mark, a character beyond Latin-1 or ``WORD`` characters.

    The last word may be any or none.  What lies between is read once and without a way back.
    """
    between = f"[{JAVA_BLANKS}]*+(?:[{_JAVA_COMMON}]{{1,{WORD - 1}}}+[{JAVA_BLANKS}]++)*+"
    regex = f"(?<pre>{between})(?<run>[^{JAVA_BLANKS}]++|\\z)"
    return F.regexp_replace(text, lit(regex), lit("\x01\x02${pre}\x02${run}\x02"))


def _as_python(pattern: str) -> str | None:
    """The translated pattern as this parser reads it, or None where the two dialects may part."""
    try:
        java = to_java(pattern)
    except UnsupportedPattern:
        return None
    open_set, last = False, ""
    for _, token, _, in_class in walk(java):
        if in_class and not open_set:
            open_set = True
        elif open_set:
            if token == "[" or token == last == "&":
                return None  # nested sets and set operations
            open_set = token != "]"
        last = token
    if re.search(r"\\[vhHVRXGNkQEec0-9]|\\x\{|\(\?[a-zA-Z]*x|\(\?\(", java):
        return None
    java = java.replace("(?<secret>", "(?P<secret>").replace("\\z", "\\Z")
    return re.sub(r"\\[pP](?:\{\w+\}|\w)", r"\\w", java)


def _tree(plain: str | None):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _parser.parse(plain) if plain is not None else None
    except (re.error, Warning, OverflowError, RecursionError):
        return None


def _options(tree) -> list[tuple[str, ...]]:
    """The sets of literals of a pattern; the beginning of a long literal is a condition too."""
    return [tuple(dict.fromkeys(x[:MAX_LITERAL] for x in o)) for o in _literals(tree)]


def _usable(literal: tuple[str, ...]) -> bool:
    short = bool(literal) and min(map(len, literal)) < MIN_LITERAL
    return bool(literal) and (not short or len(literal) == 1 and not literal[0].isalnum())


def literal_counts(patterns: Iterable[str]) -> Counter[str]:
    """How many of the patterns each literal could stand for."""
    counts: Counter[str] = Counter()
    for pattern in patterns:
        tree = _tree(_as_python(pattern))
        if tree is not None:
            counts.update({x for o in _options(tree) for x in o})
    return counts


def guard_for(pattern: str, counts: Counter[str] | None = None) -> Guard:
    """Derive the guard of a rule pattern; an empty guard lets every text in.

    With ``counts``, literals that the fewest patterns share are taken.
    """
    plain = _as_python(pattern)
    tree = _tree(plain)
    if tree is None:
        return Guard()
    options = _options(tree)
    if counts is not None:
        options = [o for o in options if _usable(o)]
        few = min((sum(counts[x] for x in o) for o in options), default=0)
        options = [o for o in options if sum(counts[x] for x in o) == few]
    literal = _best(options)
    if not _usable(literal):
        literal = ()
    fold = bool(tree.state.flags & re.IGNORECASE or re.search(r"\(\?[a-zA-Z]*i", plain))
    runs = {name: _run(tree, cls, fold)[2] for name, cls in RUN_CLASSES.items()}
    runs = {k: n for k, n in runs.items() if n >= RUN_CLASSES[k].minimum}
    if literal or runs.get("digit", 0) >= 8:
        runs.pop("upper", None)
    if literal and len(min(literal, key=len)) >= MIN_LITERAL:
        for name in ("number", "capital", "hex"):
            runs.pop(name, None)
    return Guard(literals=literal, runs=runs, beyond=_beyond(tree))


def _first(seq) -> tuple[frozenset[str], bool] | None:
    """(ASCII characters a sequence can begin with, whether it can be empty); None if unknown."""
    out: frozenset[str] = frozenset()
    for op, arg in seq:
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if op is C.BRANCH:
            parts = [_first(branch) for branch in arg[1]]
        elif op is C.SUBPATTERN:
            parts = [_first(arg[3])]
        elif op is C.ATOMIC_GROUP:
            parts = [_first(arg)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            parts = [_first(arg[2])]
        else:
            chars = members(op, arg)
            parts = [None if chars is None else (chars, False)]
        if None in parts:
            return None
        out |= frozenset().union(*(p[0] for p in parts))
        empty = any(p[1] for p in parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            empty = empty or arg[0] == 0
        if not empty:
            return out, False
    return out, True


def first_characters(pattern: str) -> str:
    """A look-ahead that every match of a pattern meets at its beginning; '' where it is not known or of no use.

    Any character outside ASCII may begin a match, so the look-ahead does not
    depend on case folding or classes beyond it.
    """
    plain = _as_python(pattern)
    tree = _tree(plain)
    known = _first(tree) if tree is not None else None
    if known is None or known[1] or re.search(r"\\[pP]", pattern):
        return ""
    chars = known[0]
    if tree.state.flags & re.IGNORECASE or re.search(r"\(\?[a-zA-Z]*i", plain):
        if any(not c.isascii() for c in chars):
            return ""
        chars = frozenset(x for c in chars for x in (c.lower(), c.upper()))
    elif tree[0][0] is C.LITERAL:
        return ""  # the engine searches for it by itself
    ascii_ = sorted(c for c in chars if c.isascii())
    if not ascii_ or len(ascii_) > MAX_FIRST:
        return ""
    return f"(?=[\\x00{''.join(f'\\x{ord(c):02x}' for c in ascii_)}\\x80-\\x{{10FFFF}}])"


def is_rare(guard: Guard) -> bool:
    """The rule needs a run that ordinary text does not have."""
    return any(guard.runs.get(k, 0) >= n for k, n in RARE_RUNS.items())


def quiet_test(guards: Sequence[Guard]) -> Callable[[bytes], bool]:
    """A test of bytes for plain texts that none of these guards lets in; they are the rules that are not ``beyond``."""
    words = [w.encode() for g in guards for w in g.literals]
    plain, runs = "".join(_PLAIN).encode(), []
    for g in guards:
        if not g.literals:
            cls, n = min(((RUN_CLASSES[c], n) for c, n in g.runs.items()), key=lambda r: len(r[0].members | r[0].separators), default=(None, 0))
            inside = plain if cls is None else "".join((cls.members | cls.separators) & _PLAIN).encode()
            runs.append((bytes(b in inside for b in range(256)), b"\x01" * n))

    def quiet(text: bytes) -> bool:
        core = text.rstrip(b"=")
        if len(text) - len(core) > 2 or core.translate(None, plain):
            return False
        low = text.lower()
        return not any(w in low for w in words) and not any(run in text.translate(inside) for inside, run in runs)

    return quiet


def plain_gate(guards: Sequence[Guard]) -> str:
    """A regex for what a plain text holds if one of these guards, all with literals or all without, lets it in."""

    def any_of(chars: Iterable[str]) -> str:
        return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"

    if guards[0].literals:
        words = [w for g in guards for w in g.literals]
        size = min(map(len, words))
        return "".join(any_of(x for w in words for x in (w[k], w[k].upper())) for k in range(size))
    if not all(g.runs for g in guards):
        return ""
    runs = [min(((RUN_CLASSES[c], n) for c, n in g.runs.items()), key=lambda r: len(r[0].members | r[0].separators)) for g in guards]
    return any_of(x for cls, _ in runs for x in (cls.members | cls.separators) & _PLAIN) + f"{{{min(n for _, n in runs)}}}"


def lowered(text: Column) -> Column:
    """Lower case under which a case-insensitive ASCII literal must occur."""
    low = F.lower(F.replace(text, lit("İ"), lit("i")))
    folded = F.replace(F.replace(low, lit("ſ"), lit("s")), lit("ı"), lit("i"))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)


def longest_run(text: Column, name: str) -> Column:
    """Most members of a class in one stretch of members and separators.

    A text of ASCII alone is read with classes that are one table each.
    """
    cls = RUN_CLASSES[name]

    def stretches(wide: str) -> Column:
        head, tail = f"[{cls.java}{wide}]", f"[{cls.java}{cls.java_separators}{wide}]"
        once = f"(?<!{tail})" if not cls.java_separators else ""  # try each stretch once
        return F.regexp_extract_all(text, lit(f"{once}{head}{tail}{{{cls.minimum - 1},}}+"), lit(0))

    runs = F.when(F.octet_length(text) == F.char_length(text), stretches("")).otherwise(stretches(WIDE))
    if cls.java_separators:
        size = lambda r: F.char_length(F.regexp_replace(r, f"[{cls.java_separators}]+", ""))
    else:
        size = F.char_length
    return F.coalesce(F.array_max(F.transform(runs, size)), lit(0))


# ---- one pass over the text for all literals -----------------------------


def trie_regex(words: list[str]) -> str:
    """A regex for the longest of the words at a position, factored by prefix."""
    ends = "" in words
    by_first: dict[str, list[str]] = {}
    for w in words:
        if w:
            by_first.setdefault(w[0], []).append(w[1:])
    if not by_first:
        return ""
    arms = [(c, re.escape(c) + trie_regex(rest)) for c, rest in sorted(by_first.items())]
    body = _split(arms)
    if ends:
        return f"(?:{body})?"
    return f"(?:{body})" if len(arms) > 1 else body


def _split(arms: list[tuple[str, str]]) -> str:
    """Alternatives behind a look-ahead on halves of the first characters."""
    if len(arms) <= 4:
        return "|".join(a for _, a in arms)
    size = max(4, (len(arms) + 3) // 4)
    groups = [arms[i : i + size] for i in range(0, len(arms), size)]
    return "|".join(
        f"(?=[{''.join(re.escape(c) for c, _ in g)}])(?:{_split(g)})" for g in groups
    )


def literals_in(low: Column, literals: Iterable[str]) -> Column:
    """The distinct longest literals that start somewhere in a lower-cased text.

    The look-ahead finds overlapping occurrences; a literal that is a prefix of
    a found one is implied by it (see ``implied_by``).
    """
    words = sorted(set(literals))
    long = [w for w in words if len(w) >= MIN_LITERAL]
    # most places differ from all literals within the first characters, which are cheaper to test than the words
    first = "".join(f"[{''.join(re.escape(c) for c in sorted({w[k] for w in long}))}]" for k in range(MIN_LITERAL) if long)

    def parts(t: Column) -> Column:
        found = [F.when(F.contains(t, lit(w)), F.array(lit(w))).otherwise(empty_array("string")) for w in words if len(w) < MIN_LITERAL]
        if long:
            pattern = f"(?={first})(?=({trie_regex(long)}))"
            found.append(F.array_distinct(F.regexp_extract_all(t, lit(pattern), lit(1))))
        return F.concat(*found) if found else empty_array("string")

    return let(low, parts)


def told_by(literal: str, words: list[str]) -> list[str]:
    """The same over sorted words, where the extensions of a literal follow it."""
    end = at = bisect_left(words, literal)
    while end < len(words) and words[end].startswith(literal):
        end += 1
    return words[at:end]


def implied_by(literal: str, literals: Iterable[str]) -> list[str]:
    """Found literals that tell that ``literal`` occurs: itself and its extensions."""
    return [x for x in literals if x.startswith(literal)]
