"""Rule patterns in the Java dialect, and the parts of a pattern to keep.

Rules are written in the common dialect of linear-time engines (named groups
as ``(?P<name>..)``, Unicode classes, ``$`` at the very end).  Spark uses
``java.util.regex``; the functions here restate a pattern for it.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from re import _constants as C
from re import _parser

FLAGS = "(?dU)"  # newline is the only line end; \w \d \s \b are Unicode

# POSIX class names and their ASCII members.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F",
    "blank": "\\t ", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0B\\f\\r ",
    "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


class UnsupportedPattern(ValueError):
    """The pattern has no exact Java form here."""


def walk(pattern: str) -> Iterator[tuple[int, str, int, bool]]:
    """Yield (position, token, depth, inside_class); escapes are one token."""
    i, depth, in_class = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            yield i, pattern[i : i + 2], depth, in_class
            i += 2
            continue
        if in_class:
            posix = re.match(r"\[:\^?(\w+):\]", pattern[i:]) if c == "[" else None
            if posix:
                yield i, posix.group(0), depth, True
                i += len(posix.group(0))
                continue
            if c == "]":
                in_class = False
            yield i, c, depth, True
        elif c == "[":
            in_class = True
            yield i, c, depth, True
            # a first "]" (or "^]") is a member of the class
            for lead in ("^]", "]", "^"):
                if pattern.startswith(lead, i + 1):
                    for k, ch in enumerate(lead):
                        yield i + 1 + k, "\\]" if ch == "]" else ch, depth, True
                    i += len(lead)
                    break
        else:
            if c == ")":
                depth -= 1
            yield i, c, depth, False
            if c == "(":
                depth += 1
        i += 1


def leading_flags(pattern: str) -> tuple[str, str]:
    m = re.match(r"(?:\(\?[a-z]+\))+", pattern)
    return (m.group(0), pattern[m.end() :]) if m else ("", pattern)


def to_java(pattern: str) -> str:
    """The pattern for java.util.regex, without the common flag prefix."""
    if re.search(r"\(\?[a-z]*[uUR]|\(\?[a-z]*-[a-z]*[uUR]", pattern):
        raise UnsupportedPattern("flags u, U and R are not supported")
    multiline = bool(re.search(r"\(\?[a-z]*m", pattern))
    out: list[str] = []
    skip_to = 0
    for i, tok, _, in_class in walk(pattern):
        if i < skip_to:
            continue
        if not in_class and tok == "(":
            named = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if named:
                out.append("(?<secret>" if named.group(1) == "secret" else "(")
                skip_to = i + len(named.group(0))
                continue
        if in_class and tok.startswith("[:"):
            negated = tok.startswith("[:^")
            name = tok.strip("[]:^")
            if negated or name not in _POSIX:
                raise UnsupportedPattern(f"class {tok} is not supported")
            out.append(_POSIX[name])
        elif not in_class and tok == "$" and not multiline:
            out.append("\\z")
        else:
            out.append(tok)
    return "".join(out)


_LEADING_RUN = re.compile(r"((?:\(\?[a-z]+\))*)\\b(\[(?:[^\[\]\\&]|\\[^pPdDwWsS])+\])\+(@|:)(?![*+?{|])")


def _run_tried_once(java: str) -> str | None:
    """``\\b[run]+@rest`` so that a run of n characters is scanned once and not from each of its boundaries.

    If a match begins in a run, one begins at the run's first word boundary
    (after the match before, if that ended in the run): both reach the same
    end of the run.  What comes before the boundary is not part of the value.
    """
    m = _LEADING_RUN.match(java)
    if m is None or "|" in re.sub(r"\[(?:[^\]\\]|\\.)*\]|\([^()]*\)|\\.", "", java):
        return None
    flags, run, mark = m.groups()
    if re.fullmatch(run, mark):
        return None
    return f"{flags}(?:(?<!{run})|\\G)(?>(?<pre>{run}*?)\\b)(?<secret>{run}++{mark}{java[m.end() :]})"


def has_secret_group(pattern: str) -> bool:
    return bool(re.search(r"\(\?P?<secret>", pattern))


def locating_regex(pattern: str) -> tuple[str, str]:
    """(Java regex, replacement) that frames each match for ``locate_marked``.

    The replacement writes a record separator, then the fields
    ``aux | text before the value | value | text after it``.
    """
    java = to_java(pattern)
    if "(?<secret>" not in java:
        once = _run_tried_once(java)
        if once is not None:
            return FLAGS + once, "\x01\x02${pre}\x02${secret}\x02"
        return FLAGS + java, "\x01\x02\x02$0\x02"
    flags, body = leading_flags(java)
    open_at = close_at = None
    for i, tok, depth, in_class in walk(body):
        if in_class:
            continue
        if tok == "|" and depth == 0:
            raise UnsupportedPattern("a secret group needs one top-level branch")
        if tok == "(" and body.startswith("(?<secret>", i):
            if depth != 0 or open_at is not None:
                raise UnsupportedPattern("the secret group must be at top level, once")
            open_at = i
        if tok == ")" and depth == 0 and open_at is not None and close_at is None:
            close_at = i
    before, group, after = body[:open_at], body[open_at : close_at + 1], body[close_at + 1 :]
    if after[:1] in ("*", "+", "?", "{"):
        raise UnsupportedPattern("the secret group must not be repeated or optional")
    return (
        f"{FLAGS}{flags}(?<pre>{before}){group}(?<post>{after})",
        "\x01\x02${pre}\x02${secret}\x02${post}",
    )


def java_regex(pattern: str) -> str:
    return FLAGS + to_java(pattern)



#: Characters by which classes are compared.
PROBE = [chr(c) for c in range(1, 0x180)] + ["\u0660", "\u4e2d", "\u2028"]


def members(op, arg) -> frozenset[str] | None:
    """Probe characters a one-character element takes; None for any other element."""
    if op is C.LITERAL:
        return frozenset(chr(arg))
    if op is C.NOT_LITERAL:
        return frozenset(PROBE) - {chr(arg)}
    if op is C.ANY:
        return frozenset(PROBE)
    if op is not C.IN:
        return None
    tests = {
        C.CATEGORY_DIGIT: str.isdecimal, C.CATEGORY_SPACE: str.isspace,
        C.CATEGORY_WORD: lambda c: c.isalnum() or c == "_",
    }
    tests |= {
        C.CATEGORY_NOT_DIGIT: lambda c: not c.isdecimal(), C.CATEGORY_NOT_SPACE: lambda c: not c.isspace(),
        C.CATEGORY_NOT_WORD: lambda c: not (c.isalnum() or c == "_"),
    }
    out: set[str] = set()
    negated = False
    for kind, value in arg:
        if kind is C.NEGATE:
            negated = True
        elif kind is C.LITERAL:
            out.add(chr(value))
        elif kind is C.RANGE:
            out |= {c for c in PROBE if value[0] <= ord(c) <= value[1]}
        else:
            test = tests.get(value)
            out |= set(filter(test, PROBE)) if test else set(PROBE)
    return frozenset(PROBE) - out if negated else frozenset(out)
