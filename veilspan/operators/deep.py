"""Structural heuristics on a document's own row (DEEP1-DEEP11).

The patterns of all heuristics run in the same located pass as the rules
(``probes``); the functions here turn the located spans of a text into
findings ``struct<name,start,end>``.  A NULL span means "present, no place".
"""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import count_le, count_lt, let
from veilspan.functions.build import generated, lit, literals, reused
from veilspan.functions.regex import FLAGS, java_regex
from veilspan.functions.spans import byte_slice, line_of, line_starts, locate
from veilspan.functions.text import (
    PROXIMITY_WORDS,
    SECRET_KEY_WORDS,
    is_public_key_name,
    is_secret_key,
    shannon_entropy,
)
from veilspan.functions.validators import digits_only, luhn
from veilspan.operators.entropy import TOKEN_CLASS
from veilspan.operators.patterns import CompiledRule, candidates_of, compile_rule, locate_candidates, plain_rules
from veilspan.plans.guards import Guard, quiet_test, trie_regex
from veilspan.sources import fixed_deep as fx

DEEP = "struct<name:string,start:int,end:int>"
MAX_DEPTH = 3
MIN_MNEMONIC = 12

# every key word holds one of these
_KEY_STEMS = (
    "passw", "passphrase", "secret", "token", "key", "pwd", "pat", "auth", "bearer",
    "jwt", "credential", "twilio", "stripe", "service_account",
)
_PROXIMITY_STEMS = (
    "passw", "secret", "token", "key", "auth", "bearer", "jwt", "credential", "pem",
    "cert", "apisecret", "api_secret",
)


@dataclass(frozen=True)
class Probes:
    """Rule numbers of each heuristic's patterns within one rule list."""

    rules: tuple[CompiledRule, ...]
    key_value: range
    env: int
    connection: range
    credentials: range
    card: int
    proximity: int
    hosts: range


def _keyed(ord_: int, parts: Sequence[str], flags: str, guard: Guard) -> CompiledRule:
    lead, key, between, value, tail = parts
    java = f"{FLAGS}{flags}(?<pre>{lead}(?<key>{key}){between})(?<secret>{value})(?<post>{tail})"
    return CompiledRule(ord_, java, "\x01${key}\x02${pre}\x02${secret}\x02${post}", guard)


def _key_tried_once(parts: Sequence[str]) -> Sequence[str]:
    """A bare key starts at the first letter of its run of key characters, or of what the match before left of it.

    A later letter reaches the same end of the run, so it fails where the first
    fails; a long run is then read once and not from each of its letters.
    """
    lead, key, *rest = parts
    if lead or not key.endswith("[A-Za-z0-9_-]*"):
        return parts
    return ("(?:(?<![A-Za-z0-9_-])|\\G)[0-9-]*+", key + "+", *rest)


def probes(first: int) -> Probes:
    """The heuristics' patterns as rules numbered from ``first``."""
    rules: list[CompiledRule] = []

    def add(rule: Callable[[int], CompiledRule]) -> int:
        rules.append(rule(first + len(rules)))
        return rules[-1].ord

    def span(items, make) -> range:
        start = first + len(rules)
        for item in items:
            add(lambda o, item=item: make(o, item))
        return range(start, first + len(rules))


    def keys(*signs: str) -> Guard:
        # quotes, or a separator with eight characters behind it
        return Guard(literals=_KEY_STEMS, beyond=True, signs=signs)

    shapes = zip(map(_key_tried_once, fx.KEY_VALUE), (keys('"'), keys("'"), keys(":", "=")))
    key_value = span(shapes, lambda o, s: _keyed(o, s[0], "", s[1]))
    env = add(lambda o: _keyed(o, fx.ENV_LINE, "(?m)", keys("=")))
    connection = span(fx.CONNECTION, compile_rule)
    credentials = span([p for p, _ in fx.CREDENTIALS], compile_rule)
    card = add(lambda o: compile_rule(o, fx.CARD_NUMBER))
    near = f"{FLAGS}(?<!\\S){TOKEN_CLASS}{{14,}}(?!\\S)"
    # the key word is on another line
    proximity = add(
        lambda o: CompiledRule(
            o, near, "\x01\x02\x02$0\x02", Guard(literals=_PROXIMITY_STEMS, beyond=True, signs=("\n",)),
            in_word=True, told=True, around=True,
        )
    )
    hosts = span([h for _, h, _ in fx.HOST_GATED], compile_rule)
    return Probes(
        tuple(rules), key_value, env, connection, credentials, card, proximity, hosts
    )


def _in(s: Column, ords) -> Column:
    if isinstance(ords, range):
        return (s["ord"] >= ords.start) & (s["ord"] < ords.stop)
    return s["ord"] == ords


def _of(loc: Column, ords) -> Column:
    return F.filter(loc, lambda s: _in(s, ords))


def _found(name: Column | str, start: Column | None = None, end: Column | None = None) -> Column:
    none = lit(None).cast("int")
    return F.struct(
        (lit(name) if isinstance(name, str) else name).alias("name"),
        (none if start is None else start).alias("start"),
        (none if end is None else end).alias("end"),
    ).cast(DEEP)


def _none() -> Column:
    return F.expr(f"cast(array() as array<{DEEP}>)")


def _when(cond: Column, name: str) -> Column:
    return F.when(cond, F.array(_found(name))).otherwise(_none())


# ---- one function per heuristic ------------------------------------------


def _keyed_findings(loc: Column, ords, name: str) -> Column:
    def wanted(s: Column) -> Column:
        return _in(s, ords) & let(
            F.lower(s["aux"]), lambda k: is_secret_key(k) & ~is_public_key_name(k)
        )

    return F.transform(F.filter(loc, wanted), lambda s: _found(name, s["start"], s["end"]))


def kv_secrets(loc: Column, p: Probes) -> Column:
    """Key-value pairs whose key names a secret (DEEP1)."""
    return _keyed_findings(loc, p.key_value, "Secret Key-Value Pair")


def env_secrets(loc: Column, p: Probes) -> Column:
    """Lines KEY=value whose key names a secret (DEEP2)."""
    return _keyed_findings(loc, p.env, "Environment Variable Secret")


def connection_strings(loc: Column, p: Probes) -> Column:
    """At most one finding per connection pattern, no place (DEEP3)."""
    ords = F.array_distinct(F.transform(_of(loc, p.connection), lambda s: s["ord"]))
    return F.transform(ords, lambda o: _found("Connection String"))


def private_keys(text: Column) -> Column:
    """Private key blocks and public SSH keys, no place (DEEP5).

    A footer that comes before the header does not close it.
    """
    head, foot = java_regex(fx.KEY_HEADER), java_regex(fx.KEY_FOOTER)

    def blocks(t: Column) -> Column:
        start = F.regexp_instr(t, lit(head)) + F.length(F.regexp_substr(t, lit(head)))
        stop = F.regexp_instr(t, lit(foot))
        body = F.substr(t, start, stop - start)
        return (
            F.when(~t.rlike(head), _none())
            .when(~t.rlike(foot) | (stop < start), F.array(_found("Private Key (Incomplete)")))
            .otherwise(_when(body.rlike("(?U)\\S"), "Private Key"))
        )

    private = F.when(F.contains(text, lit("-----BEGIN")), blocks(text)).otherwise(_none())
    public = F.contains(text, lit("ssh-")) | F.contains(text, lit("ecdsa-sha2-"))
    both = F.concat(private, _when(public & text.rlike(java_regex(fx.SSH_PUBLIC)), "SSH Public Key"))
    return F.when(F.contains(text, lit("-")), both).otherwise(_none())


def credential_composites(loc: Column, p: Probes) -> Column:
    """User and password pairs and credentials in URLs (DEEP6)."""
    names = literals([n for _, n in fx.CREDENTIALS], "string")
    return F.transform(
        _of(loc, p.credentials),
        lambda s: _found(
            F.get(names, s["ord"] - lit(p.credentials.start)), s["start"], s["end"]
        ),
    )


def _window(lines: Column, raw: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """From the start of the line of ``start`` to the end of the line after ``end``'s."""
    first = F.get(lines, line_of(lines, start))
    after = F.get(lines, line_of(lines, end) + lit(2))
    return first, F.coalesce(after - lit(1), F.octet_length(raw))


def card_with_expiry(text: Column, loc: Column, p: Probes) -> Column:
    """A Luhn-valid card number with an expiry or CVV nearby (DEEP7)."""
    context = java_regex(fx.CARD_CONTEXT)

    def near(c: Column, s: Column) -> Column:
        start, stop = _window(c["lines"], c["raw"], s["start"], s["end"])
        return byte_slice(c["raw"], start, stop).rlike(context)

    numbers = F.filter(
        loc,
        lambda s: _in(s, p.card)
        & F.length(digits_only(s["value"])).between(13, 19)
        & luhn(s["value"]),
    )

    def check(cards: Column) -> Column:
        c = F.struct(line_starts(text).alias("lines"), text.cast("binary").alias("raw"))
        kept = let(c, lambda cc: F.filter(cards, lambda s: near(cc, s)))
        return F.when(F.size(cards) == 0, _none()).otherwise(
            F.transform(kept, lambda s: _found("Card PAN with Expiry/CVV", s["start"], s["end"]))
        )

    return let(numbers, check)


PAGE = 256


def json_blocks(text: Column) -> Column:
    """array<struct<start,end>>: outermost brace blocks outside strings (byte offsets).

    A block counts only when more than two braces were seen since the last
    block ended, so flat objects do not count.  A stray closing brace drives
    the depth below zero.
    """
    pieces = F.regexp_extract_all(text, lit('[{}"\\\\]|[^{}"\\\\]+'), lit(0))
    zero = F.expr(
        "named_struct('at', 0, 'depth', 0, 'quoted', false, 'escaped', false, 'open', 0, "
        "'braces', 0, 'blocks', cast(array() as array<struct<start:int,end:int>>), "
        "'full', cast(array() as array<array<struct<start:int,end:int>>>))"
    )

    def step(a: Column, piece: Column) -> Column:
        free = ~a["quoted"]
        opens, closes = free & (piece == "{"), free & (piece == "}")
        ends = closes & (a["depth"] == 1)
        after = a["at"] + F.octet_length(piece)
        depth = a["depth"] + opens.cast("int") - closes.cast("int")
        seen = a["braces"] + (opens | closes).cast("int")
        block = F.array(F.struct(a["open"].alias("start"), after.alias("end")))
        # copying a list for each block would be quadratic: they are put away by the page
        turn = F.size(a["blocks"]) >= PAGE
        page = F.when(turn, F.expr("cast(array() as array<struct<start:int,end:int>>)")).otherwise(a["blocks"])
        return F.struct(
            after.alias("at"),
            depth.alias("depth"),
            F.when((piece == '"') & ~a["escaped"], free).otherwise(a["quoted"]).alias("quoted"),
            ((piece == "\\") & a["quoted"] & ~a["escaped"]).alias("escaped"),
            F.when(opens & (a["depth"] == 0), a["at"]).otherwise(a["open"]).alias("open"),
            F.when(ends, lit(0)).otherwise(seen).alias("braces"),
            F.when(ends & (seen > 2), F.concat(page, block)).otherwise(page).alias("blocks"),
            F.when(turn, F.concat(a["full"], F.array(a["blocks"]))).otherwise(a["full"]).alias("full"),
        )

    return F.aggregate(
        pieces, zero, step, lambda a: F.concat(F.flatten(a["full"]), a["blocks"])
    )


def json_secrets(text: Column) -> Column:
    """High-entropy strings in nested JSON blocks that name a secret key (DEEP8)."""
    quoted_key = '"(?:' + "|".join(dict.fromkeys(SECRET_KEY_WORDS)) + ')"'
    strings = fx.JSON_STRING.replace("(", "(?P<secret>", 1)

    def of_block(raw: Column, b: Column) -> Column:
        def values(block: Column) -> Column:
            kept = F.filter(
                locate(block, strings), lambda s: shannon_entropy(s["value"]) > 3.5
            )
            return F.when(~F.lower(block).rlike(quoted_key), _none()).otherwise(
                F.transform(
                    kept,
                    lambda s: _found("JSON Secret", b["start"] + s["start"], b["start"] + s["end"]),
                )
            )

        return let(byte_slice(raw, b["start"], b["end"]), values)

    return F.when(
        F.contains(text, lit("{")) & F.lower(text).rlike(quoted_key),
        let(
            text.cast("binary"),
            lambda raw: F.flatten(F.transform(json_blocks(text), lambda b: of_block(raw, b))),
        ),
    ).otherwise(_none())


def proximity_secrets(text: Column, loc: Column, p: Probes) -> Column:
    """Tokens on the line before or after a line with a key word (DEEP9)."""
    words = "(?dU)(?i)\\b(?:" + "|".join(PROXIMITY_WORDS) + ")\\b"
    tokens = F.filter(
        loc,
        lambda s: _in(s, p.proximity)
        & (F.octet_length(s["value"]) >= 16)
        & (shannon_entropy(s["value"]) > 3.8),
    )

    def flagged(t: Column) -> Column:
        c = F.struct(
            line_starts(text).alias("lines"),
            F.transform(F.split(text, "\n"), lambda line: line.rlike(words).cast("int")).alias(
                "flags"
            ),
        )

        def copies(cc: Column, s: Column) -> Column:
            def near(j: Column) -> Column:
                before = F.coalesce(F.get(cc["flags"], j - lit(1)), lit(0))
                after = F.coalesce(F.get(cc["flags"], j + lit(1)), lit(0))
                return F.array_repeat(
                    _found("Proximity Secret", s["start"], s["end"]), before + after
                )

            return let(line_of(cc["lines"], s["start"]), near)

        return F.when(F.size(t) == 0, _none()).otherwise(
            let(c, lambda cc: F.flatten(F.transform(t, lambda s: copies(cc, s))))
        )

    return let(tokens, flagged)


def vendor_host_tokens(text: Column, loc: Column, p: Probes) -> Column:
    """First token shape near a vendor host or label, not overlapping it (DEEP10).

    Shapes hold no newline, so each shape is located once in the whole text and
    the window of an anchor is a range of its sorted starts.
    """
    shapes = list(dict.fromkeys(s for _, _, s in fx.HOST_GATED))
    names = literals([n for n, _, _ in fx.HOST_GATED], "string")
    shape_no = literals([shapes.index(s) for _, _, s in fx.HOST_GATED], "int")
    finders = [compile_rule(i, s) for i, s in enumerate(shapes)]

    def entry(s: Column) -> Column:
        return s["ord"] - lit(p.hosts.start)

    def pick(c: Column, spans: Column, a: Column) -> Column:
        def choose(starts: Column) -> Column:
            first, stop = _window(c["lines"], c["raw"], a["start"], a["end"])
            head = F.get(spans, count_lt(starts, first))
            tail = F.get(spans, count_lt(starts, a["end"]))
            chosen = F.when(head["end"] <= a["start"], head).otherwise(tail)
            return let(
                chosen,
                lambda s: F.when(
                    s["end"] <= stop,
                    F.array(_found(F.get(names, entry(a)), s["start"], s["end"])),
                ).otherwise(_none()),
            )

        return F.coalesce(let(F.transform(spans, lambda s: s["start"]), choose), _none())

    def near(anchors: Column) -> Column:
        needed = F.array_sort(
            F.array_distinct(F.transform(anchors, lambda a: F.get(shape_no, entry(a))))
        )
        c = F.struct(
            line_starts(text).alias("lines"),
            text.cast("binary").alias("raw"),
            locate_candidates(text, needed, finders).alias("shapes"),
        )

        def per_shape(cc: Column, k: Column) -> Column:
            spans = F.filter(cc["shapes"], lambda s: s["ord"] == k)
            mine = F.filter(anchors, lambda a: F.get(shape_no, entry(a)) == k)
            return let(
                spans, lambda sp: F.flatten(F.transform(mine, lambda a: pick(cc, sp, a)))
            )

        return F.when(F.size(anchors) == 0, _none()).otherwise(
            let(c, lambda cc: F.flatten(F.transform(needed, lambda k: per_shape(cc, k))))
        )

    return let(_of(loc, p.hosts), near)


def _listed_run(words: Sequence[str]) -> str:
    """A regex that a text with twelve listed words in a row matches; '' where words are not plain or too many."""
    # no token's lower case has a capital
    able = [w for w in words if not re.search("[A-Z]", w)]
    if not able or len(able) > WORDLIST_LIMIT or not all(re.fullmatch("[a-z]+", w) for w in able):
        return ""
    # as lower case does, the flags take the kelvin sign for a k
    listed = trie_regex(sorted(set(able)))
    word = f"[^A-Za-z\\s]*+(?i:{listed})(?![A-Za-z])\\S*+"
    return f"(?U)(?<!\\S)(?:{word}\\s++){{{MIN_MNEMONIC - 1}}}{word}"


def _in_turn(text: Column, *patterns: str) -> Column:
    """The text matches each of the patterns, tried in this order."""
    out = lit(True)
    for pattern in filter(None, patterns):
        out = out & text.rlike(pattern)
    return out


def mnemonic_runs(text: Column, words: Sequence[str]) -> Column:
    """Runs of twelve or more listed words (DEEP11).

    The tokens become one mark each, and the runs are found in the marks.
    """
    if not words:
        return _none()
    low, high = min(map(len, words)), max(map(len, words))
    word = f"[^A-Za-z\\s]*+[A-Za-z]{{{low},{high}}}+[^A-Za-z\\s]*+"
    likely = f"(?U)(?<!\\S)(?:{word}\\s++){{{MIN_MNEMONIC - 1}}}{word}"
    sure = _listed_run(words)

    def listed(value: Column) -> Column:
        core = F.lower(F.regexp_replace(value, "\\A[^A-Za-z]+|[^A-Za-z]+\\z", ""))
        return core.isin(list(words))

    def runs(tokens: Column) -> Column:
        marks = F.array_join(
            F.transform(tokens, lambda t: F.when(listed(t["value"]), "1").otherwise("0")), ""
        )
        return F.transform(
            locate(marks, f"1{{{MIN_MNEMONIC},}}"),
            lambda r: _found(
                "BIP39 mnemonic",
                F.get(tokens, r["start"])["start"],
                F.get(tokens, r["end"] - lit(1))["end"],
            ),
        )

    return F.when(_in_turn(text, sure, likely), let(locate(text, "\\S+"), runs)).otherwise(_none())


_BASE64_BYTES = re.compile(fx.BASE64_RUN.encode())
# single characters are one table, where ranges are tested one after the other
_BASE64 = string.ascii_letters + string.digits + "+/"
_PRINTABLE = bytes([*range(0x21, 0x7F), *b" \t\n\f\r"])
NODE = "struct<depth:int,parent:int,text:string,readable:boolean,binary:boolean>"


def decoded_nodes(text: Column, depth: int, wanted: Callable[[int, bytes], bool] = lambda level, inner: True) -> Column:
    """array<NODE>: the base64 texts inside a text, level after level; ``parent`` is a place within the level above.

    Only readable texts are read further; ``text`` is null for those not ``wanted``.  An entropy over each run's
    characters and the decoding are a pass over bytes in a worker; arrays of
    single characters cost some fifty times as much.
    """

    def decoded(text: bytes) -> Iterator[tuple[bytes, bool, bool]]:
        """(text, readable, binary) of each run of at least 4.5 bits a character that decodes to UTF-8.

        As ``lenient_base64`` does, a run is read up to its first ``=`` and without
        a dangling last symbol.
        """
        for run in _BASE64_BYTES.finditer(text):
            counts = np.bincount(np.frombuffer(run[0], "u1"))
            counts, size = counts[counts > 0], len(run[0])
            if np.log2(size) - (counts * np.log2(counts)).sum() / size < 4.5:
                continue
            core = run[0].rstrip(b"=")
            core = core[:-1] if len(core) % 4 == 1 else core
            inner = base64.b64decode(core + b"=" * (-len(core) % 4))
            try:
                inner.decode()
            except UnicodeDecodeError:
                continue
            n = len(inner)
            ratio = (n - len(inner.translate(None, _PRINTABLE))) / max(n, 1)
            yield inner, ratio > 0.7 and n > 10, 32 <= n <= 4096 and ratio < 0.3

    @F.arrow_udf(f"array<{NODE}>")
    def nodes(texts: pa.Array) -> pa.Array:
        ends, depths, parents, found = [0], [], [], []
        for value in texts.cast(pa.binary()):
            level = [(value.as_py(), True, False)] if value.is_valid else []
            for d in range(1, depth + 1):
                inner = [(i, node) for i, (t, readable, _) in enumerate(level) if readable for node in decoded(t)]
                level = [node for _, node in inner]
                depths += [d] * len(level)
                parents += [i for i, _ in inner]
                found += level
            ends.append(len(found))
        shown = [t if wanted(d, t) else None for d, (t, _, _) in zip(depths, found)]
        columns = [pa.array(depths, pa.int32()), pa.array(parents, pa.int32()), pa.array(shown, pa.binary()).cast(pa.string())]
        columns += [pa.array([node[k] for node in found], pa.bool_()) for k in (1, 2)]
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["depth", "parent", "text", "readable", "binary"])
        )

    return nodes(text)


def decoded_table(docs: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, depth, readable, binary, text): every base64 text inside a text, one row each, ``depth`` levels down.

    All levels of a document come from one reading of it, and no shuffle is needed.
    """
    found = docs.select("doc_id", F.inline_outer(decoded_nodes(F.col("text"), depth)))
    return found.filter("depth is not null").select("doc_id", "depth", "readable", "binary", "text")


def locate_deep(text: Column, p: Probes) -> Column:
    """Located spans of the deep patterns that the prefilter leaves for a decoded text."""
    return let(candidates_of(text, p.rules), lambda cand: locate_candidates(text, cand, p.rules))


def _telling(p: Probes) -> Callable[[int, bytes], bool]:
    """Which decoded texts the heuristics have to read: not the lowest level, nor encoded texts that no pattern can match."""
    few = plain_rules(p.rules)
    quiet = (lambda text: False) if few is None else quiet_test([r.guard for r in few])

    def telling(level: int, text: bytes) -> bool:
        # words of a seed phrase have blanks between them
        return level <= MAX_DEPTH and not (text.count(b" ") < MIN_MNEMONIC - 1 and quiet(text))

    return telling


def _before(loc: Column, p: Probes) -> Column:
    return F.concat(kv_secrets(loc, p), env_secrets(loc, p), connection_strings(loc, p))


def _after(text: Column, loc: Column, p: Probes, words: Sequence[str]) -> Column:
    return F.concat(
        private_keys(text),
        credential_composites(loc, p),
        card_with_expiry(text, loc, p),
        json_secrets(text),
        proximity_secrets(text, loc, p),
        vendor_host_tokens(text, loc, p),
        mnemonic_runs(text, words),
    )


def _names(findings: Column) -> Column:
    return F.transform(findings, lambda f: f["name"])


@reused
def _own_names(b1: str, b2: str, b3: str, p: Probes, words: tuple[str, ...]) -> Column:
    """Names found in each decoded text itself, before and after the base64 step."""

    def of(node: Column) -> Column:
        t = node["text"]

        def both(spans: Column) -> Column:
            return F.struct(
                _names(_before(spans, p)).alias("before"),
                _names(_after(t, spans, p, words)).alias("after"),
            )

        none = F.expr("cast(array() as array<string>)")
        return F.when(node["readable"] & t.isNotNull(), let(locate_deep(t, p), both)).otherwise(
            F.struct(none.alias("before"), none.alias("after"))
        )

    def bare(level: str) -> Column:
        return F.transform(
            F.col(level), lambda n: F.struct(n["text"].alias("text"), n["readable"].alias("readable"))
        )

    return F.transform(F.concat(bare(b1), bare(b2), bare(b3)), of)


@generated
def add_base64_types(
    df: DataFrame, text: str, loc: str, p: Probes, words: Sequence[str], out: str
) -> DataFrame:
    """Add ``out``: finding names from base64 text, three levels deep (DEEP4).

    All decoded texts of a document are listed level by level; the heuristics
    then run once over that list, and the names are passed up to the root.
    """
    b1, b2, b3, b4, own = (f"_{out}_{k}" for k in ("1", "2", "3", "4", "own"))
    any_run = F.col(text).rlike(f"[{_BASE64}]{{40}}")
    nodes = f"_{out}_nodes"
    df = df.withColumn(nodes, decoded_nodes(F.when(any_run, F.col(text)), MAX_DEPTH + 1, _telling(p)))

    def at(level: int) -> Column:
        return F.filter(F.col(nodes), lambda n: n["depth"] == level)

    df = df.withColumns({b: at(level) for level, b in enumerate((b1, b2, b3, b4), 1)}).drop(nodes)

    df = df.withColumn(own, _own_names(b1, b2, b3, p, words))

    def emitted(total: Column | None, node: Column) -> Column:
        """What one decoded text adds to the text it was found in."""
        none = F.expr("cast(array() as array<string>)")
        binary = F.when(
            node["binary"], F.array(lit("Base64 (Binary/Key Material)"))
        ).otherwise(none)
        if total is None:
            return binary
        inner = F.when(
            F.size(total) > 0, F.concat(F.array(lit("Base64 Encoded Secret")), total)
        ).otherwise(none)
        return F.concat(inner, binary)

    # names each text of a level adds to its parent, bottom-up
    e1, e2, e3, e4 = (f"_{out}_e{k}" for k in "1234")
    df = df.withColumn(
        e4,
        F.transform(
            F.col(b4),
            lambda n: F.struct(n["parent"].alias("parent"), emitted(None, n).alias("names")),
        ),
    )
    offsets = {b1: lit(0), b2: F.size(b1), b3: F.size(b1) + F.size(b2)}
    for level, lower, e in ((b3, e4, e3), (b2, e3, e2), (b1, e2, e1)):

        def add(level: str, lower: str) -> Column:
            def of(node: Column, i: Column, c: Column) -> Column:
                # the lower level is in the order of its parents
                first = count_lt(c["parents"], i)
                mine = F.slice(c["lower"], first + lit(1), count_le(c["parents"], i) - first)
                inner = F.flatten(F.transform(mine, lambda x: x["names"]))
                parts = F.get(c["own"], c["offset"] + i)
                total = F.concat(parts["before"], inner, parts["after"])
                parent = lit(0) if level == b1 else node["parent"]
                return F.struct(
                    parent.alias("parent"),
                    emitted(
                        F.when(node["readable"], total).otherwise(
                            F.expr("cast(array() as array<string>)")
                        ),
                        node,
                    ).alias("names"),
                )

            c = F.struct(
                F.col(lower).alias("lower"),
                F.transform(F.col(lower), lambda x: x["parent"]).alias("parents"),
                F.col(own).alias("own"),
                offsets[level].alias("offset"),
            )
            return let(c, lambda cc: F.transform(F.col(level), lambda n, i: of(n, i, cc)))

        df = df.withColumn(e, add(level, lower))
    return df.withColumn(
        out, F.flatten(F.transform(F.col(e1), lambda x: x["names"]))
    ).drop(b1, b2, b3, b4, own, e1, e2, e3, e4)


@generated
def add_deep_findings(
    df: DataFrame, text: str, loc: str, p: Probes, words: tuple[str, ...], out: str
) -> DataFrame:
    """Add ``out``: findings of all heuristics, in their fixed order."""
    inner = f"_{out}_b64"
    df = add_base64_types(df, text, loc, p, words, inner)
    return df.withColumn(out, _all_findings(text, loc, inner, p, words)).drop(inner)


@reused
def _all_findings(text: str, loc: str, inner: str, p: Probes, words: tuple[str, ...]) -> Column:
    return F.concat(
        _before(F.col(loc), p),
        F.transform(F.col(inner), lambda n: _found(n)),
        _after(F.col(text), F.col(loc), p, words),
    )


WORDLIST_LIMIT = 4_096
WORD_SET_LIMIT = 1_000_000  # a set of words that every worker holds, some 80 MB
SALTS = 32


def mnemonic_table(docs: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(doc_id, start, end, words) of runs of twelve or more listed words (DEEP11, JN6).

    ``wordlist`` has one column ``word``.  Its size is checked: a list within
    the first limit goes into the plan, one within the second to the workers as
    a set, and the documents are read in one narrow pass; only a longer one is
    joined by word, and the runs are then found per document.
    """
    listed = wordlist.select("word").filter("word is not null").distinct()
    words = [r["word"] for r in listed.limit(WORDLIST_LIMIT + 1).collect()]
    if len(words) <= WORDLIST_LIMIT:
        marked = docs.select("doc_id", _word_marks(F.col("text"), words).alias("t"))
    elif listed.limit(WORD_SET_LIMIT + 1).count() <= WORD_SET_LIMIT:
        marked = _looked_up_marks(docs, listed)
    else:
        marked = _joined_marks(docs, listed)

    def runs(t: Column) -> Column:
        marks = F.array_join(F.transform(t, lambda x: x["hit"].cast("int").cast("string")), "")
        return F.transform(
            locate(marks, f"1{{{MIN_MNEMONIC},}}"),
            lambda r: F.struct(
                F.get(t, r["start"])["start"].alias("start"),
                F.get(t, r["end"] - lit(1))["end"].alias("end"),
                (r["end"] - r["start"]).alias("words"),
            ),
        )

    return marked.select("doc_id", F.inline_outer(let(F.col("t"), runs))).filter("start is not null")


def _core(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, "\\A[^A-Za-z]+|[^A-Za-z]+\\z", ""))


def _word_marks(text: Column, words: Sequence[str]) -> Column:
    return F.transform(
        locate(text, "\\S+"),
        lambda t: F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            _core(t["value"]).isin(list(words)).alias("hit"),
        ),
    )


def _looked_up_marks(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Marks from a set that every worker holds; no token leaves its document."""
    words = docs.sparkSession.sparkContext.broadcast(frozenset(listed.toArrow().column(0).to_pylist()))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores = batch.column("cores")
            hits = pa.array([w in words.value for w in cores.flatten().to_pylist()], pa.bool_())
            ends = np.cumsum(pc.list_value_length(cores).fill_null(0).to_numpy(zero_copy_only=False))
            offsets = pa.array(np.append(0, ends).astype("i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.ListArray.from_arrays(offsets, hits)], ["doc_id", "t", "hits"]
            )

    places = docs.select("doc_id", locate(F.col("text"), "\\S+").alias("t"))
    tokens = places.select(
        "doc_id",
        F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("t"),
        F.transform("t", lambda t: _core(t["value"])).alias("cores"),
    )
    key = dict(docs.select("doc_id").dtypes)["doc_id"]
    marked = tokens.mapInArrow(looked_up, f"doc_id {key}, t array<struct<start: int, end: int>>, hits array<boolean>")
    return marked.select("doc_id", F.zip_with("t", "hits", lambda t, h: t.withField("hit", h)).alias("t"))


def _joined_marks(docs: DataFrame, wordlist: DataFrame) -> DataFrame:
    tokens = docs.select("doc_id", F.inline_outer(locate(F.col("text"), "\\S+"))).filter(
        "start is not null"
    )
    keyed = tokens.select("doc_id", "start", "end", _core(F.col("value")).alias("word"))
    # one word may be a third of all tokens: each word has SALTS keys, by document
    salt = F.explode(F.sequence(lit(0), lit(SALTS - 1))).alias("salt")
    known = wordlist.select("word", lit(True).alias("hit")).distinct().select("word", "hit", salt)
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), lit(SALTS)).cast("int"))
    hits = salted.join(known, ["word", "salt"], "left").select(
        "doc_id", F.struct("start", "end", F.coalesce("hit", lit(False)).alias("hit")).alias("t")
    )
    return hits.groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
