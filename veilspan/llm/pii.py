"""Personal data: exact base patterns, and a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import col, hash_sample, slices, strings

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match cannot begin inside a run of digits that did not begin one: the run itself would have been tried
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9]([\x20().0-9-]++)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def _phones(text: str) -> Iterator[Span]:
    done = 0
    for m in PHONE.finditer(text):
        # the pattern ends in a digit with one character at least before it
        end = m.start(1) + len(m.group(1).rstrip(" ().-"))
        if m.start() >= done and end - m.start(1) >= 2:
            done = end
            if 9 <= len(_digits(text[m.start() : end])) <= 15:
                yield m.start(), end, "phone"


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and apart within a kind, by start, then kind; linear in the text."""
    out = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += _phones(text)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- candidate segments ----------------------------------------------------

FIELD = re.compile(r"[0-9@]\S*")
FIELD_CHARS = 64
SEGMENT_FIELDS = 5


def fields(text: str) -> list[tuple[int, int]]:
    """Blank-separated pieces with a digit or an @, of at most ``FIELD_CHARS`` characters, punctuation cut off."""
    out = []
    for m in FIELD.finditer(text):
        start = m.start()
        while start > 0 and m.end() - start <= FIELD_CHARS and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        if end - start > FIELD_CHARS:
            continue
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while start < end and not text[end - 1].isalnum():
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of fields with three characters between neighbours at most; outside them nothing is a candidate."""
    out: list[list[tuple[int, int]]] = []
    for f in fields(text):
        if out and f[0] - out[-1][-1][1] <= 3:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def segment_features(text: str, start: int, end: int, n_fields: int) -> list[str]:
    """Facts about a whole span, which no single token shows."""
    s = text[start:end]
    digits = _digits(s)
    n = len(digits)
    size = str(n) if 8 < n < 20 else f"{n // 4}q" if n < 20 else "20+"
    letters = sum(map(str.isalpha, s))
    plus = s.startswith("+")
    plain = not letters and "@" not in s
    quads = re.fullmatch(r"[0-9]{1,5}(?:\.[0-9]{1,5}){3}", s)
    octets = bool(quads) and all(int(p) <= 255 for p in s.split("."))
    card = plain and 12 <= n <= 19 and not plus and luhn(digits)
    at = s.count("@")
    mail = at == 1 and "." in s[s.index("@") :] and s.index("@") > 0
    return [
        f"digits={size}",
        f"plus={plus},digits={size}",
        f"plain={plain},fields={min(n_fields, 4)}",
        f"card={card}",
        f"quads={bool(quads)},octets={octets}",
        f"at={min(at, 2)},mail={mail}",
        f"mail={mail},fields={min(n_fields, 2)}",
        f"plus={plus},plain={plain},paren={'(' in s}",
        f"letters={min(letters, 2)},plus={plus},at={at > 0}",
        f"card={card},dots={'.' in s}",
        f"left={text[start - 1 : start] in ('', ' ', chr(10))}",
    ]


@dataclass
class Field:
    """Weights of features by kind, and of neighbouring segments (0 is none of the kinds)."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(KINDS))))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1, len(KINDS) + 1)))


@dataclass
class Lattice:
    """Candidate segments of one region: ``(first field, fields, start, end, feature ids)``."""

    n: int
    segments: list[tuple[int, int, int, int, list[int]]]


def lattice(text: str, region: list[tuple[int, int]], features: dict[str, int], grow: bool = False) -> Lattice:
    out = []
    for i in range(len(region)):
        for k in range(1, min(SEGMENT_FIELDS, len(region) - i) + 1):
            start, end = region[i][0], region[i + k - 1][1]
            if end - start > FIELD_CHARS:
                break
            names = segment_features(text, start, end, k)
            if grow:
                ids = [features.setdefault(f, len(features)) for f in names]
            else:
                ids = [features[f] for f in names if f in features]
            out.append((i, k, start, end, ids))
    return Lattice(len(region), out)


def _potentials(model: Field, lat: Lattice) -> list[np.ndarray]:
    """Scores of a segment by kind; kind 0 takes one field at a time and scores 0."""
    rows = []
    for _, k, _, _, ids in lat.segments:
        s = np.empty(len(KINDS) + 1)
        s[0] = 0.0 if k == 1 else -np.inf
        s[1:] = model.weights[ids].sum(axis=0)
        rows.append(s)
    return rows


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def forward_backward(model: Field, lat: Lattice, scores: list[np.ndarray]):
    """Log forward and backward sums at the borders between fields, by the kind of the segment before."""
    size = len(KINDS) + 1
    fwd = np.full((lat.n + 1, size), -np.inf)
    bwd = np.full((lat.n + 1, size), -np.inf)
    fwd[0, 0], bwd[lat.n] = 0.0, 0.0
    by_start: list[list[int]] = [[] for _ in range(lat.n)]
    for at, seg in enumerate(lat.segments):
        by_start[seg[0]].append(at)
    entered: dict[int, np.ndarray] = {}
    for i in range(lat.n):
        enter = _log_sum(fwd[i][:, None] + model.trans, 0)
        for at in by_start[i]:
            entered[at] = enter
            j = i + lat.segments[at][1]
            fwd[j] = np.logaddexp(fwd[j], enter + scores[at])
    for i in range(lat.n - 1, -1, -1):
        out = np.full(size, -np.inf)
        for at in by_start[i]:
            out = np.logaddexp(out, scores[at] + bwd[i + lat.segments[at][1]])
        bwd[i] = _log_sum(model.trans + out[None, :], 1)
    return fwd, bwd, entered, float(_log_sum(fwd[lat.n], 0))


def posteriors(model: Field, lat: Lattice, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P(segment has kind) and expected neighbour counts."""
    fwd, bwd, entered, z = forward_backward(model, lat, scores)
    p = np.zeros((len(lat.segments), len(KINDS) + 1))
    pairs = np.zeros_like(model.trans)
    for at, (i, k, _, _, _) in enumerate(lat.segments):
        tail = scores[at] + bwd[i + k] - z
        p[at] = np.exp(entered[at] + tail)
        pairs += np.exp(fwd[i][:, None] + model.trans + tail[None, :])
    return p, pairs


def best_path(model: Field, lat: Lattice, scores: list[np.ndarray]) -> list[tuple[int, int]]:
    """The best boundaries and kinds together: ``(segment, kind)`` from left to right.

    Segments hold ``SEGMENT_FIELDS`` fields at most, so the time is linear in the fields.
    """
    size = len(KINDS) + 1
    best = np.full((lat.n + 1, size), -np.inf)
    best[0, 0] = 0.0
    back: list[list] = [[None] * size for _ in range(lat.n + 1)]
    for at, (i, k, _, _, _) in enumerate(lat.segments):
        enter = best[i][:, None] + model.trans
        came, total = enter.argmax(axis=0), enter.max(axis=0) + scores[at]
        for y in range(size):
            if total[y] > best[i + k, y]:
                best[i + k, y], back[i + k][y] = total[y], (at, int(came[y]))
    j, y, out = lat.n, int(best[lat.n].argmax()), []
    while j > 0:
        at, before = back[j][y]
        out.append((at, y))
        j, y = lat.segments[at][0], before
    return out[::-1]


def fit(
    docs: DataFrame,
    train_docs: int = 2000,
    train_chars: int = 20_000,
    train_regions: int = 600,
    rounds: int = 25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Field:
    """Fit the field on base spans as gold, on a bounded sample.

    The sample is at most ``train_docs`` texts with a digit or @ and up to
    ``train_chars`` characters, by hash order, and of these at most
    ``train_regions`` regions of up to 32 fields (every other one is scored as
    well, but not learnt from).  Without regions nothing will be added.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).filter(
        F.col("text").rlike("[0-9@]") & (F.length("text") <= train_chars)
    )
    model = Field()
    examples: list[tuple[Lattice, dict[tuple[int, int], int]]] = []
    for row in hash_sample(rows, "doc_id", train_docs).collect():
        gold = {(s, e): KINDS.index(kind) + 1 for s, e, kind in base_spans(row.text)}
        for region in regions(row.text):
            if len(examples) < train_regions and len(region) <= 32:
                examples.append((lattice(row.text, region, model.features, grow=True), gold))
    model.weights = np.zeros((len(model.features), len(KINDS)))
    memory = [np.full_like(model.weights, 1e-6), np.full_like(model.trans, 1e-6)]
    for _ in range(rounds if examples else 0):
        g_w, g_t = -1e-2 * model.weights, -1e-2 * model.trans
        for lat, gold in examples:
            p, pairs = posteriors(model, lat, _potentials(model, lat))
            for at, (_, _, start, end, ids) in enumerate(lat.segments):
                d = -p[at, 1:]
                y = gold.get((start, end), 0)
                if y:
                    d[y - 1] += 1
                for f in ids:
                    g_w[f] += d
            g_t += _gold_pairs(lat, gold) - pairs
        for x, g, h in ((model.weights, g_w, memory[0]), (model.trans, g_t, memory[1])):
            h += g * g
            x += 0.7 * g / np.sqrt(h)
    return model


def _gold_pairs(lat: Lattice, gold: dict[tuple[int, int], int]) -> np.ndarray:
    out = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
    found = {i: (k, y) for i, k, s, e, _ in lat.segments if (y := gold.get((s, e), 0))}
    i = before = 0
    while i < lat.n:
        k, y = found.get(i, (1, 0))
        out[before, y] += 1
        i, before = i + k, y
    return out


def added_spans(text: str, model: Field, base: list[Span], least: float) -> list[Span]:
    """Segments of the best path whose posterior is ``least`` or more and that touch no base span."""
    if not len(model.features):
        return []
    out = []
    for region in regions(text):
        lat = lattice(text, region, model.features)
        scores = _potentials(model, lat)
        path = [(at, y) for at, y in best_path(model, lat, scores) if y]
        if not path:
            continue
        fresh = [
            (at, y)
            for at, y in path
            if all(lat.segments[at][3] <= s or e <= lat.segments[at][2] for s, e, _ in base)
        ]
        if fresh:
            p, _ = posteriors(model, lat, scores)
            out += [(lat.segments[at][2], lat.segments[at][3], KINDS[y - 1]) for at, y in fresh if p[at, y] >= least]
    return out


def find_personal_data(
    docs: DataFrame,
    model: Field,
    least: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, spans, added`` of every whole text: arrays of (kind, start, end), code points, end exclusive.

    ``spans`` are the base matches, which always stay; ``added`` are those of
    the field.  Text outside the candidate regions cannot be in a segment, so
    the dynamic program splits there without changing its result.  Nothing is
    shuffled; the model (a few hundred weights) is sent to the workers.  Null
    and empty texts have no spans; each row gives one row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    has = re.compile("[0-9@]").search

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans, added = [], []
            for text in strings(batch.column("text")):
                base = base_spans(text) if has(text) else []
                more = added_spans(text, sent.value, base, least) if has(text) else []
                for to, these in ((spans, base), (added, more)):
                    to.append([{"kind": k, "start": s, "end": e} for s, e, k in these])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, SPANS), pa.array(added, SPANS)], ["doc_id", "spans", "added"]
            )

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(found, f"doc_id long, spans {kind}, added {kind}")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
