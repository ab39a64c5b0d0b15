"""Toxicity by a linear-chain conditional random field over tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import checkpointed, col, hash_sample, slices, strings

TOKENS = re.compile(r"[^\W_]+|[.!?\n]")
STOPS = frozenset(".!?\n")
PREFIX = 4  # letters; what an inflected or unseen word is known by
CHAIN = 64  # tokens of a chain at most; a longer sentence is several chains


@dataclass
class ToxicityModel:
    """Weights of label 1 against label 0: own word and prefix, previous and next word; transitions; document calibration.

    ``words`` numbers known words and, after ``^``, known prefixes from 1; an
    unknown word has the number of its prefix, or 0.
    """

    words: dict[str, int] = field(default_factory=dict)
    prefix: np.ndarray = field(default_factory=lambda: np.zeros(1, "int64"))  # of each number
    own: np.ndarray = field(default_factory=lambda: np.zeros(1))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1))
    before: np.ndarray = field(default_factory=lambda: np.zeros(1))
    after: np.ndarray = field(default_factory=lambda: np.zeros(1))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))


class Chains:
    """Token ids of many texts, cut into sentences, longest first, for steps in lockstep."""

    def __init__(self, texts: list[str], words: dict[str, int]):
        get = words.get
        ids, owner, first = [], [], []
        for d, text in enumerate(texts):
            at = 0
            new = True
            for token in TOKENS.findall(text.lower()):
                if token in STOPS:
                    new = True
                    continue
                if new or at == CHAIN:
                    first.append(len(ids))
                    at, new = 0, False
                ids.append(get(token) or get("^" + token[:PREFIX], 0))
                at += 1
            owner.append(len(ids))
        self.ids = np.array(ids, "int64")
        self.doc_ends = np.array(owner, "int64")
        start = np.array(first, "int64")
        size = np.diff(np.append(start, len(ids)))
        order = np.argsort(-size, kind="stable")
        self.start, self.size = start[order], size[order]
        longest = int(size.max(initial=0))
        self.active = [int(np.searchsorted(-self.size, -t, "left")) for t in range(longest)]
        inner = np.ones(len(ids), bool)
        inner[start] = False
        self.has_before = inner
        self.has_after = np.append(inner[1:], False)[: len(ids)]

    def scores(self, m: ToxicityModel) -> np.ndarray:
        e = (m.own + m.start[m.prefix])[self.ids]
        e[1:] += np.where(self.has_before[1:], m.before[self.ids[:-1]], 0)
        e[:-1] += np.where(self.has_after[:-1], m.after[self.ids[1:]], 0)
        return np.clip(e, -40, 40)

    def marginals(self, m: ToxicityModel, pairs: bool = False):
        """P(label 1) of every token by forward-backward, and the expected transitions on request."""
        odds = np.exp(self.scores(m))
        t = np.exp(m.trans)
        n = len(odds)
        fwd, bwd = np.empty(n), np.ones(n)
        # ratios of label 1 to label 0 keep the recursion in one number a token
        for step, k in enumerate(self.active):
            at = self.start[:k] + step
            if step:
                r = fwd[at - 1]
                fwd[at] = odds[at] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
            else:
                fwd[at] = odds[at]
        for step in range(len(self.active) - 1, 0, -1):
            at = self.start[: self.active[step]] + step
            g = odds[at] * bwd[at]
            bwd[at - 1] = (t[1, 0] + g * t[1, 1]) / (t[0, 0] + g * t[0, 1])
        both = fwd * bwd
        p = both / (1 + both)
        if not pairs:
            return p
        j = np.flatnonzero(self.has_before)
        r, g = fwd[j - 1], odds[j] * bwd[j]
        cells = np.stack([np.full(len(j), t[0, 0]), t[0, 1] * g, t[1, 0] * r, t[1, 1] * r * g])
        return p, (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)


def _document_features(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bias, largest marginal and log of the expected number of toxic tokens, for each document."""
    starts = np.append(0, ends[:-1])
    out = np.zeros((len(ends), 3))
    out[:, 0] = 1
    some = np.flatnonzero(ends > starts)
    if len(some):
        out[some, 1] = np.maximum.reduceat(p, starts[some])
        total = np.append(0, np.cumsum(np.where(p > 0.05, p, 0)))
        out[:, 2] = np.log1p(total[ends] - total[starts])
    return out


def marking_words(texts: list[set[str]], labels: np.ndarray, odds: float = 30.0, share: float = 0.02) -> set[str]:
    """Words or prefixes that single out documents of label 1: ``odds`` times likelier there, and in ``share`` of them (5 at least)."""
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    counts: dict[str, list[int]] = {}
    for words, y in zip(texts, labels.astype(int).tolist()):
        for w in words:
            counts.setdefault(w, [0, 0])[y] += 1
    return {
        w
        for w, (c0, c1) in counts.items()
        if c1 >= max(5, share * n1) and c1 / n1 >= odds * (c0 + 0.5) / (n0 + 1)
    }


def training_sample(
    docs: DataFrame, labels: DataFrame, train: Column, train_docs: int, train_chars: int
) -> tuple[DataFrame, dict[int, int]]:
    """``text, label`` and how many documents have either label.

    The sample is at most ``train_docs`` documents for which ``train`` (on
    ``doc_id``) holds: half with label 1, half with 0, each by hash order of the
    ids, of texts with 1 to ``train_chars`` characters.  A document with several labels has the largest;
    null ids, labels and texts do not train.  Ids are chosen without moving a
    text; the texts of the chosen ids are then filtered out in place.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.length("text").between(1, train_chars)
    )
    usable = checkpointed(known.join(texts.select("doc_id"), "doc_id", "left_semi"))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    chosen = [hash_sample(usable.filter(F.col("label") == y), "doc_id", train_docs // 2) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])
    one = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.select("text", "label"), counts


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    train_docs: int = 2000,
    train_chars: int = 20_000,
    vocabulary: int = 40_000,
    rounds: int = 60,
    l2: float = 1e-3,
) -> ToxicityModel:
    """Fit on ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label``) for which ``train`` holds.

    The classifier is fitted on a sample of at most ``train_docs`` documents of
    at most ``train_chars`` characters (see ``training_sample``); their tokens
    are labelled 1 in documents of label 1 where the word, or its first
    ``PREFIX`` letters, single these out.
    Without rows of both labels the model knows nothing and scores low.
    """
    sample, counts = training_sample(docs, labels, train, train_docs, train_chars)
    rows = sample.collect()
    y = np.array([r.label for r in rows], "float64")
    if len(set(y.tolist())) < 2:
        return ToxicityModel()
    texts = [r.text for r in rows]
    held = [set(TOKENS.findall(text.lower())) - STOPS for text in texts]
    held = [words | {"^" + w[:PREFIX] for w in words} for words in held]
    marks = marking_words(held, y)
    df: dict[str, int] = {}
    for words in held:
        for w in words:
            df[w] = df.get(w, 0) + 1
    chosen = sorted((w for w in df if df[w] >= 3), key=lambda w: (w not in marks, -df[w], w))
    words = {w: i + 1 for i, w in enumerate(chosen[:vocabulary])}
    n = len(words) + 1
    prefix = np.zeros(n, "int64")
    for w, i in words.items():
        prefix[i] = i if w[0] == "^" else words.get("^" + w[:PREFIX], 0)
    model = ToxicityModel(words, prefix, *(np.zeros(n) for _ in range(4)))
    chains = Chains(texts, words)
    if not len(chains.ids):
        return model
    marked = np.zeros(n, bool)
    marked[[words[w] for w in marks if w in words]] = True
    marked |= marked[prefix]
    of_doc = np.repeat(y, np.diff(np.append(0, chains.doc_ends)))
    gold = (marked[chains.ids] & (of_doc > 0)).astype("float64")
    _fit_field(model, chains, gold, rounds, l2)
    model.document = _fit_document(_document_features(chains.marginals(model), chains.doc_ends), y)
    # the sample has as many documents of either label; all labelled ones do not
    model.document[0] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def _fit_field(model: ToxicityModel, chains: Chains, gold: np.ndarray, rounds: int, l2: float) -> None:
    """Maximum likelihood by AdaGrad on the whole sample; the gradient is gold minus expected counts."""
    n, ids = len(model.own), chains.ids
    b, a = np.flatnonzero(chains.has_before), np.flatnonzero(chains.has_after)
    g0, g1 = gold[b - 1].astype(int), gold[b].astype(int)
    gold_pairs = np.bincount(2 * g0 + g1, minlength=4).reshape(2, 2).astype("float64")
    parts = (model.own, model.start, model.before, model.after, model.trans)
    memory = [np.full_like(x, 1e-6) for x in parts]
    model.own[:] = -2.0
    for _ in range(rounds):
        p, pairs = chains.marginals(model, pairs=True)
        d = gold - p
        grads = [
            np.bincount(ids, d, n),
            np.bincount(model.prefix[ids], d, n),
            np.bincount(ids[b - 1], d[b], n),
            np.bincount(ids[a + 1], d[a], n),
            gold_pairs - pairs,
        ]
        for x, g, h in zip(parts, grads, memory):
            g = g - l2 * x
            h += g * g
            x += 0.5 * g / np.sqrt(h)


def _fit_document(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic calibration by Newton steps; both labels weigh as in the sample, slopes stay positive."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    if min(w[1:]) < 0:
        x = x[:, :2]
        return np.append(_fit_document(x, y, rounds), 0.0) if x.shape[1] < len(w) else np.maximum(w, [-np.inf, 0])
    return w


def toxic_spans(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Half-open code point ranges of runs of tokens with a marginal over the threshold."""
    out: list[dict] = []
    i = 0
    joined = False
    for m in TOKENS.finditer(text.lower()):
        if m.group() in STOPS:
            joined = False
            continue
        if p[i] >= threshold:
            if joined:
                out[-1] |= {"end": m.end(), "score": max(out[-1]["score"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(p[i])})
        joined = bool(p[i] >= threshold)
        i += 1
    return out


def score(
    docs: DataFrame,
    model: ToxicityModel,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, score, spans`` of every whole text, and the columns named in ``keep``.

    Forward-backward marginals of all tokens give the document score (0 to 1)
    and the offending spans.  Offsets refer to the lower-cased text, which is
    as long as the text but for a few letters such as U+0130.  The model (a
    bounded vocabulary) is sent to the workers.  Null and empty texts get the
    score of a text without toxic tokens; each row gives one row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text", 4 << 20):
            texts = strings(batch.column("text"))
            chains = Chains(texts, m.words)
            p = chains.marginals(m)
            x = _document_features(p, chains.doc_ends) @ m.document
            starts = np.append(0, chains.doc_ends[:-1])
            high = np.append(0, np.cumsum(p >= threshold))
            spans = [
                toxic_spans(text, p[a:b], threshold) if high[b] > high[a] else []
                for text, a, b in zip(texts, starts, chains.doc_ends)
            ]
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {f"_k{i}": batch.column(f"_k{i}") for i in range(len(keep))}
            columns["score"] = pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))
            columns["spans"] = pa.array(spans, SPANS)
            yield pa.RecordBatch.from_pydict(columns)

    kept = [col(name).alias(f"_k{i}") for i, name in enumerate(keep)]
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), *kept, col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", *(f"_k{i} {kinds[f'_k{i}']}" for i in range(len(keep)))])
    out = rows.mapInArrow(scored, schema + ", score double, spans array<struct<start:int,end:int,score:double>>")
    return out.select("doc_id", *(F.col(f"_k{i}").alias(n) for i, n in enumerate(keep)), "score", "spans")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
