"""Periodic runs of words: suffix trees answer common-extension queries, Lyndon roots give the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import byte_strings, col, slices

SLICE = 4 << 20  # bytes of text in hand at once, one text at least
BLOCK = 16  # entries of a tour that share a minimum


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (integers of 1 and more) and an end of its own, laid out as an Euler tour.

    ``order`` has the suffixes in lexicographic order.  A common prefix is as
    long as the lowest common ancestor of two leaves is deep, which is the
    least depth in the tour between them.
    """

    def __init__(self, symbols: np.ndarray):
        _, dense = np.unique(symbols, return_inverse=True)
        text = (dense + 1).tolist() + [0]
        self.size = len(text)
        self._tour(*self._grow(text))

    @staticmethod
    def _grow(text: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
        """First and last place of each edge, and the child of (node, first symbol)."""
        n = len(text)
        wide = n + 1
        start, stop, link = [0], [0], [0]
        child: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * wide + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    first = start[below]
                    reach = (stop[below] if stop[below] <= i else i + 1) - first
                    if length >= reach:
                        edge += reach
                        length -= reach
                        node = below
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(start)
                    child[key] = middle
                    start += (first, i)
                    stop += (first + length, n)
                    link += (0, 0)
                    start[below] = first + length
                    child[middle * wide + symbol] = middle + 1
                    child[middle * wide + text[first + length]] = below
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return start, stop, child, wide

    def _tour(self, start: list[int], stop: list[int], child: dict[int, int], wide: int) -> None:
        keys = np.fromiter(child.keys(), "i8", len(child))
        order = np.argsort(keys)
        children = np.fromiter(child.values(), "i8", len(child))[order].tolist()
        begins = np.searchsorted(keys[order], np.arange(len(start) + 1) * wide).tolist()
        depth = [0] * len(start)
        tour: list[int] = []
        first = [0] * self.size
        leaves: list[int] = []
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d = depth[v]
            a, b = begins[v], begins[v + 1]
            if a == b:
                suffix = self.size - d
                first[suffix] = len(tour)
                leaves.append(suffix)
            else:
                for c in reversed(children[a:b]):
                    depth[c] = d + stop[c] - start[c]
                    stack += (~v, c)
            tour.append(d)
        self.order = np.array(leaves)
        self.first = np.array(first)
        self._minima(np.array(tour, "i4"))

    def _minima(self, tour: np.ndarray) -> None:
        """Minima from each entry to both ends of its block, and over 2^k blocks."""
        n_blocks = -(-len(tour) // BLOCK)
        padded = np.full(n_blocks * BLOCK, np.iinfo("i4").max, "i4")
        padded[: len(tour)] = tour
        blocks = padded.reshape(-1, BLOCK)
        self.tour = padded
        self.up_to = np.minimum.accumulate(blocks, axis=1).ravel()
        self.from_on = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= n_blocks:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def common_prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes ``i`` and ``j`` agree, for arrays of different places."""
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        low, high = a // BLOCK, b // BLOCK
        out = np.minimum(self.from_on[a], self.up_to[b])
        between = high - low - 1
        wide = np.flatnonzero(between > 0)
        if len(wide):
            level = np.frexp(between[wide].astype("f8"))[1] - 1
            for k in np.unique(level).tolist():
                at = wide[level == k]
                table = self.levels[k]
                least = np.minimum(table[low[at] + 1], table[high[at] - (1 << k)])
                out[at] = np.minimum(out[at], least)
        near = np.flatnonzero(low == high)
        if len(near):
            x, y = a[near], b[near]
            least = self.tour[x].copy()
            for step in range(1, BLOCK):
                np.minimum(least, self.tour[np.minimum(x + step, y)], out=least)
            out[near] = least
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank, or the length."""
    out = [len(rank)] * len(rank)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def word_runs(symbols: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """``start, length, period`` rows of all maximal runs, by start, then period.

    The longest Lyndon word at a place ends before the next smaller suffix, in
    the order of symbols or its inverse.  Each run has one of them as a root;
    extending all of them to both sides gives every run.
    """
    n = len(symbols)
    none = np.empty((0, 3), "i8")
    if n < max(min_length, min_exponent):
        return none
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = np.empty(n + 1, "i8")
    rank[ahead.order] = np.arange(n + 1)
    rank = rank[:n]
    place = np.concatenate([np.arange(n)] * 2)
    after = np.array(_next_smaller(rank.tolist()) + _next_smaller((-rank).tolist()))
    period = after - place
    right = ahead.common_prefix(place, after)
    # the places before, read from the end; place n stands for "nothing is there"
    left = back.common_prefix(n - place, n - after)
    length = left + period + right
    ok = (length >= min_length) & (length >= min_exponent * period)
    found = np.unique(np.stack([place - left, length, period], axis=1)[ok], axis=0)
    if not len(found):
        return none
    # the same stretch has its smallest period first
    new = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _repeated(ids: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Words in a sequence of three that its document has ``least`` times or more (or in one of equal hash).

    A run that qualifies lies in these words as a whole, so nothing is lost.
    """
    cover = np.zeros(len(ids) + 1, "i4")
    if len(ids) >= 3:
        with np.errstate(over="ignore"):
            w = ids.astype("u8")
            key = w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[2:]
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + doc[2:].astype("u8")
        same = np.flatnonzero(doc[:-2] == doc[2:])
        order = same[np.argsort(key[same])]
        ordered = key[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, "i8")
        many = np.diff(np.append(starts, len(ordered)))
        at = order[np.repeat(many >= least, many)]
        cover[at] += 1
        np.add.at(cover, at + 3, -1)
    return np.cumsum(cover[:-1]) > 0


def _document_runs(ids: np.ndarray, cover: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Runs of one document, from the trees of its covered stretches, set apart by symbols that occur once."""
    edges = np.flatnonzero(np.diff(cover.view("i1"), prepend=np.int8(0), append=np.int8(0)))
    stretches = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= min_length]
    if not stretches:
        return np.empty((0, 3), "i8")
    parts, places = [], []
    for k, (a, b) in enumerate(stretches):
        parts += [ids[a:b], [-1 - k]]
        places += [np.arange(a, b), [-1]]
    found = word_runs(np.concatenate(parts[:-1]), min_length, min_exponent)
    found[:, 0] = np.concatenate(places)[found[:, 0]]
    return found


def periodic_runs(
    docs: DataFrame,
    min_length: int = 6,
    min_exponent: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: ``runs`` are (start, length, period) by start, then period.

    Words are what blanks ``[\\x20\\x09-\\x0D]`` leave.  A run is a stretch of
    words with smallest period q, of ``min_length`` words and ``min_exponent``
    periods at least, that no neighbour extends.  ``collapsed`` has the words
    that no run holds after its first q words, one blank apart.

    Only words in sequences of three that the document repeats often enough for
    a run go into the trees; a text is read in linear time but for sorting.  A
    document's trees are its own, whatever its length, and nothing is shuffled.

    Null and empty texts have no words and no runs.  Ids are passed on as they
    are, null or repeated; further columns are not read.
    """
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    least = min(max(min_length, min_exponent) - 2, min_exponent - 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            texts = [t.split() for t in byte_strings(batch.column("text"))]
            sizes = np.fromiter(map(len, texts), "i8", len(texts))
            table: dict[bytes, int] = {}
            ids = np.fromiter(map(table.setdefault, chain.from_iterable(texts), count()), "i8", sizes.sum())
            doc = np.repeat(np.arange(len(texts)), sizes)
            cover = _repeated(ids, doc, least) if least >= 2 else np.ones(len(ids), bool)
            ends = np.cumsum(sizes)
            any_cover = np.bincount(doc[cover], minlength=len(texts)).tolist()
            offsets, values, collapsed = [0], [np.empty((0, 3), "i8")], []
            for words, a, b, some in zip(texts, (ends - sizes).tolist(), ends.tolist(), any_cover):
                if some >= min_length:
                    runs = _document_runs(ids[a:b], cover[a:b], min_length, min_exponent)
                    if len(runs):
                        values.append(runs)
                        inside = np.zeros(b - a + 1, "i8")
                        np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
                        keep = np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()
                        words = [words[i] for i in keep]
                    offsets.append(offsets[-1] + len(runs))
                else:
                    offsets.append(offsets[-1])
                collapsed.append(b" ".join(words))
            flat = np.concatenate(values)
            struct = pa.StructArray.from_arrays(
                [pa.array(flat[:, i].copy()) for i in range(3)], ["start", "length", "period"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        found, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
