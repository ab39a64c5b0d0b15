"""Phrase collocations: Rabin-Karp fingerprints find frequent word sequences, the texts confirm and name them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import byte_strings, checkpointed, col, slices

SLICE = 1 << 19  # bytes of text hashed at once, one text at least
PENDING = 1_000_000  # fingerprints a task holds before they go out
TEXT_ROWS = 250_000  # phrases a task holds before they go out
BASE = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1
BLANK, CUT = 1, 2  # kinds of bytes that are no part of a word
SALTS = 16  # keys of one part of a phrase
SPACE = 0x20


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, "u1")
    kinds[[0x20, 0x09]] = BLANK
    kinds[[*b".,;:!?", *range(0x0A, 0x0E)]] = CUT
    return kinds


KINDS = _byte_kinds()
VALUES = np.array([xxhash.xxh64_intdigest(bytes([i]), 1) for i in range(256)], "u8")


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(1, "u8")
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Tables:
    """Powers of the base and of its inverse, made longer when a longer slice comes."""

    def __init__(self):
        self.up = self.down = np.empty(0, "u8")

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up = _powers(int(BASE), n)
            self.down = _powers(pow(int(BASE), -1, 1 << 64), n)


def _mixed(h: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
    """A one-to-one change of 64-bit values, so that no low bits stay low."""
    h = h ^ salt
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Grams:
    """The words of some texts, one blank apart in ``bytes``, with prefix polynomials over them.

    The value of a piece of text is sum(value(byte) * base^place) modulo 2^64,
    so two prefix values give that of any word sequence.
    """

    def __init__(self, texts: list[bytes], langs: list[str], tables: _Tables):
        raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", "u1")
        kind = KINDS[raw]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside.view("i1"), prepend=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        self.words = len(starts)
        self.piece = np.cumsum(kind == CUT, dtype="i4")[starts]
        sizes = np.fromiter(map(len, texts), "i8", len(texts)) + 1
        self.doc = np.searchsorted(np.append(0, np.cumsum(sizes)), starts, side="right") - 1
        keep = inside.copy()
        keep[ends] = True
        self.bytes = raw[keep]
        length = ends - starts
        self.stop = np.cumsum(length + 1) - 1
        self.start = self.stop - length
        self.bytes[self.stop] = SPACE
        tables.reach(len(self.bytes) + 1)
        self.prefix = np.zeros(len(self.bytes) + 1, "u8")
        np.cumsum(VALUES[self.bytes] * tables.up[: len(self.bytes)], out=self.prefix[1:])
        self.down = tables.down
        self.langs = langs
        lang_hash = {x: xxhash.xxh64_intdigest(x, 2) for x in set(langs)}
        self.salt = np.array([lang_hash[x] for x in langs], "u8")[self.doc] if self.words else np.empty(0, "u8")

    def places(self, n: int) -> np.ndarray:
        """First words of the sequences of ``n`` words that lie in one piece."""
        last = self.words - n + 1
        if last <= 0:
            return np.empty(0, "i8")
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 : self.words])

    def fingerprints(self, n: int, at: np.ndarray) -> np.ndarray:
        start, stop = self.start[at], self.stop[at + n - 1]
        value = (self.prefix[stop] - self.prefix[start]) * self.down[start]
        return _mixed(value, self.salt[at] + np.uint64(n))


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(values)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, "i8")
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(counts, first)


class Marks:
    """A Bloom filter of fingerprints: two bits each.  What it lets through wrongly is only counted in vain."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, prints: np.ndarray) -> np.ndarray:
        def bit(i: np.ndarray) -> np.ndarray:
            return (self.bits[i >> np.uint64(6)] >> (i & np.uint64(63))) & np.uint64(1)

        return (bit(prints & self.mask) & bit((prints >> np.uint64(32)) & self.mask)).astype(bool)


def _marks(prints: DataFrame, most_bits: int) -> Marks:
    """The filter of a table of fingerprints ``fp``, put together by Spark; at most ``most_bits`` bits come to the driver."""
    bits = 1 << 12
    n = prints.count()
    while bits < min(32 * n, most_bits):
        bits *= 2
    mask = F.lit(bits - 1).cast("long")
    places = F.array(F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32).bitwiseAND(mask))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i").bitwiseAND(F.lit(63)).cast("int"))
    words = (
        prints.select(F.explode(places).alias("i"))
        .groupBy(F.shiftright("i", 6).alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, "u8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view("u8")
    return Marks(out)


def _grams(batches: Iterator[pa.RecordBatch], tables: _Tables) -> Iterator[tuple[Grams, pa.RecordBatch]]:
    for batch in slices(batches, "text", SLICE):
        texts = byte_strings(batch.column("text"))
        yield Grams(texts, batch.column("lang").to_pylist(), tables), batch


def _frequent_prints(rows: DataFrame, sizes: tuple[int, ...], known, min_count: int) -> DataFrame:
    """Fingerprints ``fp`` with at least ``min_count`` occurrences; with ``known``, of sequences whose shorter parts all are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, n_held = _Tables(), [], 0

        def out(part: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            values, counts = part
            for a in range(0, len(values), 1 << 18):
                cut = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[cut].view("i8")), pa.array(counts[cut].astype("i8"))], ["fp", "n"]
                )

        for grams, _ in _grams(batches, tables):
            found = []
            for n in sizes:
                at = grams.places(n)
                if known is not None:
                    at = at[_parts_known(grams, n, at, known.value)]
                found.append(grams.fingerprints(n, at))
            part = _counted(np.concatenate(found))
            held.append(part)
            n_held += len(part[0])
            if n_held >= PENDING:
                held = [_summed(held)]
                n_held = len(held[0][0])
                if n_held >= PENDING // 2:
                    yield from out(held[0])
                    held, n_held = [], 0
        if n_held:
            yield from out(_summed(held))

    prints = rows.mapInArrow(counted, "fp long, n long")
    return checkpointed(prints.groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count).select("fp"))


def _parts_known(grams: Grams, n: int, at: np.ndarray, known: Marks) -> np.ndarray:
    """Whether both parts of n - 1 words of each sequence are in the filter."""
    ok = known.has(grams.fingerprints(n - 1, at))
    ok[ok] = known.has(grams.fingerprints(n - 1, at[ok] + 1))
    return ok


def _gathered(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all given pieces, one after the other."""
    ends = np.cumsum(size)
    return source[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _differing(source: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pieces of equal size differ, compared byte for byte, some megabytes at a time."""
    out = np.zeros(len(a), bool)
    total = np.append(0, np.cumsum(size))
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, side="right")) - 1)
        cut = slice(at, stop)
        unequal = _gathered(source, a[cut], size[cut]) != _gathered(source, b[cut], size[cut])
        out[cut] = np.add.reduceat(unequal, total[cut] - total[at], dtype="i8") > 0
        at = stop
    return out


def _named(grams: Grams, n: int, at: np.ndarray, prints: np.ndarray, doc_ids: pa.Array) -> pa.Table:
    """``lang, phrase, count, doc_id`` of the sequences at ``at``, told apart by their texts."""
    order = np.argsort(prints, kind="stable")
    at, prints = at[order], prints[order]
    start, size = grams.start[at], grams.stop[at + n - 1] - grams.start[at]
    lang = grams.doc[at]
    new = np.append(True, prints[1:] != prints[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    codes = {x: i for i, x in enumerate(dict.fromkeys(grams.langs))}
    code = np.array([codes[x] for x in grams.langs])[lang]
    # every occurrence is held against the text of the first one with its fingerprint
    unlike = (size != size[head]) | (code != code[head])
    rest = np.flatnonzero(~new & ~unlike)
    unlike[rest] = _differing(grams.bytes, start[rest], start[head[rest]], size[rest])
    if unlike.any():
        # a collision: occurrences of that fingerprint are grouped by text
        groups = np.unique(head[unlike])
        first: dict[tuple, int] = {}
        for i in np.flatnonzero(np.isin(head, groups)).tolist():
            text = grams.bytes[start[i] : start[i] + size[i]].tobytes()
            head[i] = first.setdefault((int(head[i]), int(code[i]), text), i)
        new = head == np.arange(len(at))
    heads, counts = np.unique(head, return_counts=True)
    offsets = np.append(0, np.cumsum(size[heads])).astype("i4")
    phrase = pa.Array.from_buffers(
        pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(_gathered(grams.bytes, start[heads], size[heads]))]
    )
    return pa.table(
        {
            "lang": pa.DictionaryArray.from_arrays(pa.array(code[heads].astype("i4")), pa.array(list(codes), pa.string())).cast(pa.string()),
            "phrase": phrase,
            "words": pa.array(np.full(len(heads), n, "i4")),
            "count": pa.array(counts.astype("i8")),
            "doc_id": doc_ids.take(pa.array(grams.doc[at[heads]])),
        }
    )


TEXTS = "lang string, phrase string, words int, count long, doc_id long"


def _phrases(rows: DataFrame, longest: int, marks: dict, min_count: int) -> DataFrame:
    """``lang, phrase, words, count, doc_id``, exact, of all phrases with at least ``min_count`` occurrences.

    Texts are cut out only where a fingerprint is in the filter; counts are
    those of the texts, so equal fingerprints of different texts do no harm.
    A row with no words has the number of words of its language.
    """
    keys = ["lang", "phrase", "words"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, n_held = _Tables(), [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(keys, use_threads=False).aggregate(
                [("count", "sum"), ("doc_id", "min")]
            ).rename_columns([*keys, "count", "doc_id"])

        def out() -> Iterator[pa.RecordBatch]:
            table = held[0].set_column(1, "phrase", held[0].column("phrase").cast(pa.string()))
            yield from table.combine_chunks().to_batches(max_chunksize=1 << 16)

        for grams, batch in _grams(batches, tables):
            if not grams.words:
                continue
            for n in range(1, longest + 1):
                at = grams.places(n)
                if n > 2:
                    at = at[_parts_known(grams, n, at, marks[n - 1].value)]
                prints = grams.fingerprints(n, at)
                ok = marks[n].value.has(prints)
                if ok.any():
                    held.append(_named(grams, n, at[ok], prints[ok], batch.column("doc_id")))
            langs, n_words = np.unique(np.array(grams.langs, object)[grams.doc].astype(str), return_counts=True)
            held.append(
                pa.table(
                    {
                        "lang": pa.array(langs.tolist(), pa.string()),
                        "phrase": pa.array([b""] * len(langs), pa.binary()),
                        "words": pa.array([0] * len(langs), pa.int32()),
                        "count": pa.array(n_words),
                        "doc_id": pa.nulls(len(langs), pa.int64()),
                    }
                )
            )
            n_held = sum(t.num_rows for t in held)
            if n_held >= TEXT_ROWS:
                held = [merged()]
                if held[0].num_rows >= TEXT_ROWS // 2:
                    yield from out()
                    held = []
        if held:
            held = [merged()]
            yield from out()

    texts = rows.mapInArrow(named, TEXTS).groupBy(*keys)
    out = texts.agg(F.sum("count").alias("count"), F.min("doc_id").alias("doc_id"))
    return checkpointed(out.filter((F.col("count") >= min_count) | (F.col("words") == 0)))


def frequent_phrases(
    docs: DataFrame,
    longest: int = 3,
    min_count: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_bits: int = 1 << 28,
) -> DataFrame:
    """``lang, phrase, words, count, doc_id`` of all sequences of up to ``longest`` words found ``min_count`` times or more.

    The texts are read once for the fingerprints of one and two words, once
    for each greater length, whose sequences count only if both their parts are
    frequent, and once for the texts.  Tasks add up what they hold and send
    fingerprints, not texts; what is frequent comes back as a filter of
    ``most_bits`` bits at most, so that its size is bounded: beyond some ten
    million frequent phrases more texts are shuffled in vain.  The last reading
    holds every occurrence against the text at the first one with its
    fingerprint, cuts out frequent phrases only, and counts by text.
    ``doc_id`` points to the smallest id that holds the phrase.  The row with
    no words and an empty phrase has the number of words of its language.
    """
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"),
    )
    sc = docs.sparkSession.sparkContext
    short = _frequent_prints(rows.select("text", "lang"), (1, 2), None, min_count)
    both = sc.broadcast(_marks(short, most_bits))
    marks = {1: both, 2: both}
    for n in range(3, longest + 1):
        prints = _frequent_prints(rows.select("text", "lang"), (n,), marks[n - 1], min_count)
        marks[n] = sc.broadcast(_marks(prints, most_bits))
    return _phrases(rows, longest, marks, min_count)


def collocations(
    docs: DataFrame,
    longest: int = 3,
    min_count: int = 10,
    top: int = 2000,
    covered_percent: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by the strength of their weakest cut.

    Texts are cut at ``.,;:!?`` and line breaks, pieces at blanks and tabs, A-Z
    in lower case.  A phrase of two to ``longest`` words found ``a >= min_count``
    times scores floor(1000000 * a * a / (l * r)) for a cut into parts found
    ``l`` and ``r`` times; its lowest cut counts, of equal ones the first.
    Phrases that lie in a longer candidate with at least ``covered_percent`` of
    their count go.  Order: score, count, phrase by its bytes.  Arithmetic is
    decimal, so nothing overflows.

    Null texts are empty and null languages ``und``; repeated rows count as
    often as they are there; ids are not needed; further columns are not read.
    """
    found = frequent_phrases(docs, longest, min_count, id_col, text_col, lang_col)
    total = found.filter("words = 0").select("lang", F.col("count").alias("n"))
    known = found.filter("words > 0").select("lang", "phrase", "words", F.col("count").alias("a"))
    candidates = known.filter("words > 1")
    w = F.split("phrase", " ")

    def joined(start: Column, size: Column) -> Column:
        return F.array_join(F.slice(w, start, size), " ")

    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("*", cut).select(
        "lang",
        "phrase",
        "words",
        "a",
        "k",
        joined(F.lit(1), F.col("k")).alias("first"),
        joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    # a common first or last word is on many candidates: they are dealt by phrase, and counts looked up by a salted key
    sides = cuts.select("lang", "phrase", "words", "a", "k", F.posexplode(F.array("first", "rest")).alias("side", "part"))
    salted = sides.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    counts = known.filter(F.col("words") < longest).select("lang", F.col("phrase").alias("part"), F.col("a").alias("of_part"))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    looked = salted.join(counts, ["lang", "part", "salt"])
    scored = (
        looked.groupBy("lang", "phrase", "words", "a", "k")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("of_part"))).alias("l"),
            F.max(F.when(F.col("side") == 1, F.col("of_part"))).alias("r"),
        )
        .withColumn(
            "score",
            F.expr(
                "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))"
                " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
            ),
        )
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    spans = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("words") - 1),
                lambda size: F.transform(
                    F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: F.array_join(F.slice(w, start, size), " ")
                ),
            )
        )
    )
    longer = (
        candidates.filter("words > 2")
        .select("lang", "a", spans.alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    left = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer").cast("decimal(20,0)") < covered_percent * F.col("a").cast("decimal(20,0)"), F.lit(True))
    )
    best = _first(left.select("lang", "phrase", "a", "cut.*"), [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``, without a language in one task.

    Rows are dealt to ranges of (language, order); the sizes of the ranges tell
    how many rows are before each, and only ranges that begin before ``top``
    are numbered.
    """
    dealt = checkpointed(rows.repartitionByRange("lang", *order).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("lang", "range").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("lang", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    numbered = dealt.join(begins.filter(F.col("before") < top), ["lang", "range"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("lang", "range").orderBy(*order))
    )
    return numbered.filter(F.col("rank") <= top)
