"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspan.llm.common import col, slices, strings

CACHED_WORDS = 240_000  # in either of two generations
WORDS_A_QUERY = 25_000
LONG_WORD = 256  # bytes; longer ones would take as many rounds as they have merges
POSITIONS = 1 << 12  # more than LONG_WORD
IDS = 1 << 20

#: Each round joins the pairs of neighbours to the merge table, picks per word the lowest rank, then the
#: leftmost place, puts the merged token there and drops its right neighbour.  A word without a pair is done.
MERGE = f"""
WITH RECURSIVE seq AS (
  SELECT w, pos, tok, nxt, npos, false AS done FROM start
  UNION ALL (
    WITH open AS (SELECT * FROM seq WHERE NOT done),
    pair AS (
      SELECT w, min(t::BIGINT * {POSITIONS} + pos) AS best
      FROM open JOIN merges ON lr = tok::BIGINT * {IDS} + nxt GROUP BY w),
    spot AS (
      SELECT s.w, s.pos AS spot_pos, (best // {POSITIONS})::INT AS merged, s.npos AS gone
      FROM pair JOIN open s ON s.w = pair.w AND s.pos = best % {POSITIONS}),
    cut AS (
      SELECT spot.*, s.nxt AS after, s.npos AS after_pos
      FROM spot JOIN open s ON s.w = spot.w AND s.pos = spot.gone)
    SELECT s.w, s.pos,
      CASE WHEN s.pos = spot_pos THEN merged ELSE s.tok END,
      CASE WHEN s.pos = spot_pos THEN after WHEN s.npos = spot_pos THEN merged ELSE s.nxt END,
      CASE WHEN s.pos = spot_pos THEN after_pos ELSE s.npos END,
      cut.w IS NULL
    FROM open s LEFT JOIN cut ON s.w = cut.w WHERE cut.w IS NULL OR s.pos <> gone))
SELECT w, tok FROM seq WHERE done ORDER BY w, pos
"""

DECODE = """
SELECT d, string_agg(hex, '' ORDER BY pos) AS hex, count(*) - count(hex) AS unknown
FROM given LEFT JOIN vocab USING (id) GROUP BY d
"""


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a rank file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    if any(bytes([b]) not in ranks for b in range(256)) or not all(0 <= r < IDS for r in ranks.values()):
        raise ValueError("the rank file lacks single bytes or holds ranks out of range")
    return ranks


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long word, by a heap in n log n steps."""
    part: list[bytes] = [bytes([b]) for b in word]
    n = len(part)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [
        (rank, i, part[i], part[i + 1])
        for i in range(n - 1)
        if (rank := ranks.get(part[i] + part[i + 1])) is not None
    ]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if part[i] != a or j >= n or part[j] != b:
            continue
        part[i], part[j] = a + b, b""
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (rank := ranks.get(part[x] + part[y])) is not None:
                heapq.heappush(heap, (rank, x, part[x], part[y]))
    return [ranks[p] for p in part if p]


#: Ids as packed integers, and the bytes they decode to.
Code = tuple[bytes, bytes]


class Codec:
    """One worker's DuckDB tables and the codes of words seen lately."""

    def __init__(self, lines: bytes, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks = read_ranks(lines)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], "int32")
        self.db = duckdb.connect(
            ":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""}
        )
        self.db.execute("SET preserve_insertion_order = false")
        found = [
            (left * IDS + right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        ]
        lr, t = zip(*found) if found else ((), ())
        self._table("merges", {"lr": pa.array(lr, pa.int64()), "t": pa.array(t, pa.int32())})
        self._table(
            "vocab",
            {
                "id": pa.array(ranks.values(), pa.int32()),
                "hex": pa.array([k.hex() for k in ranks], pa.string()),
            },
        )
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]
        self.known: dict[str, Code] = {}
        self.older: dict[str, Code] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merged(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Word numbers, their ids laid end to end, and where each word's ids begin and end."""
        size = np.array([len(w) for w in words], "int32")
        flat = np.frombuffer(b"".join(words), "uint8")
        first = np.cumsum(size) - size
        pos = (np.arange(len(flat)) - np.repeat(first, size)).astype("int32")
        tok = self.byte_ids[flat]
        nxt, npos = np.append(tok[1:], -1).astype("int32"), pos + 1
        nxt[first + size - 1] = -1
        npos[first + size - 1] = -1
        w = np.repeat(np.arange(len(words), dtype="int32"), size)
        self.db.register("start", pa.table({"w": w, "pos": pos, "tok": tok, "nxt": nxt, "npos": npos}))
        found = self.db.sql(MERGE).to_arrow_table()
        self.db.unregister("start")
        w, ids = found.column("w").to_numpy(), found.column("tok").to_numpy()
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        return w[first].tolist(), ids, np.append(first, len(ids))

    def _codes(self, ids: np.ndarray, ends: np.ndarray) -> list[Code]:
        decoded = self.decode(ids, np.repeat(np.arange(len(ends) - 1, dtype="int32"), np.diff(ends)), len(ends) - 1)
        packed, cuts = ids.tobytes(), ends.tolist()
        return [(packed[4 * a : 4 * b], d) for a, b, d in zip(cuts, cuts[1:], decoded)]

    def decimals(self, packed: bytes) -> str:
        names = self.names
        return ",".join([names[i] for i in np.frombuffer(packed, "int32").tolist()])

    def learn(self, words: list[str]) -> dict[str, Code]:
        """Codes of new words."""
        out, rest, known, ids = {}, [], [], []
        for word in words:
            b = word.encode("utf-8", "replace")
            if b in self.ranks or len(b) > LONG_WORD:
                known.append(word)
                ids.append([self.ranks[b]] if b in self.ranks else merge_long(b, self.ranks))
            else:
                rest.append((word, b))
        if known:
            ends = np.cumsum([0, *map(len, ids)])
            out.update(zip(known, self._codes(np.array(list(chain.from_iterable(ids)), "int32"), ends)))
        for i in range(0, len(rest), WORDS_A_QUERY):
            some = rest[i : i + WORDS_A_QUERY]
            at, flat, ends = self._merged([b for _, b in some])
            out.update(zip([some[n][0] for n in at], self._codes(flat, ends)))
        return out

    def encode(self, texts: list[str]) -> list[Code]:
        """The code of each text: those of its words end to end."""
        gc.disable()  # nothing here is in a cycle, and a collection would walk all the words
        try:
            split = [self.split(t) for t in texts]
            words = set(chain.from_iterable(split))
            if len(self.known) + len(words.difference(self.known)) > CACHED_WORDS:
                self.older, self.known = self.known, {}
            words.difference_update(self.known)
            again = words.intersection(self.older)
            self.known |= {w: self.older[w] for w in again}
            self.known |= self.learn(list(words - again))
            out = []
            for found in split:
                codes = [self.known[w] for w in found]
                packed, decoded = zip(*codes) if codes else ((), ())
                out.append((b"".join(packed), b"".join(decoded)))
            return out
        finally:
            gc.enable()

    def decode(self, ids: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
        """Bytes of ``n`` id sequences laid end to end, by an ordered aggregation."""
        out = [b""] * n
        if len(ids):
            pos = np.arange(len(ids), dtype="int64")
            self.db.register("given", pa.table({"d": owner, "pos": pos, "id": ids}))
            rows = self.db.execute(DECODE).fetchall()
            self.db.unregister("given")
            for d, text, unknown in rows:
                if unknown:
                    raise ValueError("an id is not in the vocabulary")
                out[d] = bytes.fromhex(text)
        return out


_CODECS: dict[int, Codec] = {}


def _with_codec(spark: SparkSession, ranks_path: str, pattern: str, work: Callable) -> Callable:
    """A mapInArrow function of ``work(codec, batch)``; the rank file (under 1 MB) is sent to the workers once."""
    with open(ranks_path, "rb") as f:
        lines = f.read()
    read_ranks(lines)
    sent = spark.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((sent.value, pattern))
        if key not in _CODECS:
            _CODECS[key] = Codec(sent.value, pattern)
        for batch in batches:
            yield work(_CODECS[key], batch)

    return run


def _lists(packed: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(packed), "int32")
    ends = np.cumsum([0, *(len(b) // 4 for b in packed)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def round_trip(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every text and decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` on request.

    Each match of ``pattern`` is encoded on its own; a match that is a token
    needs no merge.  Distinct new words of a slice of texts are contracted
    together in DuckDB and decoded there from their ids, once as long as a
    worker remembers them; words over ``LONG_WORD`` bytes by the same rule with a
    heap, as one contraction a round is quadratic.  Nothing is shuffled.

    Null and empty texts have no ids.  Each row gives one row: repeated rows,
    null ids and further columns change nothing.
    """

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        made = codec.encode(strings(batch.column("text")))
        packed = [b for b, _ in made]
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([len(b) // 4 for b in packed], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(codec.decimals(b).encode()).hexdigest() for b in packed]),
            "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for _, d in made]),
        }
        if with_ids:
            columns["ids"] = _lists(packed)
        return pa.RecordBatch.from_pydict(columns)

    run = _with_codec(docs.sparkSession, ranks_path, pattern, work)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(
        lambda batches: run(slices(batches, "text", 2 << 20)), schema + ", ids array<int>" * with_ids
    )


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row (array of int, empty for null and empty texts), as in ``round_trip``."""

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [b for b, _ in codec.encode(strings(batch.column("text")))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(packed)], ["doc_id", "ids"])

    run = _with_codec(docs.sparkSession, ranks_path, pattern, work)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: run(slices(batches, "text", 2 << 20)), "doc_id long, ids array<int>")


def decode(
    tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``doc_id, text`` of id arrays; bytes that are no UTF-8 become U+FFFD.

    A null array gives a null text, an empty one an empty text; an id outside
    the vocabulary, null included, fails the job.
    """

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        given = batch.column("ids")
        owner = np.asarray(given.value_parent_indices()).astype("int32")
        ids = given.flatten().fill_null(-1).to_numpy().astype("int32")
        texts = [b.decode("utf-8", "replace") for b in codec.decode(ids, owner, batch.num_rows)]
        column = pa.array([t if ok else None for t, ok in zip(texts, given.is_valid().to_pylist())], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "text"])

    run = _with_codec(tokens.sparkSession, ranks_path, pattern, work)
    rows = tokens.select(col(id_col).cast("long").alias("doc_id"), col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda batches: run(slices(batches, "ids", 2 << 20)), "doc_id long, text string")



