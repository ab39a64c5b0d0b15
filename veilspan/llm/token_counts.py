"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import col, slices, strings

SPACE = "▁"
CACHED_WORDS = 300_000
CACHED_LENGTH = 48


def read_pieces(model: bytes) -> dict[str, int]:
    """Piece to rank (0 merges first) of a byte-fallback BPE model file.

    Only what the counting relies on is accepted: no normalisation but blanks
    to U+2581 with one put in front, no user-defined pieces, and no piece with
    U+2581 after another character, so that words merge on their own.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = range(sp.get_piece_size())
    special = [i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
    rest = sorted(set(ids) - set(special), key=lambda i: -sp.get_score(i))
    ranks = {sp.id_to_piece(i): n for n, i in enumerate(rest)}
    probe = "  ½ á\tﬁ  b "
    if (
        sp.normalize(probe) != SPACE + probe.replace(" ", SPACE)
        or sum(map(sp.is_byte, ids)) != 256
        or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ranks)
    ):
        raise ValueError("not a byte-fallback BPE model with identity normalisation")
    return ranks


def count_pieces(symbols: str, ranks: dict[str, int]) -> int:
    """Initial symbols minus merges, popping the lowest-rank adjacent pair.

    Equal ranks go to the leftmost pair.  A character without a piece is as
    many symbols as it has UTF-8 bytes.
    """
    n = len(symbols)
    part = list(symbols)
    weight = [1 if c in ranks else len(c.encode("utf-8", "replace")) for c in part]
    if n == 1:
        return weight[0]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(part[i] + part[i + 1])
        if rank is not None:
            heap.append((rank, i, i + 1, part[i], part[i + 1]))
    heapq.heapify(heap)
    total = sum(weight)
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if part[i] != a or part[j] != b or right[i] != j:
            continue  # a neighbour merged meanwhile
        total += 1 - weight[i] - weight[j]
        whole = part[i] = a + b
        weight[i], part[j] = 1, ""
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            rank = ranks.get(whole + part[k])
            if rank is not None:
                heapq.heappush(heap, (rank, i, k, whole, part[k]))
        h = left[i]
        if h >= 0:
            rank = ranks.get(part[h] + whole)
            if rank is not None:
                heapq.heappush(heap, (rank, h, i, part[h], whole))
    return total


class WordCounts(dict):
    """Counts of words seen lately; a key is a unit without its first U+2581, or starts with a line feed."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, key: str) -> int:
        if key.startswith("\n"):
            n = count_pieces("\n", self.ranks) + (count_pieces(key[1:], self.ranks) if key[1:] else 0)
        else:
            n = count_pieces(SPACE + key, self.ranks)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[key] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or " \n" in text or SPACE in text or text[0] in " \n":
            units = _UNITS.findall(SPACE + text.replace(" ", SPACE))
            return sum(self[u if u[0] == "\n" else u[1:]] for u in units)
        return sum(map(self.__getitem__, text.replace("\n", " \n").split(" ")))


_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
_COUNTS: dict[int, WordCounts] = {}


def token_counts(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; no identifiers are made.

    Words recur, so a worker keeps the counts of at most ``CACHED_WORDS`` of
    them; a unit of any length merges in n log n steps.  The model file (a few
    hundred kB) is read once on the driver and sent along.

    Null and empty texts have 0 tokens; null ids, repeated rows and further
    columns change nothing: each row gives one row.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    if any("\n" in piece for piece in read_pieces(model)):
        raise ValueError("a piece holds a line feed: words cannot be told apart")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _COUNTS:
            _COUNTS[key] = WordCounts(read_pieces(sent.value))
        words = _COUNTS[key]
        for batch in slices(batches, "text"):
            n = pa.array([words.text(t) for t in strings(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
        col(text_col).alias("text"),
    )
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
