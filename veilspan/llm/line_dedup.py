"""Exact line deduplication over range-partitioned, sorted line hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import byte_strings, checkpointed, col, slices

BLANK = b" \t\n\v\f\r"
LINE = "h1 long, h2 long, doc_id long, text_hash long, pos int"


def _text_hash(text: bytes) -> int:
    """What ``F.xxhash64`` gives for the text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, doc, own, pos = [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), byte_strings(batch.column("text"))):
                t = _text_hash(text)
                for i, line in enumerate(text.lower().split(b"\n")):
                    key = line.strip(BLANK)
                    if len(key) >= min_chars and (
                        len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars
                    ):
                        digests.append(xxhash.xxh3_128_digest(key))
                        doc.append(d)
                        own.append(t)
                        pos.append(i)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {
                    "h1": pa.array(both[:, 0]),
                    "h2": pa.array(both[:, 1]),
                    "doc_id": pa.array(doc, pa.int64()),
                    "text_hash": pa.array(own, pa.int64()),
                    "pos": pa.array(pos, pa.int32()),
                }
            )

    return docs.filter(F.col("doc_id").isNotNull()).mapInArrow(hashed, LINE)


def _group_starts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
    new_key = np.ones(len(h1), bool)
    new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return h1, h2, doc, new_key, new_doc


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents that the first and the last key of a sorted partition have in it."""
    from pyspark import TaskContext

    first = last = None  # [h1, h2, documents, last document]
    only = True
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, new_key, new_doc = _group_starts(batch)
        starts = np.flatnonzero(new_key)
        docs = np.add.reduceat(new_doc.astype("int64"), starts)
        for i, s in enumerate(starts if len(starts) <= 2 else (starts[0], starts[-1])):
            n = int(docs[0] if s == 0 else docs[-1])
            e = len(h1) - 1 if s == starts[-1] else starts[1] - 1
            key = (int(h1[s]), int(h2[s]))
            if last is not None and last[:2] == list(key):
                last[2] += n - (int(doc[s]) == last[3])
                last[3] = int(doc[e])
            else:
                if last is not None and first is None:
                    first = last
                last = [*key, n, int(doc[e])]
    if last is not None:
        only = first is None
        rows = [last] if only else [first, last]
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()),
                "h1": pa.array([r[0] for r in rows], pa.int64()),
                "h2": pa.array([r[1] for r in rows], pa.int64()),
                "docs": pa.array([r[2] for r in rows], pa.int64()),
            }
        )


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, text_hash, bitmap`` of texts that lose lines; a set bit keeps its line.

    Bitmaps are zlib-compressed, first line in the highest bit, and end after
    the last dropped line: what follows is kept.

    Line hashes are range-partitioned by (hash, document), so a line found
    everywhere is spread over partitions, and each partition is sorted with the
    largest document first.  A stream over it keeps the first document of a key
    and drops the rest once the key has ``min_docs`` documents; it holds back
    ``min_docs`` documents of one key at most.  Two rows for each partition tell
    its neighbours how many documents of a straddling key they have.
    """
    lines = _line_hashes(docs, min_chars).repartitionByRange("h1", "h2", F.desc("doc_id"))
    lines = checkpointed(lines.sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos"))
    edges = lines.mapInArrow(_edges, "part int, h1 long, h2 long, docs long").collect()
    here: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in edges:
        here.setdefault((r.h1, r.h2), []).append((r.part, r.docs))
    shared = {k: v for k, v in here.items() if len(v) > 1}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key = at_doc = None
        seen = all_docs = 0
        held: list[tuple[int, int, int]] = []
        for batch in batches:
            h1, h2, doc, new_key, new_doc = _group_starts(batch)
            own, pos = batch.column("text_hash").to_numpy(), batch.column("pos").to_numpy()
            out: list[tuple[int, int, int]] = []
            starts = np.append(np.flatnonzero(new_doc), len(doc))
            for a, b in zip(starts[:-1], starts[1:]):
                now = (int(h1[a]), int(h2[a]))
                if now != key:
                    held, key, at_doc = [], now, None
                    elsewhere = shared.get(key, ())
                    seen = sum(n for p, n in elsewhere if p < part)
                    all_docs = seen + sum(n for p, n in elsewhere if p > part)
                if at_doc != doc[a]:
                    at_doc = doc[a]
                    seen, all_docs = seen + 1, all_docs + 1
                if seen > 1:
                    rows = zip(doc[a:b].tolist(), own[a:b].tolist(), pos[a:b].tolist())
                    if all_docs >= min_docs:
                        out += held
                        out += rows
                        held = []
                    else:
                        held += rows
            if out:
                d, t, p = zip(*out)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(d, pa.int64()),
                        "text_hash": pa.array(t, pa.int64()),
                        "pos": pa.array(p, pa.int32()),
                    }
                )

    gone = lines.mapInArrow(stream, "doc_id long, text_hash long, pos int")
    # repeated rows hash alike and lose the same lines; their positions meet here once
    texts = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for gone in batch.column("gone").to_pylist():
                bits = np.ones(max(gone) + 1, "uint8")
                bits[gone] = 0
                maps.append(zlib.compress(len(bits).to_bytes(4, "big") + np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(maps, pa.binary())],
                ["doc_id", "text_hash", "bitmap"],
            )

    return texts.mapInArrow(packed, "doc_id long, text_hash long, bitmap binary")


def _keep(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines, dropped lines and the kept text."""
    if bitmap is None:
        return text.count(b"\n") + 1, 0, text
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw, "uint8", offset=4))[: int.from_bytes(raw[:4], "big")]
    lines = text.split(b"\n")
    kept = [line for line, bit in zip(lines, bits.tolist()) if bit] + lines[len(bits) :]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    with_text: bool = True,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row, the kept text, and the columns named in ``keep``.

    A line's key is the line without blanks at both ends, A-Z lower-cased; keys
    of at least ``min_chars`` code points that are in ``min_docs`` documents
    stay only in the largest ``doc_id``.  Documents are told apart by id, so
    repeated rows count once and lose the same lines.  Rows with a null id
    count for nothing and lose nothing; null and empty texts are one empty
    line; further columns are not read.
    """
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        F.coalesce(col(text_col), F.lit("")).alias("text"),
        *(col(name).alias(f"_k{i}") for i, name in enumerate(keep)),
    )
    extra = [f"_k{i}" for i in range(len(keep))]
    maps = dropped_lines(rows.select("doc_id", "text"), min_chars, min_docs).hint("shuffle_hash")

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, bitmap in zip(byte_strings(batch.column("text")), batch.column("bitmap").to_pylist()):
                out.append(_keep(text, bitmap))
            columns = {c: batch.column(c) for c in ("doc_id", *extra)} | {
                "n_lines": pa.array([n for n, _, _ in out], pa.int64()),
                "n_dropped": pa.array([n for _, n, _ in out], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for _, _, t in out]),
            }
            if with_text:
                columns["kept"] = pa.array([t.decode("utf-8", "replace") for _, _, t in out], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    joined = rows.withColumn("text_hash", F.xxhash64("text")).join(maps, ["doc_id", "text_hash"], "left")
    kinds = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in extra), "n_lines long, n_dropped long"])
    out = joined.select("doc_id", "text", "bitmap", *extra).mapInArrow(
        applied, schema + ", kept_sha256 string" + ", kept string" * with_text
    )
    rest = ["n_lines", "n_dropped", "kept_sha256", *["kept"] * with_text]
    return out.select("doc_id", *(F.col(c).alias(n) for c, n in zip(extra, keep)), *rest)
