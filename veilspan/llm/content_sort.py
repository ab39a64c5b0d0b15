"""Exact deduplication by sorting contents: equal texts become neighbours, which are compared in full."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import byte_strings, checkpointed, col, slices

HEAD = 24  # leading bytes in a range key; what follows is ordered inside the partitions
RUN_ROWS = 1 << 18  # rows of one run that go out in a batch
#: edge: 0 a run inside a partition, 1 its first run, 2 its last one, 3 its only one.
RUNS = (
    "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, "
    "part int, edge int, edge_text binary"
)


def _normalised(docs: DataFrame) -> DataFrame:
    """``doc_id, head, mix, norm``: the text with A-Z in lower case, and what its range is chosen by."""

    def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t.lower() for t in byte_strings(batch.column("text"))]
            mix = [xxhash.xxh3_128_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([t[:HEAD] for t in texts], pa.binary()),
                    pa.array(mix, pa.binary()),
                    pa.array(texts, pa.binary()),
                ],
                ["doc_id", "head", "mix", "norm"],
            )

    return docs.mapInArrow(lowered, "doc_id long, head binary, mix binary, norm binary")


class _Run:
    """Neighbours of one text: ids in falling order, nulls last."""

    def __init__(self, text: bytes, first: bool):
        self.text, self.first, self.ids = text, first, []

    def rows(self, part: int, last: bool) -> Iterator[pa.RecordBatch]:
        size = sum(map(len, self.ids))
        keep = self.ids[0][0].as_py()
        digest = hashlib.sha256(self.text).hexdigest()
        edge = self.first + 2 * last
        at = 0
        for ids in self.ids:
            for start in range(0, len(ids), RUN_ROWS):
                some = ids.slice(start, RUN_ROWS)
                n = len(some)
                head = np.arange(at, at + n) == 0
                shown = [self.text if edge and at == 0 else None] + [None] * (n - 1)
                at += n
                yield pa.RecordBatch.from_arrays(
                    [
                        some,
                        pa.array([keep] * n, pa.int64()),
                        pa.array(np.full(n, size)),
                        pa.array(head),
                        pa.array([digest] * n),
                        pa.array(np.full(n, part, "int32")),
                        pa.array(np.full(n, edge, "int32")),
                        pa.array(shown, pa.binary()),
                    ],
                    [c.split()[0] for c in RUNS.split(", ")],
                )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of a sorted partition; an open run holds its ids and one text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    run, first = None, True
    for batch in slices(batches, "norm"):
        norm, ids = batch.column("norm"), batch.column("doc_id")
        new = np.ones(batch.num_rows, bool)
        if run is not None:
            new[0] = norm[0].as_py() != run.text
        new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new).tolist()
        if run is not None and (not starts or starts[0]):
            run.ids.append(ids.slice(0, starts[0] if starts else len(ids)))
        out = []
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            if run is not None:
                out += run.rows(part, False)
            run, first = _Run(norm[a].as_py(), first), False
            run.ids.append(ids.slice(a, b - a))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if run is not None:
        yield from run.rows(part, True)


def _straddling(runs: DataFrame) -> list[tuple]:
    """``part, edge, keep_id, group_size, heads`` of edge runs whose text goes on in a neighbouring partition.

    The driver sees two rows without text for each partition; texts of
    neighbours with equal digests are compared where they lie.
    """
    edges = runs.filter("edge > 0 and edge_text is not null")
    found = edges.select("part", "edge", "keep_id", "group_size", "text_sha256").orderBy("part", "edge").collect()
    pairs = [(a, b) for a, b in zip(found, found[1:]) if a.part != b.part and a.text_sha256 == b.text_sha256]
    if not pairs:
        return []
    keys = ["part", "edge", "next_part", "next_edge"]
    near = runs.sparkSession.createDataFrame(
        [(a.part, a.edge, b.part, b.edge) for a, b in pairs], "part int, edge int, next_part int, next_edge int"
    )
    here = edges.select("part", "edge", F.col("edge_text").alias("text"))
    there = edges.select(
        F.col("part").alias("next_part"), F.col("edge").alias("next_edge"), F.col("edge_text").alias("next_text")
    )
    equal = near.join(here, ["part", "edge"]).join(there, ["next_part", "next_edge"]).filter("text = next_text")
    linked = {tuple(r) for r in equal.select(*keys).collect()}
    chains: list[list] = []
    for a, b in pairs:
        if (a.part, a.edge, b.part, b.edge) not in linked:
            continue
        if chains and chains[-1][-1] == a:
            chains[-1].append(b)
        else:
            chains.append([a, b])
    return [
        (r.part, r.edge, chain[0].keep_id, sum(x.group_size for x in chain), i == 0)
        for chain in chains
        for i, r in enumerate(chain)
    ]


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; rows are equal when their texts are, A-Z in lower case.

    Of equal texts one row stays, that of the largest id.  Rows are dealt to
    ranges of (first bytes, 128-bit hash, id) whose splitters Spark takes
    from a sample, so that neither a common beginning nor a group of copies
    makes a range large, and are sorted in them by content, spilling to disk.
    Neighbours are compared in full.  Runs that go on in the next range are
    joined by two rows a range.

    Null and empty texts are equal.  A null id is smaller than any other:
    a group that has only null ids keeps one of its rows, with a null
    ``keep_id``.  Of rows repeated with id and text one stays.  Further columns
    are not read.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    dealt = _normalised(rows).repartitionByRange("head", "mix", F.desc("doc_id"))
    runs = checkpointed(dealt.sortWithinPartitions("head", "mix", "norm", F.desc("doc_id"))
                        .select("doc_id", "norm").mapInArrow(_runs, RUNS))
    fixes = _straddling(runs)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if not fixes:
        return runs.select(*out)
    # two rows a partition at most
    table = docs.sparkSession.createDataFrame(
        fixes, "part int, edge int, all_keep long, all_size long, heads boolean"
    )
    joined = runs.join(F.broadcast(table), ["part", "edge"], "left")
    heads = F.coalesce("heads", F.lit(True))
    return joined.select(
        "doc_id",
        F.when(F.col("heads").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("kept") & heads).alias("kept"),
        "text_sha256",
    )
