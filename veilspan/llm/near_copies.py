"""Near copies by exact shingle similarity: SimHash and MinHash find candidates, whole shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import byte_strings, checkpointed, col, slices
from veilspan.llm.simhash import _mixed, components, links, of_hashes

BANDS, ROWS = 24, 5  # a pair of similarity s shares a band with 1 - (1 - s^5)^24: 0.99993 at 0.8
BLOCK = 1 << 11  # shingles hashed at once
FACTORS = (_mixed(np.arange(BANDS * ROWS, dtype="u8"), 1) | np.uint64(1))[:, None]


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a text of fewer words is one shingle, none has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "u8")
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in shingles], "u8"))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` smallest hashes; sets that share a key are candidates."""
    if not len(shingles):
        return np.empty(0, "int64")
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, "u8")
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (FACTORS * shingles[None, at : at + BLOCK]).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], "u8").view("int64")


def set_digest(shingles: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view("int64"))


def link_sets(sets: list[np.ndarray], tenths: int = 8) -> np.ndarray:
    """For each set the first one of its class, over all pairs with a Jaccard similarity of ``tenths`` / 10 or more.

    Exact: a set is counted against all others over shared elements, unless all
    later ones are in its class already.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], "int64")
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)[np.argsort(element, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(element)))
    ends = np.append(0, np.cumsum(size))
    root = np.arange(n)
    for i in range(n - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        mine = element[ends[i] : ends[i + 1]]
        many = first[mine + 1] - first[mine]
        places = np.repeat(first[mine] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        shared = np.bincount(owner[places], minlength=n)
        near = (10 + tenths) * shared >= tenths * (size + size[i])
        near &= (root != root[i]) & (shared > 0)
        if near.any():
            classes = np.append(root[near], root[i])
            root[np.isin(root, classes)] = classes.min()
    return root


def candidate_links(nodes: DataFrame) -> DataFrame:
    """``a, b`` that join all candidates: ``nodes`` (``node, keys, fps``) of near fingerprints or of a common band key.

    The bit-sliced search finds every pair of SimHashes that differ in at most
    three bits.  Pairs around the threshold differ in some ten bits; the band
    keys add those.
    """
    keys = nodes.select("node", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    shared = keys.join(heads, "key").select(F.col("node").alias("a"), F.col("head").alias("b")).filter("a <> b")
    return links(nodes.select("node", "fps")).union(shared).distinct()


def confirmed(dealt: DataFrame, width: int) -> DataFrame:
    """``a, b`` that span the classes of linked nodes of each group ``label, x, y`` of ``dealt``."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def found() -> pa.RecordBatch:
            node = np.array(nodes, "int64")
            classes = link_sets(sets)
            # the smallest node of each class: groups that share it then share their links too
            least = node.copy()
            np.minimum.at(least, classes, node)
            head = least[classes]
            return pa.RecordBatch.from_arrays(
                [pa.array(node[head != node]), pa.array(head[head != node])], ["a", "b"]
            )

        for batch in slices(batches, "text"):
            keys = zip(*(batch.column(c).to_pylist() for c in ("label", "x", "y")))
            for key, node, text in zip(keys, batch.column("node").to_pylist(), byte_strings(batch.column("text"))):
                if key != group:
                    if len(nodes) > 1:
                        yield found()
                    group, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(shingle_set(text, width))
        if len(nodes) > 1:
            yield found()

    return dealt.mapInArrow(linked, "a long, b long").distinct()


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    chunk_nodes: int = 512,
    chunk_shingles: int = 1 << 18,
) -> DataFrame:
    """``doc_id, text_hash, component`` of every row with an id: rows joined by links of a Jaccard similarity >= 0.8.

    A row's ``text_hash`` is ``xxhash64(text)``.  Texts of equal shingle sets
    (case and blanks aside; those without words are all equal) are one node.
    Nodes whose SimHashes differ in at most three bits or that share a band key
    are candidates, and all that are joined by such pairs form a candidate group.  A group's texts are brought together once,
    and all its pairs are compared over their whole shingle sets; only pairs
    that already are in one class are left out.  A group of more than
    ``chunk_nodes`` nodes or ``chunk_shingles`` shingles is dealt by hash to
    chunks, and each pair of chunks is a task's group: none is dropped.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    rows = rows.filter("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, width) for t in byte_strings(batch.column("text"))]
            columns = [
                pa.array([set_digest(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                pa.array([of_hashes(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ]
            own = [batch.column("doc_id"), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays([*own, *columns], ["doc_id", "text_hash", "node", "size", "keys", "fps"])

    prints = checkpointed(
        rows.mapInArrow(hashed, "doc_id long, text_hash long, node long, size long, keys array<long>, fps array<long>")
    )
    nodes = checkpointed(
        prints.groupBy("node").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("row"),
            F.max("size").alias("size"),
            F.first("keys").alias("keys"),
            F.first("fps").alias("fps"),
        )
    )
    grouped = components(candidate_links(nodes))
    tops = grouped.select(F.col("label").alias("node"), "label").distinct()
    members = checkpointed(
        grouped.select("node", "label").union(tops).join(nodes, "node").select("node", "label", "size", "row.*")
    )
    parts = F.greatest(F.ceil(F.count("*") / chunk_nodes), F.ceil(F.sum("size") / chunk_shingles)).cast("int")
    sized = members.groupBy("label").agg(parts.alias("parts"))
    # repeated rows of one id and text come together once
    texts = rows.join(members.select("node", "label", "doc_id", "text_hash"), ["doc_id", "text_hash"])
    texts = texts.select("node", "label", "text").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = (
        texts.join(sized, "label")
        .select("label", "node", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("label", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "text")
        .repartition("label", "x", "y")
        .sortWithinPartitions("label", "x", "y", "node")
    )
    labels = components(confirmed(dealt, width)).withColumnRenamed("label", "top")
    return (
        prints.select("doc_id", "text_hash", "node")
        .join(labels, "node", "left")
        .select("doc_id", "text_hash", F.coalesce("top", "node").alias("component"))
    )
