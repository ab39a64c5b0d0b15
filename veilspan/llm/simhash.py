"""SimHash near-duplicates, compared bit-sliced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.llm.common import byte_strings, checkpointed, col, slices

SLICE = 1 << 16  # shingles whose bits are laid out at once
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of each shingle from its first one (the finishing steps of splitmix64); seed 0 keeps it."""
    if not seed:
        return h
    z = h + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, width: int = 3, seeds: int = 1) -> list[int]:
    """Signed 64-bit SimHashes of the words of a text; the first is that of the shingles' own hashes."""
    words = text.lower().split()
    if not words:
        return [0] * seeds
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return of_hashes(np.array([digest(s, 42) for s in shingles], "u8"), seeds)


def of_hashes(h: np.ndarray, seeds: int = 1) -> list[int]:
    """Signed 64-bit SimHashes of shingles that are hashed already."""
    out = []
    for seed in range(seeds):
        ones = np.zeros(64, "int64")
        for at in range(0, len(h), SLICE):
            mixed = _mixed(h[at : at + SLICE], seed).astype(">u8")
            ones += np.unpackbits(mixed.view("uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
        out.append(int(np.packbits(2 * ones > len(h)).view(">i8")[0]))
    return out


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seeds: int = 1
) -> DataFrame:
    """``doc_id, fps`` (array of ``seeds`` longs) of every whole text; no words (null, empty, blank) give 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [fingerprint(t, width, seeds) for t in byte_strings(batch.column("text"))]
            column = pa.array(fps, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "fps"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fps array<long>")


def _later(planes: np.ndarray, by: int) -> np.ndarray:
    """Bit planes moved up by ``by`` places, so that place i meets place i + by."""
    q, s = divmod(by, 64)
    moved = planes[:, q:]
    if s:
        low = moved >> np.uint64(s)
        low[:, :-1] |= moved[:, 1:] << np.uint64(64 - s)
        moved = low
    out = np.zeros_like(planes)
    out[:, : moved.shape[1]] = moved
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words, first bit lowest."""
    padded = np.zeros((bits.shape[0], -(-bits.shape[1] // 64) * 64), "uint8")
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view("uint8"), bitorder="little")[:n].astype(bool)


def _within_radius(planes: np.ndarray, by: int, valid: np.ndarray) -> np.ndarray:
    """Places whose fingerprint and that ``by`` places later differ in at most three bits.

    Two bit planes hold each distance so far, added to with carries; ``out``
    marks distances that passed three.  Stops once all places are out.
    """
    later = _later(planes, by)
    ones = np.zeros_like(valid)
    twos = np.zeros_like(valid)
    out = ~valid
    for b in range(64):
        differ = planes[b] ^ later[b]
        carry = ones & differ
        ones ^= differ
        over = twos & carry
        twos ^= carry
        out |= over
        if b % 8 == 7 and (out == FULL).all():
            break
    return ~out


def link_groups(group: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """For each place of equal ``group`` (sorted runs), one place that stands for its class of linked fingerprints.

    All runs are compared at once, one distance of places after the other; runs
    are laid out by falling size, so later distances touch fewer places.  Pairs
    are merged as they are found and never listed.
    """
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(starts, len(group)))
    order = np.argsort(-size, kind="stable")
    size = size[order]
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[order], size)])
    fp, run = fp[at], np.repeat(np.arange(len(size)), size)
    planes = _packed(
        np.unpackbits(np.ascontiguousarray(fp.astype(">i8")).view("uint8").reshape(-1, 8), axis=1).T
    )
    root = np.arange(len(fp))
    ends = np.cumsum(size)
    for by in range(1, int(size[0])):
        n = int(ends[np.searchsorted(-size, -by, "left") - 1])  # places of runs longer than by
        w = -(-n // 64)
        valid = np.zeros(n, "uint8")
        valid[: n - by] = run[: n - by] == run[by:n]
        hit = np.flatnonzero(_bits(_within_radius(planes[:, :w], by, _packed(valid[None])[0]), n))
        while len(hit):
            a, b = root[hit], root[hit + by]
            low, high = np.minimum(a, b), np.maximum(a, b)
            new = low != high
            if not new.any():
                break
            np.minimum.at(root, high[new], low[new])
            while not np.array_equal(flat := root[root], root):
                root = flat
            hit = hit[new]
    out = np.empty(len(at), "int64")
    out[at] = at[root]
    return out


def links(nodes: DataFrame, chunk: int = 2048) -> DataFrame:
    """``a, b``: nodes with a fingerprint at most three bits apart, enough to span each class.

    ``nodes`` has ``node`` (distinct) and ``fps``; the n-th fingerprints are
    compared with each other.  If two differ in at most three bits, one of
    their four quarters is equal, and one of four parts of the remaining 48
    bits too: 16 keys of 28 bits find every pair.  Keys of one node go at once.
    A key of more than ``chunk`` nodes is split by hash into chunks, and each
    pair of chunks is a group of its own: none is dropped, none exceeds a task.
    """
    fp = F.col("fp")
    each = nodes.select("node", F.posexplode("fps").alias("s", "fp"))
    keys = []
    for i in range(4):
        quarter = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        rest = [x for x in range(64) if not 16 * i <= x < 16 * i + 16]
        for j in range(4):
            part = F.lit(0).cast("long")
            bits = rest[12 * j : 12 * j + 12]
            cuts = [k for k in range(1, 12) if bits[k] != bits[k - 1] + 1]
            done = 0
            for lo, hi in zip([0, *cuts], [*cuts, 12]):
                piece = F.shiftrightunsigned(fp, bits[lo]).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
                part = part.bitwiseOR(F.shiftleft(piece, done))
                done += hi - lo
            keys.append(
                F.shiftleft(F.col("s").cast("long"), 32)
                .bitwiseOR(F.lit((4 * i + j) << 28))
                .bitwiseOR(F.shiftleft(quarter, 12))
                .bitwiseOR(part)
            )
    rows = each.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = (
        rows.join(shared, "key")
        .select("key", "fp", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp", "node")
        .repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y", "fp", "node")
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, node in _whole_groups(batches):
            classes = link_groups(group, fp)
            # the smallest node of each class: groups that share it then share their links too
            least = node.copy()
            np.minimum.at(least, classes, node)
            head = least[classes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[head != node]), pa.array(head[head != node])], ["a", "b"]
            )

    return dealt.mapInArrow(linked, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Group numbers, fingerprints and nodes of sorted batches; a group is never cut between two of them."""
    held: list[np.ndarray] = []
    names = ("key", "x", "y", "fp", "node")
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype("int64") for c in names])
        if held:
            rows = np.concatenate([held[0], rows], axis=1)
        new = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
        cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if cut:
            yield np.append(0, np.cumsum(new))[:cut], rows[3, :cut], rows[4, :cut]
        held = [rows[:, cut:]]
    if held and held[0].shape[1]:
        rows = held[0]
        new = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
        yield np.append(0, np.cumsum(new)), rows[3], rows[4]


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable over ``a, b``, for every node but the smallest ones themselves.

    Each node hands its larger neighbours below it to its smallest one, until
    every node has one; what is left is a forest, in which nodes jump to their
    parent's parent.  Links that become equal are merged in each round, so a
    dense class shrinks at once; each round ends in a checkpoint.
    """
    up = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("head"))
    up = checkpointed(up.filter("node <> head").distinct())
    while up.groupBy("node").count().filter("count > 1").limit(1).count():
        least = F.min("head").over(Window.partitionBy("node"))
        seen = up.withColumn("least", least)
        handed = seen.filter("head <> least").select(F.col("head").alias("node"), F.col("least").alias("head"))
        up = checkpointed(seen.select("node", F.col("least").alias("head")).union(handed).distinct())
    while True:
        above = up.select(F.col("node").alias("parent"), F.col("head").alias("top"))
        moved = up.join(above, F.col("head") == F.col("parent"), "left")
        moved = checkpointed(moved.select("node", "head", F.coalesce("top", "head").alias("new")))
        up = moved.select("node", F.col("new").alias("head"))
        if not moved.filter("head <> new").limit(1).count():
            return up.withColumnRenamed("head", "label")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    chunk: int = 2048,
    seeds: int = 1,
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable over links of at most three bits.

    With ``seeds`` above 1, documents also link where one of as many
    independent fingerprints is that near, which finds pairs that one
    fingerprint puts four to some twelve bits apart.

    Texts are read once; from then on only ids and fingerprints move, and
    documents of equal fingerprints are one node.  Rows with a null id get a
    fingerprint and a null component and link nothing; repeated rows get equal
    results.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, width, seeds))
    nodes = prints.filter(F.col("doc_id").isNotNull()).groupBy("fps").agg(F.min("doc_id").alias("node"))
    # an id with several texts is the head of several nodes, which are one then
    nodes = checkpointed(nodes)
    labels = components(links(nodes, chunk)).withColumnRenamed("node", "n")
    of_fps = nodes.join(labels, F.col("node") == F.col("n"), "left").select(
        "fps", F.coalesce("label", "node").alias("component")
    )
    return prints.join(of_fps, "fps", "left").select(
        "doc_id",
        F.get("fps", F.lit(0)).alias("fp"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
