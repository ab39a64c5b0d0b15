"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import block_pairs, checkpointed, hash_sample
from veilspan.llm.topk import nearest_first, one_vector_per_id

HITS = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of the first and second half of the vectors of one dimension, and the rows of each cell."""

    first: np.ndarray
    second: np.ndarray
    cells: np.ndarray

    def cell(self, v: np.ndarray) -> np.ndarray:
        cut = self.first.shape[1]
        return _nearest(v[:, :cut], self.first) * len(self.second) + _nearest(v[:, cut:], self.second)

    def traverse(self, q: np.ndarray, want: int) -> np.ndarray:
        """Marks cells by falling summed inner product of centroid pairs until ``want`` rows are in them.

        A heap holds the frontier: a pair is entered once the pairs before it
        in either half were taken.
        """
        cut = self.first.shape[1]
        a, b = self.first @ q[:cut], self.second @ q[cut:]
        i_order, j_order = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = (-a[i_order]).tolist(), (-b[j_order]).tolist()
        n, m = len(a), len(b)
        marked = np.zeros(n * m, bool)
        reached = [0] * n  # of each row of pairs, how many were taken
        heap = [(a[0] + b[0], 0, 0)]
        got = 0
        while heap and got < want:
            _, i, j = heapq.heappop(heap)
            cell = i_order[i] * m + j_order[j]
            marked[cell] = True
            got += int(self.cells[cell])
            reached[i] = j + 1
            if j + 1 < m and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i + 1 < n and reached[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        return marked


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * v @ centroids.T, axis=1)


def _centroids(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from distinct rows spread evenly over the sample."""
    v = np.unique(v, axis=0)
    k = min(k, len(v))
    c = v[np.random.default_rng(5).permutation(len(v))[:k]]
    for _ in range(rounds):
        own = _nearest(v, c)
        n = np.bincount(own, minlength=k)
        for d in range(v.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(own, v[:, d], k) / np.maximum(n, 1), c[:, d])
    return c


def fit(rows: DataFrame, centroids: int = 32, sample_rows: int = 8192) -> dict[int, MultiIndex]:
    """An index for each dimension.  Centroids are fitted on ``sample_rows`` vectors by hash order; every row is counted in."""
    sample = [np.array(r.v) for r in hash_sample(rows, "vec_id", sample_rows).collect()]
    out = {}
    for dim in sorted({len(v) for v in sample}):
        v = np.stack([x for x in sample if len(x) == dim])
        cut = dim // 2
        halves = _centroids(v[:, :cut], centroids), _centroids(v[:, cut:], centroids)
        out[dim] = MultiIndex(*halves, np.zeros(len(halves[0]) * len(halves[1]), "int64"))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, same in batch.groupby(batch["v"].str.len()):
                if dim in out:
                    yield pd.DataFrame({"dim": dim, "cell": out[dim].cell(np.stack(same["v"].to_numpy()))})

    counts = rows.select("v").mapInPandas(cells, "dim int, cell int").groupBy("dim", "cell").count()
    for r in counts.collect():  # centroids squared rows at most
        out[r.dim].cells[r.cell] = r["count"]
    return out


def approximate_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    visit: float = 0.6,
    centroids: int = 32,
    sample_rows: int = 8192,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    candidate_block: int = 8192,
    query_block: int = 4096,
) -> DataFrame:
    """The k largest inner products found for each query row: ``query_id, rank, vec_id, score``.

    A query takes centroid pairs from a heap until their cells hold ``visit``
    of all rows (and 4k rows at least), then reranks the rows of these cells by
    the inner product of the original vectors.  Visits are decided on the whole
    index, so the result does not depend on how rows are dealt to tasks; a task
    holds a block of rows and a block of queries.

    Null ids, and vectors null, empty, zero or with null or non-finite parts
    take no part; of repeated ids the smallest vector stays; ties go to the
    smaller id; vectors meet only those of their own dimension (one that the
    sample of ``sample_rows`` missed is searched whole).
    """
    rows = one_vector_per_id(vectors, id_col, vector_col, lambda x: x)
    rows = checkpointed(rows.filter(F.exists("v", lambda x: x != 0)))
    index = fit(rows, centroids, sample_rows)
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for v in batch.column("v").to_pylist():
                one = sent.value.get(len(v))
                want = 0 if one is None else max(visit * one.cells.sum(), 4 * k)
                marks.append(None if one is None else np.packbits(one.traverse(np.array(v), want)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(marks, pa.binary())], ["vec_id", "v", "marks"]
            )

    queries = rows.filter(is_query).mapInArrow(plan, "vec_id long, v array<double>, marks binary")

    def search(key, cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if cand.empty or query.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        return _rerank(sent.value.get(key[0]), cand, query, k)

    return nearest_first(block_pairs(rows, queries, search, HITS, candidate_block, query_block), k)


def _rerank(index: MultiIndex | None, cand: pd.DataFrame, query: pd.DataFrame, k: int) -> pd.DataFrame:
    v = np.stack(cand["v"].to_numpy())
    ids = cand["vec_id"].to_numpy("int64")
    cell = np.zeros(len(v), "int64") if index is None else index.cell(v)
    order = np.lexsort((ids, cell))
    v, ids, cell = v[order], ids[order], cell[order]
    out = []
    for qid, q, marks in zip(query["vec_id"].to_numpy("int64"), query["v"], query["marks"]):
        seen = ids != qid
        if marks is not None:
            seen &= np.unpackbits(np.frombuffer(marks, "uint8")).astype(bool)[cell]
        at = np.flatnonzero(seen)
        if not len(at):
            continue
        score = v[at] @ np.asarray(q)
        if len(at) > 4 * k:
            least = np.partition(score, -k)[-k]
            some = score >= least - 1e-9
            at, score = at[some], score[some]
        # one way of summing for every score, whatever the block
        score = np.array([np.dot(v[i], q) for i in at])
        best = np.lexsort((ids[at], -score))[:k]
        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at[best]], "score": score[best]}))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )
    return pd.concat(out)
