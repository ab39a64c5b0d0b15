"""Exact top-k inner products by columnar branch-and-bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.llm.common import block_pairs, col

HITS = "query_id long, vec_id long, score long"


def one_vector_per_id(df: DataFrame, id_col: str, vector_col: str, value) -> DataFrame:
    """``vec_id, v`` of usable rows: id known, vector not null and all parts finite.

    ``value`` maps a component.  Of rows that share an id, the smallest vector stays.
    """
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    rows = df.select(col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.transform("v", value).alias("v"))


def nearest_first(hits: DataFrame, k: int) -> DataFrame:
    """Merge the hits of all blocks: the k best of each query, ranked."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dim_block: int = 8,
    candidate_block: int = 8192,
    query_block: int = 4096,
) -> DataFrame:
    """The k largest integer inner products of each query row: ``query_id, rank, vec_id, score``.

    Components become floor(scale * x).  ``is_query`` is a predicate on
    ``vec_id``.  A task holds a block of candidates as one array per dimension;
    a query adds the dimensions block by block and keeps only candidates whose
    partial sum plus the product of both remaining norms can still reach its
    k-th score, in ever shorter arrays.

    Null ids, and vectors null, empty or with null or non-finite parts take no
    part; of repeated ids the smallest vector stays; ties go to the smaller id;
    vectors meet only those of their own dimension.  Scores must fit a long.
    """
    rows = one_vector_per_id(vectors, id_col, vector_col, lambda x: F.floor(x * scale).cast("long"))

    def search(key, cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if cand.empty or query.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return _branch_and_bound(cand, query, k, dim_block)

    hits = block_pairs(rows, rows.filter(is_query), search, HITS, candidate_block, query_block)
    return nearest_first(hits, k)


def _branch_and_bound(cand: pd.DataFrame, query: pd.DataFrame, k: int, step: int) -> pd.DataFrame:
    cand = cand.sort_values("vec_id")
    ids = cand["vec_id"].to_numpy("int64")
    planes = np.stack(cand["v"].to_numpy()).T.astype("int64")
    queries = np.stack(query["v"].to_numpy()).astype("int64")
    dims = np.argsort(-np.abs(planes).astype("float64").sum(axis=1), kind="stable")
    planes, queries = planes[dims], queries[:, dims]
    # float sums are exact below 2**53, and faster
    largest = float(np.abs(planes).max(initial=0)) * float(np.abs(queries).max(initial=0)) * len(dims)
    kind = "float64" if largest < 2**52 else "int64"
    planes, queries = np.ascontiguousarray(planes, kind), queries.astype(kind)
    cuts = list(range(0, len(dims), step))
    mass = [np.sqrt((planes[c:].astype("float64") ** 2).sum(axis=0)) for c in cuts[1:]]
    out_q, out_v, out_s = [], [], []
    for qid, q in zip(query["vec_id"].to_numpy("int64"), queries):
        q_mass = [float(np.sqrt((q[c:].astype("float64") ** 2).sum())) for c in cuts[1:]]
        alive = np.flatnonzero(ids != qid)
        part = q[:step] @ planes[:step][:, alive] if len(alive) < len(ids) else q[:step] @ planes[:step]
        if len(alive) > 4 * k:
            lead = alive[np.argpartition(part, -4 * k)[-4 * k :]]
            floor = np.partition(q @ planes[:, lead], -k)[-k]
        else:
            floor = None
        for i, c in enumerate(cuts[1:]):
            if floor is not None:
                bound = part + q_mass[i] * mass[i][alive] * (1 + 1e-9) + 1
                keep = bound >= floor
                alive, part = alive[keep], part[keep]
            part = part + q[c : c + step] @ planes[c : c + step][:, alive]
        best = np.lexsort((ids[alive], -part))[:k]
        out_q.append(np.full(len(best), qid))
        out_v.append(ids[alive[best]])
        out_s.append(part[best].astype("int64"))
    return pd.DataFrame(
        {"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)}
    )
