"""Exact top-k search by inner product with vector-approximation files.

Vectors are turned into integers, floor(scale * x).  Data and queries are dealt by hash
into cells (data part, query part) of bounded size.  In a cell every data vector is
approximated by the quantised interval of each of its components; scanning the
intervals gives an upper and a lower bound of every score.  Only vectors whose upper
bound reaches the k-th best lower bound are candidates, and their exact vectors are read
in the order of their bounds until the k-th best exact score is above the next bound.
The best k of a query over all data parts are its result.

Defined results: a vector that is null or holds a null or a component that is not finite
takes no part, nor does a null id; shorter vectors count as continued by zeros; rows that
share a query's id are its own and no candidates; the same id given twice as a query counts
once, with its smallest vector; scores beyond 64 bits are cut off there; a query without
candidates has no row; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DATA_ROWS = 8192
QUERY_ROWS = 2048
CELLS = 64
STEP = 128  # queries whose bounds are held at once


def bounds(data: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) value of the quantised interval of every component."""
    low, high = data.min(axis=0), data.max(axis=0)
    width = np.maximum(1, -(-(high - low + 1) // cells))
    cell = ((data - low) // width).astype(np.uint8 if cells <= 256 else np.int32)  # the approximation
    lowest = low + cell * width
    return lowest, np.minimum(lowest + width - 1, high)


def search(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best of ``data`` for each query, ties to the smaller id."""
    largest = int(np.abs(data).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, data.shape[1])
    if largest >= 2**52:  # sums that floating point cannot hold exactly: whole numbers of any size, without bounds
        limit = 2**63 - 1
        out = []
        for q, v in zip(query_ids, queries.astype(object)):
            other = np.flatnonzero(ids != q)
            score = np.array([max(-limit - 1, min(limit, s)) for s in data[other].astype(object) @ v], dtype=np.int64)
            best = np.lexsort((ids[other], -score.astype(object)))[:k] if len(other) else other
            out.append((q, ids[other][best], score[best]))
        return out
    exact = data.astype(np.float64)
    lowest, highest = (b.astype(np.float64).T.copy() for b in bounds(data))
    out = []
    for i in range(0, len(queries), STEP):
        block = queries[i : i + STEP].astype(np.float64)
        plus, minus = np.maximum(block, 0), np.minimum(block, 0)
        upper, lower = plus @ highest + minus @ lowest, plus @ lowest + minus @ highest
        for q, v, up, lo in zip(query_ids[i : i + STEP], block, upper, lower):
            own = ids == q
            up[own] = lo[own] = -np.inf
            n = len(ids) - int(own.sum())
            sure = np.partition(lo, len(lo) - k)[len(lo) - k] if n > k else -np.inf
            order = np.flatnonzero((up >= sure) & ~own)
            order = order[np.argsort(-up[order], kind="stable")]
            got = np.zeros(0)
            while len(got) < len(order):  # read exact vectors in the order of their bounds, a run at a time
                run = order[len(got) : len(got) + 4 * k]
                got = np.concatenate([got, exact[run] @ v])
                if len(got) >= k and len(got) < len(order) and np.partition(got, len(got) - k)[len(got) - k] > up[order[len(got)]]:
                    break
            read = order[: len(got)]
            best = np.lexsort((ids[read], -got))[:k]
            out.append((q, ids[read][best], got[best].astype(np.int64)))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, data_rows: int = DATA_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, embedding) of data and queries → query_id, rank, vec_id, score."""
    finite = F.expr("vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('Infinity'))")
    whole = F.expr(f"transform(embedding, x -> floor({scale}D * double(x)))")
    clean = lambda df: df.filter("embedding IS NOT NULL").filter(finite).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))
    data, asked = clean(vectors), clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-data.count() // data_rows))
    query_parts = max(1, -(-asked.count() // query_rows))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = data.withColumn("p", part(parts)).withColumn("q", everywhere(query_parts))
    asked = asked.withColumn("q", part(query_parts)).withColumn("p", everywhere(parts))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(left) or not len(right):
            return empty
        width = max(left["v"].map(len).max(), right["v"].map(len).max())
        padded = lambda s: np.stack([np.pad(np.asarray(v, np.int64), (0, width - len(v))) for v in s])
        found = search(left["id"].to_numpy(np.int64), padded(left["v"]), right["id"].to_numpy(np.int64), padded(right["v"]), k)
        return pd.concat([empty, *(pd.DataFrame({"query_id": q, "vec_id": i, "score": s}) for q, i, s in found)], ignore_index=True)

    near = data.groupBy("p", "q").cogroup(asked.groupBy("p", "q")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
