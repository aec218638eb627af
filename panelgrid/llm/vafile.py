"""Exact inner-product search with a vector-approximation file.

The file holds blocks of rows: each component's cell number (one byte) with the cells'
edges, and the exact integers. For a query the cells give an upper and a lower bound of
every score in a block; rows whose upper bound is below the k-th lower bound cannot be among
the first k. The exact integers of the rest are read in the order of their bounds until
the k-th score is out of reach. Queries and rows meet block by block, so a task holds one block of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelgrid.llm.job import stored

CELLS = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
READ = 64


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``(vec_id, v, dim)`` with ``floor(scale * component)``; vectors null, or with a null or non-finite
    component, and rows without an id are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return (
        table.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"), F.size("x").alias("dim"))
    )


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dim)


def build_va_file(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row a block: ids, exact integers, cells and cell edges, as bytes."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        frame = frame.sort_values("vec_id", kind="stable")
        exact = _matrix(frame["v"], dim)
        low, high = exact.min(axis=0), exact.max(axis=0)
        width = (high - low) // CELLS + 1
        cells = ((exact - low) // width).astype(np.uint8)
        return pd.DataFrame({
            "dim": [dim], "block": [int(frame["block"].iloc[0])],
            "ids": [frame["vec_id"].to_numpy(dtype=np.int64).tobytes()],
            "cells": [cells.tobytes()], "edges": [np.stack([low, width]).tobytes()], "exact": [exact.tobytes()],
        })

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInPandas(
        build, "dim int, block int, ids binary, cells binary, edges binary, exact binary"
    )


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every query's score with every row, from the cells alone."""
    near = low + cells * width
    far = near + width - 1
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return _product(up, near) + _product(down, far), _product(up, far) + _product(down, near)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in integers; by floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search_block(q_ids, q, ids, cells, low, width, exact, k: int) -> tuple[list, list, list]:
    """(place of the query, id, score) of the first ``k`` rows of a block for each query, by score, then by smaller id."""
    out: tuple[list, list, list] = ([], [], [])
    under, over = bounds(q, cells.astype(np.int64), low, width)
    for i in range(len(q_ids)):
        others = np.flatnonzero(ids != q_ids[i])
        if not len(others):
            continue
        upper = over[i][others]
        if len(others) > k:
            sure = np.partition(under[i][others], len(others) - k)[len(others) - k]
            others, upper = others[upper >= sure], upper[upper >= sure]
        order = np.lexsort((ids[others], -upper))
        best: list[tuple[int, int]] = []
        for a in range(0, len(order), READ):
            if len(best) == k and -best[-1][0] > upper[order[a]]:
                break
            rows = others[order[a : a + READ]]
            scores = exact[rows] @ q[i]
            best = sorted([*best, *zip((-scores).tolist(), ids[rows].tolist())])[:k]
        out[0].extend([i] * len(best))
        out[1].extend(b for _, b in best)
        out[2].extend(-s for s, _ in best)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, query_key: each query's ``k`` best rows other than its own, by exact inner product.

    ``vectors`` and ``queries`` are ``(vec_id, v, dim)``; only vectors of a query's dimension are compared.
    Ties go to the smaller id. Fewer rows than ``k`` are all returned; an empty table gives none. Rows that share an
    id are candidates of their own, but none of a query's id is its candidate. Queries that share an id and differ in
    their vector get a list each, told apart by ``query_key``, a hash of the vector; equal queries get one.
    """
    queries = queries.withColumn("query_key", F.xxhash64("v")).dropDuplicates(["vec_id", "dim", "query_key"])
    vectors = stored(vectors)
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    index = stored(build_va_file(vectors, blocks))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        return pd.DataFrame({
            "dim": [dim], "query_block": [int(frame["query_block"].iloc[0])],
            "q_ids": [frame["vec_id"].to_numpy(dtype=np.int64).tobytes()],
            "q_keys": [frame["query_key"].to_numpy(dtype=np.int64).tobytes()], "q": [_matrix(frame["v"], dim).tobytes()],
        })

    asked = (
        queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id", "query_key"), F.lit(query_blocks)).cast("int"))
        .groupBy("dim", "query_block")
        .applyInPandas(gather, "dim int, query_block int, q_ids binary, q_keys binary, q binary")
    )
    # each pair of blocks is one row, dealt by the block so that pairs spread over the tasks
    pairs = (
        index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        .join(asked, ["dim", "query_block"])
        .repartition("dim", "block", "query_block")
    )

    def search(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = np.frombuffer(r.ids, dtype=np.int64)
                shape = (len(ids), r.dim)
                low, width = np.frombuffer(r.edges, dtype=np.int64).reshape(2, r.dim)
                q_ids = np.frombuffer(r.q_ids, dtype=np.int64)
                found = search_block(
                    q_ids, np.frombuffer(r.q, dtype=np.int64).reshape(len(q_ids), r.dim), ids,
                    np.frombuffer(r.cells, dtype=np.uint8).reshape(shape), low, width,
                    np.frombuffer(r.exact, dtype=np.int64).reshape(shape), k,
                )
                at = np.array(found[0], dtype=np.int64)
                keys = np.frombuffer(r.q_keys, dtype=np.int64)
                yield pd.DataFrame(
                    {"query_id": q_ids[at], "query_key": keys[at], "vec_id": found[1], "score": found[2]}, dtype="int64"
                )

    near = pairs.mapInPandas(search, "query_id long, query_key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")
