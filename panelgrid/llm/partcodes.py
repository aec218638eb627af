"""Compression of vectors into one code a part, with nearest entries found by fixed pivots.

A vector is cut into parts; every part position has a codebook, refined in rounds. The distances of each part to
a few fixed pivots are computed once and stored beside the vectors. In a round the distances of the pivots to the
codebook's entries bound the distance of part and entry from below: ``|d(part, pivot) - d(entry, pivot)|`` for the best
pivot. Entries are looked at in the order of that bound, and a part is done when the next bound exceeds the
distance it has. Distances that decide are exact integers.

Vectors stay where they are read: a task packs them into blocks, and a round sends only sums and counts for each
part position and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelgrid.llm.job import column, map_batches, pack, stored, unpack

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
SCALE = 256
LIMIT = 1 << 28  # of an integer component: sums of squares of differences stay within 64 bits
BLOCK_ROWS = 4096
SLACK = 1e-12  # relative error of a square root and a difference of two


def integer_rows(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(vec_id, label, v)`` with ``floor(256 * component)``, held within ``LIMIT``; rows whose vector is null or has
    a null or non-finite component are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    held = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
    return (
        table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
        .where(F.col("x").isNotNull() & ~F.exists("x", bad))
        .select("vec_id", "label", F.transform("x", held).alias("v"))
    )


def parts_of(values: np.ndarray, parts: int) -> np.ndarray:
    """``(rows, parts, width)``; where the parts do not divide the dimension, zeros are added at its end."""
    width = -(-values.shape[1] // parts)
    full = np.zeros((len(values), parts * width), dtype=np.int64)
    full[:, : values.shape[1]] = values
    return full.reshape(len(values), parts, width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def choose_pivots(book: np.ndarray, count: int) -> np.ndarray:
    """``(parts, count, width)``: of each position's first entries, the first, then always the one farthest from those
    chosen (the lower index in a tie)."""
    out = []
    for entries in book:
        far = squared(entries, entries[0])
        chosen = [0]
        while len(chosen) < min(count, len(entries)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, squared(entries, entries[chosen[-1]]))
        out.append(entries[chosen])
    return np.stack(out)


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """``(parts, rows, pivots)`` distances of one block."""
    return np.sqrt(squared(parts.transpose(1, 0, 2)[:, :, None], pivots[:, None]).astype(np.float64))


def nearest(part: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry (the lower one in a tie) of every row, its squared distance, and the number of distances
    that were computed."""
    of_entries = np.sqrt(squared(entries[:, None], pivots[None]).astype(np.float64))
    bound = np.zeros((len(part), len(entries)))
    for p in range(len(pivots)):
        far = np.abs(to_pivots[:, p, None] - of_entries[None, :, p])
        far -= SLACK * (to_pivots[:, p, None] + of_entries[None, :, p])
        np.maximum(bound, far, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best = np.full(len(part), np.iinfo(np.int64).max)
    index = np.full(len(part), len(entries))
    left, done = np.arange(len(part)), 0
    for step in range(len(entries)):
        left = left[bound[left, step] ** 2 <= best[left].astype(np.float64) * (1 + 4 * SLACK)]
        if not len(left):
            break
        tried = order[left, step]
        distance = squared(part[left], entries[tried])
        done += len(left)
        better = (distance < best[left]) | ((distance == best[left]) & (tried < index[left]))
        best[left[better]], index[left[better]] = distance[better], tried[better]
    return index, best, done


def blocks(rows: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """One row a block: ids and labels as lists, packed integers and the parts' distances to the pivots."""
    parts = len(pivots)
    label = rows.schema["label"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(first, BLOCK_ROWS)
                values = np.array(column(own, "v").to_pylist(), dtype=np.int64).reshape(own.num_rows, dim)
                distances = pivot_distances(parts_of(values, parts), pivots)
                yield {
                    "block": [number], "ids": pa.array([column(own, "vec_id").to_pylist()]),
                    "labels": pa.array([column(own, "label").to_pylist()]),
                    "body": [pack(values.astype(np.int32).reshape(-1), distances.reshape(-1))],
                }
                number += 1

    return map_batches(rows, read, f"block long, ids array<long>, labels array<{label}>, body binary")


def opened(body: bytes, dim: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    values, distances = unpack(body)
    values = parts_of(values.astype(np.int64).reshape(-1, dim), parts)
    return values, distances.reshape(parts, len(values), -1)


def refined(table: DataFrame, book: np.ndarray, pivots: np.ndarray, dim: int) -> np.ndarray:
    """One round: every part goes to its nearest entry, and entries become the floor of their parts' mean."""
    parts, entries, width = book.shape

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            for body in column(batch, "body"):
                values, distances = opened(body.as_py(), dim, parts)
                for p in range(parts):
                    index, _, _ = nearest(values[:, p], distances[p], book[p], pivots[p])
                    np.add.at(total[p, :, 0], index, 1)
                    for i in range(width):
                        np.add.at(total[p, :, i + 1], index, values[:, p, i])
        at = np.argwhere(total[:, :, 0] > 0)
        yield {
            "part": at[:, 0], "entry": at[:, 1], "n": total[at[:, 0], at[:, 1], 0],
            "sums": pa.array(list(total[at[:, 0], at[:, 1], 1:]), pa.list_(pa.int64())),
        }

    found = map_batches(table.select("body"), read, "part int, entry int, n long, sums array<long>")
    sums = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    )
    new = book.copy()
    for r in sums.collect():  # at most one row for each entry of the codebooks
        new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def coded(table: DataFrame, book: np.ndarray, pivots: np.ndarray, dim: int, label: str) -> DataFrame:
    """block, vec_id, label, code (hex digits), error."""
    parts = len(book)
    digits = max(2, len(f"{book.shape[1] - 1:x}"))
    names = np.array([f"{i:0{digits}x}" for i in range(book.shape[1])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i, body in enumerate(column(batch, "body")):
                values, distances = opened(body.as_py(), dim, parts)
                code, error = np.full(len(values), "", dtype=f"<U{digits * parts}"), np.zeros(len(values), dtype=np.int64)
                for p in range(parts):
                    index, best, _ = nearest(values[:, p], distances[p], book[p], pivots[p])
                    code, error = np.char.add(code, names[index]), error + best
                yield {
                    "block": np.full(len(values), column(batch, "block")[i].as_py()), "vec_id": column(batch, "ids")[i].values,
                    "label": column(batch, "labels")[i].values, "code": code.tolist(), "error": error,
                }

    return map_batches(table, read, f"block long, vec_id long, label {label}, code string, error long")


def compress(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row.

    Components are ``floor(256 * x)``, held within 2**28. Rows whose vector is null or has a null or non-finite component
    are left out. Codebooks start as the parts of the first ``entries`` rows by id, then by vector (fewer rows: fewer
    entries); rows without an id come last and are coded too. Vectors have the dimension of the first row; others are left out. Repeated
    rows are rows. Equal labels are summed together, nulls too. An empty table gives no rows; other columns are ignored.
    """
    rows = integer_rows(table, key, vector, label)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    kind = rows.schema["label"].dataType.simpleString()
    if not first or not len(first[0]["v"]):
        return rows.where("false").select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"),
        )
    dim = len(first[0]["v"])
    if any(len(r["v"]) != dim for r in first):
        rows = rows.where(F.size("v") == dim)
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    book = parts_of(np.array([r["v"] for r in first], dtype=np.int64), parts).transpose(1, 0, 2)
    pivots = choose_pivots(book, PIVOTS)
    index = stored(blocks(rows.where(F.size("v") == dim), dim, pivots))
    for _ in range(rounds):
        book = refined(index, book, pivots, dim)
    found = stored(coded(index, book, pivots, dim, kind))
    # a label is one row a block before it is summed, so that a very frequent one does not meet in one task
    own = found.groupBy("block", "label").agg(F.sum("error").alias("error"))
    total = own.groupBy("label").agg(F.sum("error").alias("label_error"))
    own, total = own.select("block", "label"), total.withColumnRenamed("label", "of")
    per_block = own.join(total, own["label"].eqNullSafe(total["of"])).select(
        F.col("block").alias("in_block"), "of", "label_error"
    )
    same = (found["block"] == per_block["in_block"]) & found["label"].eqNullSafe(per_block["of"])
    return found.join(per_block, same).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256")
    )
