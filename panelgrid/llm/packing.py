"""Best-fit decreasing packing of token pieces into sequences.

Best-fit decreasing looks only at lengths, and a length is at most the capacity. So the
exact packing of any number of pieces is computed from their histogram: pieces of one
length are placed in runs, each run into a range of bins with the same free space. A
segment tree over free space finds the tightest open bins. The free space of a bin at
least halves each time a run touches its range and a length opens at most three ranges,
so there are at most 3 * capacity * log2(capacity) runs, whatever the data: that bounds
what is sent to the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelgrid.llm.job import column, map_batches, stored
from panelgrid.llm.text import slabs, take_ranges
from panelgrid.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096


class FreeSpace:
    """Open bins by free space: a stack of bin ranges at each leaf of a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, space: int) -> None:
        node = self.leaves + space
        self.open[node] = bool(self.ranges[space])
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def put(self, space: int, first: int, bins: int) -> None:
        if bins:
            self.ranges[space].append((first, bins))
            self._mark(space)

    def pop(self, space: int) -> tuple[int, int]:
        found = self.ranges[space].pop()
        self._mark(space)
        return found

    def tightest(self, need: int) -> int | None:
        """The smallest free space of at least ``need`` that some open bin has."""
        node = self.leaves + need
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs ``(length, first rank, first bin, pieces a bin, offset)`` sorted by length and rank.

    A bin that takes a piece and still has room for another of that length is then the tightest, so it
    takes as many as fit before the next bin does.
    """
    free, bins, runs = FreeSpace(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        while left:
            space = free.tightest(length)
            if space is None:
                space, each = capacity, capacity // length
                first, size = bins, -(-left // each)
                bins += size
            else:
                first, size = free.pop(space)
                each = space // length
            full, rest = min(size, left // each), 0
            if full < size:
                rest = left - full * each
            runs.append((length, rank, first, each, capacity - space))
            free.put(space - each * length, first, full)
            used = full
            if rest:
                free.put(space - rest * length, first + full, 1)
                used += 1
            free.put(space, first + used, size - used)
            placed = full * each + rest
            left, rank = left - placed, rank + placed
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of ``docs(doc_id, text, ...)``: doc_id, piece, start, length, ids_crc32, and for the placement
    bucket (one a task) and rank (among the bucket's pieces of that length). Only longer documents are cut."""
    model = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        bucket, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        code = encoder(model)
        for slab in slabs(batches, "text"):
            ids, offsets = code.encode(column(slab, "text"))
            sizes = np.diff(offsets)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = take_ranges(np.zeros(len(sizes), dtype=np.int64), pieces)
            start = number * capacity
            length = np.minimum(sizes[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = np.arange(len(length)) - first + met[ordered]
            met += np.bincount(length, minlength=capacity + 1)
            raw = memoryview(ids.tobytes())
            at = 4 * (offsets[row] + start)
            yield {
                "doc_id": column(slab, "doc_id").take(pa.array(row)),
                "piece": number,
                "start": start,
                "length": length,
                "ids_crc32": np.array([zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())], dtype=np.int64),
                "bucket": np.full(len(row), bucket),
                "rank": rank,
            }

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        cut,
        "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int, rank long",
    )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with length, bucket and rank.

    ``pieces`` is read twice and must be stored. Only the histogram of lengths, at most ``capacity``
    rows, comes to the driver.
    """
    counted = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_runs(counts, capacity)
    high = np.int64(1) << np.int64(48)
    keys = runs[:, 0] * high + runs[:, 1]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank = frame["rank"].to_numpy() + frame["base"].to_numpy()
            length = frame["length"].to_numpy()
            run = runs[np.searchsorted(keys, length * high + rank, side="right") - 1]
            step = rank - run[:, 1]
            frame["sequence_id"] = run[:, 2] + step // run[:, 3]
            frame["offset"] = run[:, 4] + step % run[:, 3] * length
            yield frame.drop(columns=["bucket", "rank", "base"])

    joined = pieces.join(bases, ["length", "bucket"])
    kept = [f for f in pieces.schema if f.name not in ("bucket", "rank")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return joined.select(*pieces.columns, "base").mapInPandas(
        lambda frames: (f[[*(x.name for x in kept), "sequence_id", "offset"]] for f in place(frames)),
        f"{schema}, sequence_id long, offset long",
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens by best-fit decreasing.

    Null or empty texts are one piece that holds the end id; repeated rows are packed as often as they
    come; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    return pack_pieces(stored(cut_pieces(docs, capacity, tokenizer)), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The packed ids: sequence_id, pieces ``(offset, doc_id, ids)`` in order. doc_id must be unique here."""
    model = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        code = encoder(model)
        for slab in slabs(batches, "text"):
            ids, offsets = code.encode(column(slab, "text"))
            yield {"doc_id": column(slab, "doc_id"), "ids": [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]}

    coded = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "doc_id long, ids binary")
    own = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    return (
        placed.join(coded, "doc_id")
        .select("sequence_id", F.struct("offset", "doc_id", own.alias("ids")).alias("piece"))
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    )
