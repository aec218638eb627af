"""Removal of repeated 50-byte substrings across documents.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. All
copies of such a string must meet, without shuffling a row per byte:

1. Every 50-byte string has an anchor, the smallest hash of its 16-byte strings; equal strings have
   equal anchors. Consecutive strings with one anchor are a segment (18 strings on average).
2. Anchors are exchanged by hash; those of two documents or more are marked. What has no marked
   anchor has no copy. Anchors of more than ``HOT_SEGMENTS`` segments are hot.
3. The bytes of marked segments, distinct within a chunk of documents, are exchanged by anchor. A
   task has all strings with an anchor. Where the segments of an anchor differ, strings whose hash occurs once are cut off;
   the Burrows-Wheeler transform of the runs that are left, each once, is expanded to the intervals of common prefix 50; an
   interval's smallest document is that of its string.
   (Where they are all equal there is nothing to expand.) The strings of a hot anchor are sent one by
   one by their own hash instead, so that no group grows with the number of texts around a frequent phrase.
4. Each chunk gets the smallest document of each of its strings and cuts its documents.

Documents travel in chunks of a few MB, compressed, and all messages between a chunk and a bucket of anchors are
one row, so that Spark shuffles blocks. A very frequent string is one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelgrid.llm.bwt import repeats
from panelgrid.llm.job import binary_slices, column, map_batches, pack, stored, unpack
from panelgrid.llm.text import BASE, bytes_of, mix, range_hash, slabs, sliding_min, take_ranges

LENGTH = 50
GRAM = 16  # two words of eight bytes
CHUNK_BYTES = 8 << 20  # of text; each chunk exchanges a message with each bucket
GROUP_BYTES = 16 << 20  # of chunks or messages that a reader of a stored table holds at once
PIECE_BYTES = 1 << 16  # of text hashed at a time; what is computed from them stays in the processor's cache
BUCKET_BYTES = 16 << 20  # bytes of text for each bucket of anchors
HOT_SEGMENTS = 1 << 16  # of one anchor, about 4 MB
LAST = np.iinfo(np.int64).max  # stands for a null id: after all ids
BATCH_STRINGS = 1 << 18  # of segments looked at together, where no anchor has more
BATCH_BYTES = 1 << 17  # of runs in one transform; small ones stay in the processor's cache


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, size, body): documents in blocks; body packs ids, whether they are known, offsets, bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for slab in slabs(batches, "text", CHUNK_BYTES):
            data, offsets = bytes_of(column(slab, "text"))
            ids = column(slab, "doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            body = pack(ids.fill_null(0).to_numpy(), known.view(np.uint8), offsets, data)
            yield {"chunk": [chunk], "size": [len(data)], "body": [body]}
            chunk += 1

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read, "chunk long, size long, body binary"
    )


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, as a view."""
    return np.ndarray(max(0, len(data) - 7), dtype=np.uint64, buffer=np.ascontiguousarray(data), strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``range_hash`` of the ranges, whose starts ascend, piece by piece."""
    out = np.empty(len(start), dtype=np.uint64)
    end = start + size
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + PIECE_BYTES)))
        low, high = int(start[a]), int(end[a:b].max())
        out[a:b] = range_hash(data[low:high], start[a:b] - low, end[a:b] - low)
        a = b
    return out


def least_grams(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the smallest hash of the 16-byte strings in a string of ``length`` bytes changes, and that hash from there on."""
    n = len(data) - length + 1
    words = words_at(data)
    places, values = [], []
    for a in range(0, n, PIECE_BYTES):
        piece = words[a : min(a + PIECE_BYTES, n) + length - 8]
        grams = piece[:-8] * BASE
        grams ^= grams >> np.uint64(32)
        grams += piece[8:]
        least = sliding_min(mix(grams), length - GRAM + 1)
        new = np.ones(len(least), dtype=bool)
        new[1:] = least[1:] != least[:-1]
        at = np.flatnonzero(new)
        places.append(at + a)
        values.append(least[at])
    place, value = np.concatenate(places), np.concatenate(values)
    new = np.ones(len(place), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    return place[new], value[new]


class Segments:
    """The segments of a chunk: start, number of strings, row, anchor; and the distinct anchors in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length = data, offsets, length
        n = len(data) - length + 1
        if n <= 0:
            self.start = self.count = self.row = np.empty(0, dtype=np.int64)
            self.anchor = np.empty(0, dtype=np.uint64)
        else:
            place, value = least_grams(data, length)
            # strings that begin in a row and end in it
            long = np.diff(offsets) >= length
            stops = (offsets[1:] - length + 1)[long]
            start = np.sort(np.concatenate([place, offsets[:-1][long], stops[stops < n]]))
            start = start[np.append(True, start[1:] != start[:-1])]
            row = np.searchsorted(offsets, start, side="right") - 1
            kept = start + length <= offsets[row + 1]
            count = np.diff(np.append(start, n))
            self.start, self.count, self.row = start[kept], count[kept], row[kept]
            self.anchor = mix(value[np.searchsorted(place, self.start, side="right") - 1])
        self.anchors, self.which = np.unique(self.anchor, return_inverse=True)

    def distinct(self, chosen: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contents among the chosen segments: (one segment of each, content of each chosen one,
        smallest ``order`` of each). Contents are told by anchor, length and a second hash."""
        key = mix(hashes(self.data, self.start[chosen], self.count[chosen] + self.length - 1) + self.anchor[chosen] * np.uint64(3))
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        least = np.full(len(one), LAST)
        np.minimum.at(least, which, order[chosen])
        return chosen[one], which, least

    def single(self, chosen: np.ndarray, hot: np.ndarray, order: np.ndarray) -> np.ndarray:
        """From now on the segments are the ``chosen`` ones, each ``hot`` one as its single strings with their hash as anchor; their ``order``."""
        whole, cut = chosen[~hot], chosen[hot]
        start = take_ranges(self.start[cut], self.count[cut])
        anchor = mix(hashes(self.data, start, np.full(len(start), self.length)) + np.repeat(self.anchor[cut], self.count[cut]))
        row = np.concatenate([whole, np.repeat(cut, self.count[cut])])
        start = np.concatenate([self.start[whole], start])
        by = np.argsort(start)
        self.start, row = start[by], row[by]
        self.count = np.concatenate([self.count[whole], np.ones(len(anchor), dtype=np.int64)])[by]
        self.anchor = np.concatenate([self.anchor[whole], anchor])[by]
        self.row = self.row[row]
        return order[row]

    def bytes_at(self, segment: np.ndarray) -> np.ndarray:
        return self.data[take_ranges(self.start[segment], self.count[segment] + self.length - 1)]


def opened(body: bytes, length: int) -> tuple[Segments, np.ndarray, np.ndarray]:
    """Segments of a chunk, the ids of its rows, and the id each segment counts for (null: after all)."""
    ids, known, offsets, data = unpack(body)
    rank = np.where(known.astype(bool), ids, LAST)
    segments = Segments(data, offsets, length)
    return segments, rank, rank[segments.row]


def anchor_messages(table: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, chunk, several, keys, more): the chunk's anchors of the bucket, 5 bytes each, those of several documents
    first; ``more`` has pairs of 32-bit integers: which of them have several segments, and how many."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk, body in zip(column(batch, "chunk").to_pylist(), column(batch, "body")):
                s, _, order = opened(body.as_py(), length)
                least, most = np.full(len(s.anchors), LAST), np.full(len(s.anchors), np.iinfo(np.int64).min)
                np.minimum.at(least, s.which, order)
                np.maximum.at(most, s.which, order)
                bucket = (s.anchors & np.uint64(buckets - 1)).astype(np.int64)
                by = np.lexsort((least >= most, bucket))
                small = (s.anchors[by] >> np.uint64(20)).view(np.uint8).reshape(-1, 8)[:, :5]
                met, first = np.unique(bucket[by], return_index=True)
                several = np.add.reduceat(least[by] < most[by], first) if len(first) else first
                edges = np.append(first, len(by))
                held = np.bincount(s.which, minlength=len(s.anchors))[by]
                most_held = np.flatnonzero(held > 1)
                bounds = np.searchsorted(most_held, edges)
                pairs = np.stack([most_held - np.repeat(first, np.diff(bounds)), held[most_held]], axis=1).astype(np.int32)
                yield {
                    "bucket": met, "chunk": np.full(len(met), chunk), "several": several,
                    "keys": binary_slices(np.ascontiguousarray(small).tobytes(), 5 * edges),
                    "more": binary_slices(pairs.tobytes(), 8 * bounds),
                }

    return map_batches(table.select("chunk", "body"), read, "bucket long, chunk long, several long, keys binary, more binary")


def marked_anchors(messages: DataFrame, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(chunk, bucket, marks): a bit for each key of a message, set where two documents or more have it; where keys of the
    message have more than ``hot`` segments in all chunks, bits for these follow."""

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(k) // 5 for k in frame["keys"]])
        wide = np.zeros((sizes.sum(), 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(frame["keys"]), dtype=np.uint8).reshape(-1, 5)
        keys = wide.view(np.uint64).reshape(-1)
        first = np.cumsum(sizes) - sizes
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        segments = count.copy()
        at, held = np.frombuffer(b"".join(frame["more"]), dtype=np.int32).reshape(-1, 2).T
        np.add.at(segments, which[at + np.repeat(first, [len(m) // 8 for m in frame["more"]])], held.astype(np.int64) - 1)
        count[which[take_ranges(first, frame["several"].to_numpy())]] = 2
        marks, many = count[which] > 1, segments[which] > hot
        bits = lambda flags: np.packbits(flags).tobytes()
        return pd.DataFrame({
            "chunk": frame["chunk"], "bucket": frame["bucket"],
            "marks": [
                bits(marks[a : a + n]) + (bits(many[a : a + n]) if many[a : a + n].any() else b"")
                for a, n in zip(first.tolist(), sizes.tolist())
            ],
        })

    return messages.groupBy("bucket").applyInPandas(mark, "chunk long, bucket long, marks binary")


def with_replies(table: DataFrame, replies: DataFrame) -> DataFrame:
    """Each chunk beside all replies to it, ordered by bucket; at most its own anchors."""
    gathered = replies.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("replies"))
    return table.select("chunk", "body").join(gathered, "chunk", "left")


def chosen_segments(s: Segments, order: np.ndarray, marks: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments whose anchors are marked, by the order of the keys that were sent, and whether these are hot."""
    bucket = (s.anchors & np.uint64(buckets - 1)).astype(np.int64)
    least, most = np.full(len(s.anchors), LAST), np.full(len(s.anchors), np.iinfo(np.int64).min)
    np.minimum.at(least, s.which, order)
    np.maximum.at(most, s.which, order)
    by = np.lexsort((least >= most, bucket))
    met, first = np.unique(bucket[by], return_index=True)
    sizes = np.diff(np.append(first, len(by)))
    flags, many = np.zeros(len(by), dtype=bool), np.zeros(len(by), dtype=bool)
    for b, a, n in zip(met.tolist(), first.tolist(), sizes.tolist()):
        got, own = np.frombuffer(marks[b], dtype=np.uint8), (n + 7) // 8
        flags[a : a + n] = np.unpackbits(got[:own], count=n)
        if len(got) > own:
            many[a : a + n] = np.unpackbits(got[own:], count=n)
    marked, hot = np.zeros(len(s.anchors), dtype=bool), np.zeros(len(s.anchors), dtype=bool)
    marked[by], hot[by] = flags, many
    chosen = np.flatnonzero(marked[s.which])
    return chosen, hot[s.which[chosen]]


def replies_of(row) -> dict[int, bytes]:
    return {r["bucket"]: r["reply"] for r in row or ()}


def segment_messages(table: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, chunk, block, picked): the distinct marked segments of a chunk and, in its row of bucket -1, which
    segments they stand for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk, body, replies in zip(column(batch, "chunk").to_pylist(), column(batch, "body"), column(batch, "replies").to_pylist()):
                s, _, order = opened(body.as_py(), length)
                chosen, hot = chosen_segments(s, order, replies_of(replies), buckets)
                if hot.any():
                    order = s.single(chosen, hot, order)
                    chosen = np.arange(len(order))
                one, which, least = s.distinct(chosen, order)
                bucket = (s.anchor[one] & np.uint64(buckets - 1)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                met, first = np.unique(bucket[by], return_index=True)
                edges = np.append(first, len(by))
                blocks = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    own = by[a:b]
                    blocks.append(pack(s.anchor[one[own]], least[own], s.count[one[own]].astype(np.int32), s.bytes_at(one[own])))
                place = np.empty(len(by), dtype=np.int64)
                place[by] = np.arange(len(by))
                yield {
                    "bucket": [*met.tolist(), -1], "chunk": [chunk] * (len(met) + 1),
                    "block": [*blocks, pack(s.start[chosen], s.count[chosen].astype(np.int32), place[which].astype(np.int32))],
                }

    return map_batches(table, read, "bucket long, chunk long, block binary")


def equal_ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges with equal bytes become one: (one range of each, the one that each range equals). Equal ranges have equal
    keys; where only the keys are equal, ranges stay apart. Ranges have eight bytes or more."""
    order = np.argsort(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    one = order[new]
    same = np.empty(len(key), dtype=np.int64)
    same[order] = np.cumsum(new) - 1
    other = np.flatnonzero(one[same] != np.arange(len(key)))
    differs = size[other] != size[one[same[other]]]
    words = words_at(data)
    for a in range(0, len(other), PIECE_BYTES):
        own = other[a : a + PIECE_BYTES][~differs[a : a + PIECE_BYTES]]
        n = (size[own] + 7) // 8
        step = np.minimum(8 * take_ranges(np.zeros(len(own), dtype=np.int64), n), np.repeat(size[own] - 8, n))
        unlike = words[np.repeat(start[own], n) + step] != words[np.repeat(start[one[same[own]]], n) + step]
        if unlike.any():
            differs[a : a + PIECE_BYTES][~differs[a : a + PIECE_BYTES]] = np.logical_or.reduceat(unlike, np.cumsum(n) - n)
    apart = other[differs]
    same[apart] = len(one) + np.arange(len(apart))
    return np.concatenate([one, apart]), same


def grouped(anchor: np.ndarray, size: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """The members of anchors that have several, whole anchors at a time: about ``limit`` of ``size``, or one anchor."""
    order = np.argsort(anchor)
    held = anchor[order]
    equal = np.zeros(len(order) + 1, dtype=bool)
    equal[1:-1] = held[1:] == held[:-1]
    order = order[equal[1:] | equal[:-1]]
    if not len(order):
        return
    held, total = anchor[order], np.cumsum(size[order])
    edges = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1], [True]]))
    filled = np.concatenate([[0], total])[edges]
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(filled, filled[a] + limit, side="right")) - 1)
        yield order[edges[a] : edges[b]]
        a = b


def expanded(anchor: np.ndarray, least: np.ndarray, count: np.ndarray, begin: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """The smallest document of every string of different runs, one after the other, from the transforms of their anchors."""
    size = count + length - 1
    out = np.repeat(least, count)
    at = np.cumsum(count) - count
    for own in grouped(anchor, size, BATCH_BYTES):
        wide = size[own] + 1
        text = np.zeros(wide.sum(), dtype=np.int16)
        stop = np.cumsum(wide) - 1
        inner = np.ones(len(text), dtype=bool)
        inner[stop] = False
        text[inner] = data[take_ranges(begin[own], size[own])].astype(np.int16) + 1
        places, classes = repeats(text, np.repeat(stop, wide), length)
        if not len(places):
            continue
        run = np.searchsorted(stop, places)
        smallest = np.full(int(classes.max()) + 1, LAST)
        np.minimum.at(smallest, classes, least[own][run])
        string = at[own][run] + places - (stop[run] - size[own][run])
        out[string] = smallest[classes]
    return out


def smallest_documents(anchor: np.ndarray, least: np.ndarray, count: np.ndarray, begin: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """The smallest document of every string of the segments, which differ, one after the other.

    A segment is ``count + length - 1`` bytes of ``data`` from ``begin`` on; its strings start at its first ``count`` bytes.
    A string whose hash no other string of its anchor has is in its segment alone. The others are runs, told apart as
    segments are; only anchors with different runs are expanded.
    """
    out = np.repeat(least, count)
    at = np.cumsum(count) - count
    for own in grouped(anchor, count, BATCH_STRINGS):
        n, size = count[own], count[own] + length - 1
        text = data[take_ranges(begin[own], size)]
        start = take_ranges(np.cumsum(size) - size, n)
        segment = np.repeat(np.arange(len(own)), n)
        key = mix(hashes(text, start, np.full(len(start), length)) + anchor[own][segment])
        order = np.argsort(key)
        equal = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key) + 1, dtype=bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        edge = np.ones(len(key) + 1, dtype=bool)
        edge[1:-1] = segment[1:] != segment[:-1]
        first = np.flatnonzero(again[:-1] & (edge[:-1] | ~np.concatenate([[False], again[:-2]])))
        last = np.flatnonzero(again[:-1] & (edge[1:] | ~again[1:]))
        if not len(first):
            continue
        held, whose = last - first + 1, segment[first]
        runs, begins, sizes = anchor[own][whose], start[first], held + length - 1
        one, same = equal_ranges(text, begins, sizes, mix(hashes(text, begins, sizes) + runs))
        lowest = np.full(len(one), LAST)
        np.minimum.at(lowest, same, least[own][whose])
        found = expanded(runs[one], lowest, held[one], begins[one], text, length)
        place = at[own][whose] + first - (np.cumsum(n) - n)[whose]
        out[take_ranges(place, held)] = found[take_ranges((np.cumsum(held[one]) - held[one])[same], held)]
    return out


def resolved(messages: DataFrame, length: int) -> DataFrame:
    """(chunk, bucket, reply): for each segment of a message, runs of strings with one smallest document: all lengths
    (32-bit), then all documents."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in frame["block"]]
        sent = np.cumsum([0, *[len(p[0]) for p in parts]])
        anchor, least, count, data = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        count = count.astype(np.int64)
        size = count + length - 1
        begin = np.cumsum(size) - size
        # equal segments of different chunks become one
        one, same = equal_ranges(data, begin, size, mix(hashes(data, begin, size) + anchor))
        lowest = np.full(len(one), LAST)
        np.minimum.at(lowest, same, least)
        found = smallest_documents(anchor[one], lowest, count[one], begin[one], data, length)
        at = np.cumsum(count[one]) - count[one]
        new = np.ones(len(found), dtype=bool)
        new[1:] = found[1:] != found[:-1]
        new[at] = True
        runs = np.flatnonzero(new)
        lengths, found = np.diff(np.append(runs, len(found))).astype(np.int32), found[runs]
        first = np.searchsorted(runs, at)
        held = np.diff(np.append(first, len(runs)))[same]
        run = take_ranges(first[same], held)
        lengths, found = lengths[run], found[run]
        edges = np.concatenate([[0], np.cumsum(held)])[sent]
        out = [lengths[a:b].tobytes() + found[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "reply": out})

    return messages.where("bucket >= 0").groupBy("bucket").applyInPandas(solve, "chunk long, bucket long, reply binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs as start, end in bytes), kept (the other bytes in order).

    Null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Rows that share an id do not
    remove from each other. A null id counts as larger than every id and equal to itself. Repeats inside one document stay. An
    empty table gives no rows; other columns are ignored. ``length`` must exceed ``GRAM``.
    """
    table = stored(chunks(docs), group_bytes=GROUP_BYTES)
    total = table.agg(F.sum("size")).first()[0] or 0
    buckets = 1 << min(20, max(0, int(total // bucket_bytes).bit_length()))
    marks = stored(marked_anchors(anchor_messages(table, buckets, length), hot).withColumnRenamed("marks", "reply"))
    messages = stored(segment_messages(with_replies(table, marks), buckets, length), group_bytes=GROUP_BYTES)
    replies = stored(resolved(messages, length))
    own = messages.where("bucket = -1").select("chunk", "bucket", F.col("block").alias("reply"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for body, replies in zip(column(batch, "body"), column(batch, "replies").to_pylist()):
                ids, known, offsets, data = unpack(body.as_py())
                rank = np.where(known.astype(bool), ids, LAST)
                got = sorted((r["bucket"], r["reply"]) for r in replies)
                start, count, which = unpack(got[0][1])
                parts = [r for _, r in got[1:]]
                removed = np.zeros(len(data) + 1, dtype=np.int32)
                if parts and len(start):
                    lengths = np.concatenate([np.frombuffer(r, np.int32, len(r) // 12) for r in parts]).astype(np.int64)
                    smallest = np.concatenate([np.frombuffer(r, np.int64, len(r) // 12, len(r) // 3) for r in parts])
                    sizes = np.empty(int(which.max()) + 1, dtype=np.int64)
                    sizes[which] = count
                    before = np.cumsum(lengths) - lengths
                    first = np.searchsorted(before, np.cumsum(sizes) - sizes)
                    held = np.diff(np.append(first, len(lengths)))[which]
                    run = take_ranges(first[which], held)
                    place = np.repeat(start - before[first[which]], held) + before[run]
                    row = np.repeat(np.searchsorted(offsets, start, side="right") - 1, held)
                    gone = smallest[run] < rank[row]
                    np.add.at(removed, place[gone], 1)
                    np.add.at(removed, (place + lengths[run])[gone] + length - 1, -1)
                mask = np.cumsum(removed[:-1], dtype=np.int32) > 0
                edge = np.zeros(len(data) + 1, dtype=bool)
                edge[offsets] = True
                before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
                after = np.concatenate([mask[1:], [False]]) if len(mask) else mask
                first = np.flatnonzero(mask & (~before | edge[:-1]))
                last = np.flatnonzero(mask & (~after | edge[1:])) + 1
                row = np.searchsorted(offsets, first, side="right") - 1
                bounds = np.searchsorted(first, offsets)
                spans = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(first - offsets[row], pa.int64()), pa.array(last - offsets[row], pa.int64())], ["start", "end"]
                    ),
                )
                kept = np.zeros(len(data) + 1, dtype=np.int32)
                np.cumsum(~mask, out=kept[1:])
                yield {
                    "doc_id": pa.array(ids, mask=~known.astype(bool)), "n_bytes": np.diff(offsets), "spans": spans,
                    "kept": binary_slices(data[~mask].tobytes(), kept[offsets]),
                }

    return map_batches(
        with_replies(table, replies.union(own.select("chunk", "bucket", "reply"))), cut,
        "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary",
    )
