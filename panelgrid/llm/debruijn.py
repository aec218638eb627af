"""Removal of repeated word windows by a compacted De Bruijn graph.

An edge is a window of ``LENGTH`` consecutive words, from the node of its first ``LENGTH - 1`` words to that of its last.
A word goes if an edge that covers it also begins in a document with a smaller id.

1. Every node has an anchor, the smallest hash of its ``GRAM``-word strings, so all occurrences of a node have one
   anchor. Anchors found in one document only cannot belong to a repeated edge.
2. Runs of nodes with one marked anchor are exchanged by anchor as sequences of node hashes, with the node before and
   the node after, distinct within a chunk of documents. A task sees every edge into and out of its nodes: it finds the
   repeated edges, each edge's source (its first place in the document of the smallest id), and whether a node is
   passed straight: one repeated edge in, one out, of consecutive sources. Edges joined by such nodes are pieces.
3. Pieces whose first node is passed straight continue a piece of another task. Joins on source and place link
   them, each round doubling the distance, until every piece knows the head of its nonbranching path.
4. A chunk merges its edges into spans that run along one path at a constant distance from their source. The
   chunk that holds the source hashes the same stretch of its own text by a second hash of its words; spans that differ
   are not removed.

The edges of anchors with more than ``HOT_RUNS`` runs are exchanged one by one by their own hash and make paths of one edge, so that
no group grows with the texts around a frequent phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelgrid.llm.job import binary_slices, column, map_batches, pack, stored, unpack
from panelgrid.llm.substrings import LAST, with_replies
from panelgrid.llm.text import (
    BASE, NOT_SPACE, bytes_of, mix, powers, range_hash, slabs, sliding_min, split_words, take_ranges,
)

LENGTH = 50
GRAM = 8
BUCKET_BYTES = 16 << 20  # of text for each bucket of anchors
HOT_RUNS = 1 << 16
GRID = 512  # spans are compared with their source in stretches that end at multiples of this
ROW_BITS = 16  # rows of a chunk; a row's number is the chunk's, then its place there
OWN, HEADS, FAILED = -1, -2, -3  # bucket numbers of a chunk's own notes


def word_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, size, body): documents in blocks; body packs ids, whether they are known, offsets, bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for slab in slabs(batches, "text"):
            for first in range(0, slab.num_rows, 1 << ROW_BITS):
                own = slab.slice(first, 1 << ROW_BITS)
                data, offsets = bytes_of(column(own, "text"))
                ids = column(own, "doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                body = pack(ids.fill_null(0).to_numpy(), known.view(np.uint8), offsets, data)
                yield {"chunk": [chunk], "size": [len(data)], "body": [body]}
                chunk += 1

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read, "chunk long, size long, body binary"
    )


@dataclass
class Chunk:
    """Words of a chunk; ``bounds[d]:bounds[d + 1]`` are those of row ``d``, ``rank`` its id (null: after all)."""

    ids: np.ndarray
    known: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def rank(self) -> np.ndarray:
        return np.where(self.known, self.ids, LAST)


def opened(body: bytes) -> Chunk:
    ids, known, offsets, data = unpack(body)
    words = split_words(data, offsets, NOT_SPACE)
    return Chunk(ids, known.astype(bool), data, words.start, words.end, words.bounds)


def sums_of(hashes: np.ndarray) -> np.ndarray:
    up, _ = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return total


def stretch(total: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hash of ``length`` entries from each ``start`` on, from the sums of all."""
    _, down = powers(len(total))
    return mix((total[start + length] - total[start]) * down[start])


@dataclass
class Nodes:
    """The nodes of a chunk's rows that have at least one edge: their hash, anchor, first word and row."""

    hash: np.ndarray
    anchor: np.ndarray
    word: np.ndarray
    row: np.ndarray


def nodes_of(c: Chunk, length: int) -> Nodes:
    size = np.diff(c.bounds)
    rows = np.flatnonzero(size >= length)
    count = size[rows] - length + 2
    word = take_ranges(c.bounds[rows], count)
    if not len(word):
        none = np.empty(0, dtype=np.int64)
        return Nodes(none.astype(np.uint64), none.astype(np.uint64), none, none)
    total = sums_of(range_hash(c.data, c.start, c.end))
    grams = stretch(total, np.arange(len(c.start) - GRAM + 1), GRAM)
    least = sliding_min(grams, length - GRAM)
    return Nodes(stretch(total, word, length - 1), mix(least[word]), word, np.repeat(rows, count))


def anchors(table: DataFrame, length: int) -> DataFrame:
    """(chunk, anchor, least, most, runs): a chunk's distinct anchors, the smallest and largest id, the number of runs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk, body in zip(column(batch, "chunk").to_pylist(), column(batch, "body")):
                c = opened(body.as_py())
                n = nodes_of(c, length)
                first = run_starts(n)
                key, order = n.anchor[first], np.argsort(n.anchor[first], kind="stable")
                rank = c.rank[n.row[first]][order]
                held = key[order]
                edges = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else first
                pick = lambda f: f.reduceat(rank, edges) if len(edges) else edges
                yield {
                    "chunk": np.full(len(edges), chunk), "anchor": held[edges].view(np.int64), "least": pick(np.minimum),
                    "most": pick(np.maximum), "runs": np.diff(np.append(edges, len(held))),
                }

    return map_batches(
        table.select("chunk", "body"), read, "chunk long, anchor long, least long, most long, runs long"
    )


def run_starts(n: Nodes) -> np.ndarray:
    """Where runs of consecutive nodes of one row and one anchor begin."""
    new = np.ones(len(n.hash), dtype=bool)
    new[1:] = (n.anchor[1:] != n.anchor[:-1]) | (n.row[1:] != n.row[:-1])
    return np.flatnonzero(new)


def marked(found: DataFrame, hot: int) -> DataFrame:
    """(chunk, anchors, many): each chunk's anchors that two documents or more have, and those among them that are hot."""
    shared = found.groupBy("anchor").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("runs").alias("n")
    ).where("least < most").select("anchor", (F.col("n") > hot).alias("many"))
    own = found.select("chunk", "anchor").join(shared, "anchor")
    return own.groupBy("chunk").agg(
        F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("many"), F.col("anchor"))).alias("many")
    )


def is_in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def run_messages(table: DataFrame, marks: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, chunk, block): the distinct marked runs of a chunk, and in its own row where they occur.

    A run is its key, number of nodes, the nodes' hashes with one before and one after (0 where the row ends), whether it is cut
    from a hot anchor, and its least place: rank, row number and word; and the largest rank that has it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            names = ("chunk", "body", "anchors", "many")
            for chunk, body, keys, many in zip(*(column(batch, name) for name in names)):
                chunk, c = chunk.as_py(), opened(body.as_py())
                n = nodes_of(c, length)
                as_keys = lambda a: np.asarray(a.values if a.is_valid else [], dtype=np.int64).view(np.uint64)
                first = run_starts(n)
                count = np.diff(np.append(first, len(n.hash)))
                chosen = is_in(n.anchor[first], as_keys(keys))
                first, count = first[chosen], count[chosen]
                hot = is_in(n.anchor[first], as_keys(many))
                cut = take_ranges(first[hot], count[hot])
                first = np.concatenate([first[~hot], cut])
                count = np.concatenate([count[~hot], np.ones(len(cut), dtype=np.int64)])
                alone = np.arange(len(first)) >= len(first) - len(cut)
                inner = n.hash.copy()
                padded = np.concatenate([np.zeros(1, dtype=np.uint64), inner, np.zeros(1, dtype=np.uint64)])
                ends = np.concatenate([n.row[1:] != n.row[:-1], [True]]) if len(n.row) else np.empty(0, dtype=bool)
                begins = np.concatenate([[True], ends[:-1]]) if len(ends) else ends
                flat = padded[take_ranges(first, count + 2)]
                size = count + 2
                at = np.cumsum(size) - size
                if len(first):
                    flat[at[begins[first] | alone]] = 0
                    flat[(at + size - 1)[ends[first + count - 1]]] = 0
                key = n.anchor[first] if len(first) else n.anchor[:0]
                key[alone] = mix(flat[at[alone] + 1] * BASE + flat[at[alone] + 2])
                total = sums_of(flat)
                content = stretch(total, at, size) + size.astype(np.uint64) + alone.astype(np.uint64) if len(at) else key
                row, word = n.row[first], n.word[first]
                word = word - c.bounds[row]
                order = np.lexsort((word, row, c.rank[row]))
                _, one, which = np.unique(content[order], return_index=True, return_inverse=True)
                most = np.full(len(one), np.iinfo(np.int64).min)
                np.maximum.at(most, which, c.rank[row[order]])
                one = order[one]
                bucket = (key[one] & np.uint64(buckets - 1)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                met, begin = np.unique(bucket[by], return_index=True)
                blocks = []
                for a, b in zip(begin.tolist(), np.append(begin[1:], len(by)).tolist()):
                    own = one[by[a:b]]
                    blocks.append(pack(
                        count[own].astype(np.int32), alone[own].view(np.uint8), c.rank[row[own]], (chunk << ROW_BITS) | row[own],
                        word[own], most[by[a:b]], flat[take_ranges(at[own], size[own])],
                    ))
                place = np.empty(len(by), dtype=np.int64)
                place[by] = np.arange(len(by))
                notes = pack(
                    n.word[first[order]], count[order].astype(np.int32), place[which].astype(np.int32), row[order].astype(np.int32),
                )
                yield {"bucket": [*met.tolist(), OWN], "chunk": [chunk] * (len(met) + 1), "block": [*blocks, notes]}

    joined = table.select("chunk", "body").join(marks, "chunk", "left")
    return map_batches(joined, read, "bucket long, chunk long, block binary")


def groups(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pairs (u, v), where equal ones begin in it, and each pair's group."""
    order = np.lexsort((v, u))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


@dataclass
class Edges:
    """Distinct edges, those of several documents first told by ``repeated``; their source and the group of each occurrence."""

    u: np.ndarray
    v: np.ndarray
    rank: np.ndarray
    source: np.ndarray
    word: np.ndarray
    repeated: np.ndarray
    which: np.ndarray


def edges_of(u, v, rank, source, word, most) -> Edges:
    """Occurrences come by ascending (rank, source, word), so the first of a group is its source."""
    order, first, which = groups(u, v)
    one = order[first]
    highest = np.maximum.reduceat(most[order], first) if len(first) else most[:0]
    return Edges(u[one], v[one], rank[one], source[one], word[one], rank[one] < highest, which)


def straight(out: Edges, into: Edges) -> np.ndarray:
    """For every distinct outgoing edge: whether its first node has one repeated edge in and one out, of consecutive sources."""
    o, i = np.flatnonzero(out.repeated), np.flatnonzero(into.repeated)
    i = i[np.argsort(into.v[i], kind="stable")]
    tails, n_out = np.unique(out.u[o], return_counts=True)
    heads, first, n_in = np.unique(into.v[i], return_index=True, return_counts=True)
    glued = np.zeros(len(out.u), dtype=bool)
    if len(o) and len(i):
        at = np.minimum(np.searchsorted(heads, out.u[o]), len(heads) - 1)
        before = i[first[at]]
        glued[o] = (
            (n_out[np.searchsorted(tails, out.u[o])] == 1) & (heads[at] == out.u[o]) & (n_in[at] == 1)
            & (into.source[before] == out.source[o]) & (into.word[before] + 1 == out.word[o])
        )
    return glued


def solved(messages: DataFrame) -> DataFrame:
    """(chunk, bucket, reply): for each run of a message, stretches of edges along one piece; and in a row of chunk -1
    the bucket's pieces: source row, first word, end, whether the first node is passed straight."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in frame["block"]]
        count, alone, rank, source, word, most = (np.concatenate([p[i] for p in parts]) for i in range(6))
        count = count.astype(np.int64)
        flat = np.concatenate([p[6] for p in parts])
        size = count + 2
        at = np.cumsum(size) - size
        by = np.lexsort((word, source, rank))
        # every node of every run, runs by ascending source
        node = take_ranges(at[by] + 1, count[by])
        run = np.repeat(by, count[by])
        step = node - at[run] - 1
        nxt, prv = flat[node + 1] != 0, flat[node - 1] != 0
        own = np.flatnonzero(nxt)
        out = edges_of(flat[node[own]], flat[node[own] + 1], rank[run[own]], source[run[own]], (word[run] + step)[own], most[run[own]])
        enter = np.flatnonzero(prv & (alone[run] == 0))
        into = edges_of(
            flat[node[enter] - 1], flat[node[enter]], rank[run[enter]], source[run[enter]], (word[run] + step)[enter] - 1, most[run[enter]]
        )
        glued = straight(out, into)
        glued[out.which[alone[run[own]] > 0]] = False
        # pieces: repeated edges by source, cut where the node between is not passed straight
        o = np.flatnonzero(out.repeated)
        o = o[np.lexsort((out.word[o], out.source[o]))]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (out.source[o][1:] != out.source[o][:-1]) | (out.word[o][1:] != out.word[o][:-1] + 1) | ~glued[o][1:]
        first = np.flatnonzero(new)
        piece = np.full(len(out.u), -1)
        piece[o] = np.repeat(out.word[o][first], np.diff(np.append(first, len(o))))
        last = np.append(first[1:], len(o)) - 1
        pieces = pack(out.source[o][first], out.word[o][first], out.word[o][last] + 1, glued[o][first].view(np.uint8))
        # what each node's outgoing edge is, in the order of the messages; -1 where it is not repeated
        place = np.empty(int(count.sum()), dtype=np.int64)
        begin = np.cumsum(count) - count
        place[begin[run] + step] = np.arange(len(node))
        edge = np.full(len(node), -1)
        edge[own] = np.where(out.repeated[out.which], out.which, -1)
        edge = edge[place]
        table = lambda a: np.where(edge >= 0, a[edge] if len(a) else -1, -1)
        e_rank, e_source, e_word, e_piece = (table(a) for a in (out.rank, out.source, out.word, piece))
        out_rows, low, low_run = [], 0, 0
        for p in parts:
            high = low + int(count[low_run : low_run + len(p[0])].sum())
            s = slice(low, high)
            cut = np.ones(high - low, dtype=bool)
            cut[1:] = (
                (e_source[s][1:] != e_source[s][:-1]) | (e_piece[s][1:] != e_piece[s][:-1])
                | ((e_source[s][1:] >= 0) & (e_word[s][1:] != e_word[s][:-1] + 1))
            )
            cut[begin[low_run : low_run + len(p[0])] - low] = True
            runs = np.flatnonzero(cut)
            lengths = np.diff(np.append(runs, high - low))
            out_rows.append(pack(lengths.astype(np.int32), e_rank[s][runs], e_source[s][runs], e_word[s][runs], e_piece[s][runs]))
            low, low_run = high, low_run + len(p[0])
        bucket = int(frame["bucket"].iloc[0])
        return pd.DataFrame({
            "chunk": [*frame["chunk"].tolist(), -1], "bucket": [*frame["bucket"].tolist(), bucket], "reply": [*out_rows, pieces],
        })

    return messages.where("bucket >= 0").groupBy("bucket").applyInPandas(solve, "chunk long, bucket long, reply binary")


def path_heads(replies: DataFrame) -> DataFrame:
    """(source, piece, head, end): the first word of the nonbranching path of every piece, and the piece's end.

    A round joins every open piece with the piece that its link points to and takes over that one's link, so links grow twice as long
    each round and end at a piece that no other continues into.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for body in column(batch, "reply"):
                source, piece, end, glued = unpack(body.as_py())
                yield {"source": source, "piece": piece, "end": end, "glued": glued}

    pieces = stored(map_batches(
        replies.where("chunk = -1").select("reply"), read, "source long, piece long, end long, glued int"
    ))
    before = pieces.select("source", F.col("end").alias("piece"), F.col("piece").alias("prior"), F.col("glued").alias("open"))
    links = stored(
        pieces.join(before.where("piece IS NOT NULL"), ["source", "piece"], "left").select(
            "source", "piece", "end",
            F.when(F.col("glued") == 1, F.coalesce("prior", "piece")).otherwise(F.col("piece")).alias("head"),
            ((F.col("glued") == 1) & (F.coalesce("open", F.lit(0)) == 1)).alias("open"),
        )
    )
    while links.where("open").limit(1).count():
        known = links.select("source", F.col("piece").alias("head"), F.col("head").alias("farther"), F.col("open").alias("goes_on"))
        moved = links.where("open").join(known, ["source", "head"]).select(
            "source", "piece", "end", F.col("farther").alias("head"), F.col("goes_on").alias("open")
        )
        links = stored(links.where("NOT open").unionByName(moved))
    return links.select("source", "piece", "head", "end")


def stretches(notes: bytes, replies: list[tuple[int, bytes]], rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches of a chunk that have an earlier source: first word in the chunk, edges, source row, source word, piece."""
    word, count, place, row = unpack(notes)
    if not len(word) or not replies:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    parts = [unpack(r) for _, r in sorted(replies)]
    lengths, s_rank, source, s_word, piece = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(5))
    sizes = np.empty(int(place.max()) + 1, dtype=np.int64)
    sizes[place] = count
    ends = np.cumsum(sizes)
    reply_at = np.cumsum(lengths) - lengths
    low = np.searchsorted(reply_at, ends - sizes)
    high = np.searchsorted(reply_at, ends)
    n = (high - low)[place]
    chosen = take_ranges(low[place], n)
    own = np.repeat(np.arange(len(word)), n)
    at = word[own] + reply_at[chosen] - (ends - sizes)[place][own]
    kept = (source[chosen] >= 0) & (s_rank[chosen] < rank[row[own]])
    chosen, at = chosen[kept], at[kept]
    order = np.argsort(at, kind="stable")
    chosen = chosen[order]
    return at[order], lengths[chosen], source[chosen], s_word[chosen], piece[chosen]


def spans_of(found: tuple[np.ndarray, ...], heads: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches merged into spans along one path, cut where the source passes a multiple of ``GRID``:
    first word in the chunk, edges, source row, source word. ``heads`` are rows of (source, piece, head, end) by source and piece."""
    at, n, source, word, piece = found
    if not len(at):
        return at, n, source, word
    order = np.lexsort((heads[:, 1], heads[:, 0]))
    heads = heads[order]
    keys, which = np.unique(np.concatenate([heads[:, :2], np.stack([source, piece], axis=1)]), axis=0, return_inverse=True)
    which = which.reshape(-1)
    path = np.full(len(keys), -1)
    end = np.full(len(keys), -1)
    path[which[: len(heads)]], end[which[: len(heads)]] = heads[:, 2], heads[:, 3]
    own = which[len(heads) :]
    kept = (path[own] >= 0) & (word + n <= end[own])  # a stretch lies on its path
    at, n, source, word, head = at[kept], n[kept], source[kept], word[kept], path[own][kept]
    if not len(at):
        return at, n, source, word
    new = np.ones(len(at), dtype=bool)
    new[1:] = (
        (at[1:] != at[:-1] + n[:-1]) | (source[1:] != source[:-1]) | (word[1:] != word[:-1] + n[:-1]) | (head[1:] != head[:-1])
    )
    first = np.flatnonzero(new)
    n = np.add.reduceat(n, first)
    at, source, word = at[first], source[first], word[first]
    pieces = (word + n - 1) // GRID - word // GRID + 1
    owner = np.repeat(np.arange(len(at)), pieces)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = np.maximum(word[owner], (word[owner] // GRID + step) * GRID)
    high = np.minimum(word[owner] + n[owner], (word[owner] // GRID + step + 1) * GRID)
    return at[owner] + low - word[owner], high - low, source[owner], low


def second_sums(c: Chunk) -> np.ndarray:
    """Sums of a second hash of the words, that no earlier step has used."""
    return sums_of(mix(range_hash(c.data ^ np.uint8(0x5A), c.start, c.end) + BASE))


def read_notes(replies: list[dict]) -> tuple[bytes, list[tuple[int, bytes]], np.ndarray, np.ndarray]:
    """A chunk's own notes, the replies of buckets, heads of pieces and failed spans."""
    by = {r["bucket"]: r["reply"] for r in replies or () if r["bucket"] < 0}
    table = lambda key: np.frombuffer(by.get(key, b""), dtype=np.int64).reshape(-1, 4)
    return by[OWN], [(r["bucket"], r["reply"]) for r in replies if r["bucket"] >= 0], table(HEADS), table(FAILED)


def noted(rows: DataFrame, bucket: int, columns: list[str]) -> DataFrame:
    """(chunk, bucket, reply): rows of four longs gathered by chunk, as bytes; a chunk has at most as many as it sent."""
    gathered = rows.groupBy("chunk").agg(*[F.collect_list(F.col(c)).alias(c) for c in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lists = [column(batch, c) for c in columns]
            body = [
                np.stack([np.asarray(a[i].values, dtype=np.int64) for a in lists], axis=1).tobytes() for i in range(batch.num_rows)
            ]
            yield {"chunk": column(batch, "chunk"), "bucket": np.full(len(body), bucket), "reply": body}

    return map_batches(gathered, read, "chunk long, bucket long, reply binary")


def pieces_met(table: DataFrame, replies: DataFrame) -> DataFrame:
    """(chunk, source, piece): the pieces along which a chunk has stretches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk, body, replies in zip(column(batch, "chunk").to_pylist(), column(batch, "body"), column(batch, "replies").to_pylist()):
                ids, known, _, _ = unpack(body.as_py())
                notes, got, _, _ = read_notes(replies)
                _, _, source, _, piece = stretches(notes, got, np.where(known.astype(bool), ids, LAST))
                both = np.unique(np.stack([source, piece], axis=1), axis=0)
                yield {"chunk": np.full(len(both), chunk), "source": both[:, 0], "piece": both[:, 1]}

    return map_batches(with_replies(table, replies), read, "chunk long, source long, piece long")


def span_hashes(table: DataFrame, replies: DataFrame, length: int) -> DataFrame:
    """(chunk, source, word, n, hash): a chunk's distinct spans with the second hash of their words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk, body, replies in zip(column(batch, "chunk").to_pylist(), column(batch, "body"), column(batch, "replies").to_pylist()):
                notes, got, heads, _ = read_notes(replies)
                c = opened(body.as_py())
                at, n, source, word = spans_of(stretches(notes, got, c.rank), heads, length)
                h = stretch(second_sums(c), at, n + length - 1).view(np.int64)
                rows = np.unique(np.stack([source, word, n, h], axis=1), axis=0)
                yield {
                    "chunk": np.full(len(rows), chunk), "source": rows[:, 0], "word": rows[:, 1], "n": rows[:, 2], "hash": rows[:, 3],
                }

    return map_batches(with_replies(table, replies), read, "chunk long, source long, word long, n long, hash long")


def differing(table: DataFrame, hashes: DataFrame, length: int) -> DataFrame:
    """(source, word, n, hash): spans whose source has other words."""
    asked = hashes.select("source", "word", "n", "hash").distinct().withColumn("chunk", F.shiftright("source", ROW_BITS))
    notes = noted(asked, OWN, ["source", "word", "n", "hash"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for body, asked in zip(column(batch, "body"), column(batch, "reply")):
                c = opened(body.as_py())
                rows = np.frombuffer(asked.as_py(), dtype=np.int64).reshape(-1, 4)
                at = c.bounds[rows[:, 0] & ((1 << ROW_BITS) - 1)] + rows[:, 1]
                rows = rows[stretch(second_sums(c), at, rows[:, 2] + length - 1).view(np.int64) != rows[:, 3]]
                yield dict(zip(("source", "word", "n", "hash"), rows.T.copy()))

    return map_batches(
        table.select("chunk", "body").join(notes, "chunk"), read, "source long, word long, n long, hash long"
    )


def remove_repeated_windows(
    docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT_RUNS
) -> DataFrame:
    """doc_id, n_words, spans (removed runs of words as start, end), kept (the other words, joined by one space).

    Words are runs without ASCII white space, unchanged. Null and empty texts have none; texts of fewer than ``length`` words lose
    nothing. Rows that share an id do not remove from each other. A null id counts as larger than every id and
    equal to itself. Repeats inside one document stay. An empty table gives no rows; other columns are ignored.
    ``length`` must exceed ``GRAM`` by two at least.
    """
    table = stored(word_chunks(docs))
    total = table.agg(F.sum("size")).first()[0] or 0
    buckets = 1 << int(total // bucket_bytes).bit_length()
    found = stored(anchors(table, length))
    messages = stored(run_messages(table, marked(found, hot), buckets, length))
    replies = stored(solved(messages))
    own = messages.where(F.col("bucket") == OWN).select("chunk", "bucket", F.col("block").alias("reply"))
    answers = replies.where("chunk >= 0").union(own)
    heads = path_heads(replies)
    along = pieces_met(table, answers).join(heads, ["source", "piece"])
    answers = answers.union(stored(noted(along, HEADS, ["source", "piece", "head", "end"])))
    hashes = stored(span_hashes(table, answers, length))
    wrong = hashes.join(differing(table, hashes, length), ["source", "word", "n", "hash"])
    answers = answers.union(noted(wrong, FAILED, ["source", "word", "n", "hash"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for body, replies in zip(column(batch, "body"), column(batch, "replies").to_pylist()):
                notes, got, heads, failed = read_notes(replies)
                c = opened(body.as_py())
                at, n, source, word = spans_of(stretches(notes, got, c.rank), heads, length)
                if len(failed):
                    h = stretch(second_sums(c), at, n + length - 1).view(np.int64)
                    bad = {tuple(r) for r in failed.tolist()}
                    good = np.array([r not in bad for r in zip(source.tolist(), word.tolist(), n.tolist(), h.tolist())], dtype=bool)
                    at, n = at[good], n[good]
                gone = np.zeros(len(c.start) + 1, dtype=np.int32)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + n + length - 1, -1)
                yield kept_words(c, np.cumsum(gone[:-1]) > 0)

    return map_batches(
        with_replies(table, answers), cut, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept binary"
    )


def kept_words(c: Chunk, gone: np.ndarray) -> dict:
    """The rows of a chunk without the words that go."""
    edge = np.zeros(len(gone) + 1, dtype=bool)
    edge[c.bounds] = True
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    if not len(gone):
        before = after = gone
    first = np.flatnonzero(gone & (~before | edge[:-1]))
    last = np.flatnonzero(gone & (~after | edge[1:])) + 1
    row = np.searchsorted(c.bounds, first, side="right") - 1
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(first, c.bounds), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(first - c.bounds[row], pa.int64()), pa.array(last - c.bounds[row], pa.int64())], ["start", "end"]
        ),
    )
    left = np.flatnonzero(~gone)
    size = c.end[left] - c.start[left]
    place = np.cumsum(size + 1) - (size + 1)
    text = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    text[take_ranges(place, size)] = c.data[take_ranges(c.start[left], size)]
    bounds = np.searchsorted(left, c.bounds)  # kept words before each row
    some = bounds[1:] > bounds[:-1]
    stop = np.append(place, len(text))[bounds[1:]]
    text = np.delete(text, stop[some] - 1)  # no space after a row's last word
    ends = np.concatenate([[0], stop - np.cumsum(some)])
    return {
        "doc_id": pa.array(c.ids, mask=~c.known), "n_words": np.diff(c.bounds), "spans": spans,
        "kept": binary_slices(text.tobytes(), ends),
    }
