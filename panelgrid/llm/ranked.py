"""Ranked lexical search over an inverted file, by accumulators and by document in one.

The file holds blocks of documents with the posting lists of their terms. Queries meet the
blocks; within a block each query is answered in two steps:

1. Its short lists are read whole, a term at a time, into one array of summed accumulators.
2. The accumulators then count as one more list, bounded by the largest of them, beside the long lists with their own
   bounds. Documents are taken in order, a window at a time. Lists whose bounds together stay below the score of the
   last document that would be returned bring no candidates; they are only searched at the documents that the other
   lists bring, from the largest bound on, while a document can still reach that score.

The score to beat goes on from block to block in a task, and strictly smaller bounds alone are skipped, so ties are
complete. Terms are told apart by 64-bit hashes. All sums are integers, so the order of additions does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelgrid.llm.job import column, map_batches, pack, stored, unpack
from panelgrid.llm.text import ALNUM, bytes_of, slabs, split_words

K = 20
BLOCK_BYTES = 16 << 20  # of text in a block of the inverted file
ITEM_TERMS = 1 << 16  # terms of a block of queries
SHORT_SHARE = 32  # a list is short if it holds at most this fraction of a block's documents
WINDOW = 2048  # documents taken at a time
BROADCAST_BYTES = 8 << 20  # queries up to this size go to every executor; larger ones are joined
DEALT = 64  # parts in which a query's candidates are ranked before they meet
LAST = np.iinfo(np.int64).max


def lists_of(term: np.ndarray, row: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of term and row, equal ones merged: (term, row, occurrences)."""
    order = np.lexsort((row, term))
    term, row = term[order], row[order]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    weight = np.ones(len(term), dtype=np.int64) if count is None else count[order].astype(np.int64)
    return term[first], row[first], np.add.reduceat(weight, first) if len(first) else weight[:0]


def inverted_file(docs: DataFrame) -> DataFrame:
    """(block, n_docs, n_terms, body): body packs ids and lengths of the documents by ascending id (null ids last), the
    block's terms, where their lists begin, and the postings' documents and occurrences."""

    def flush(held: list) -> dict:
        ids, known, sizes, parts, base = [], [], [], [], 0
        for slab_ids, slab_known, slab_sizes, postings in held:
            ids.append(slab_ids), known.append(slab_known), sizes.append(slab_sizes)
            parts.append((postings[0], postings[1] + base, postings[2]))
            base += len(slab_ids)
        ids, known, sizes = np.concatenate(ids), np.concatenate(known), np.concatenate(sizes)
        by = np.argsort(np.where(known, ids, LAST), kind="stable")
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        term, row, tf = (np.concatenate([p[i] for p in parts]) for i in range(3))
        term, row, tf = lists_of(term, place[row], tf)
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, dtype=np.int64)
        body = pack(
            ids[by], known[by].view(np.uint8), sizes[by], term[first], np.append(first, len(term)), row.astype(np.int32),
            tf.astype(np.int32),
        )
        return {"n_docs": [int((sizes > 0).sum())], "n_terms": [int(sizes.sum())], "body": [body]}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        block, held, total = TaskContext.get().partitionId() << 32, [], 0
        for slab in slabs(batches, "text"):
            data, offsets = bytes_of(column(slab, "text"))
            words = split_words(data, offsets, ALNUM)
            sizes = np.diff(words.bounds)
            ids = column(slab, "doc_id")
            held.append((
                ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), sizes,
                lists_of(words.hash, np.repeat(np.arange(len(sizes)), sizes)),
            ))
            total += len(data)
            if total >= BLOCK_BYTES:
                yield {"block": [block]} | flush(held)
                block, held, total = block + 1, [], 0
        if held:
            yield {"block": [block]} | flush(held)

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read,
        "block long, n_docs long, n_terms long, body binary",
    )


def query_blocks(items: DataFrame) -> DataFrame:
    """(item_block, ids, body): body packs the distinct terms of some queries and each query's terms with their repeats;
    ``ids`` are the queries' own ids. A query's text is never divided."""

    kind = items.schema["item_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        number, ids, terms, total = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> dict:
            distinct, which = np.unique(np.concatenate(terms), return_inverse=True)
            item = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            item, which, repeats = lists_of(item, which)
            bounds = np.searchsorted(item, np.arange(len(terms) + 1))
            return {"item_block": [number], "ids": pa.array([ids]), "body": [pack(distinct, bounds, which, repeats)]}

        for slab in slabs(batches, "text"):
            data, offsets = bytes_of(column(slab, "text"))
            words = split_words(data, offsets, ALNUM)
            for i, key in enumerate(column(slab, "item_id").to_pylist()):
                ids.append(key), terms.append(words.hash[words.bounds[i] : words.bounds[i + 1]])
                total += len(terms[-1])
                if total >= ITEM_TERMS:
                    yield flush()
                    number, ids, terms, total = number + 1, [], [], 0
        if ids:
            yield flush()

    own = items.select("item_id", "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return map_batches(
        own.repartition(1 + size // (8 * ITEM_TERMS)), read, f"item_block long, ids array<{kind}>, body binary"
    )


def met(index: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """Every block of queries beside every block of the file, without moving the file where the queries are small.

    The block's queries are joined on (block of queries, part), each part holding some of the file's blocks.
    """
    if size <= BROADCAST_BYTES:
        numbers = [r["item_block"] for r in asked.select("item_block").collect()]  # one for each 65,536 terms of 8 MB at most
        keyed = index.withColumn("item_block", F.explode(F.array(*[F.lit(n) for n in numbers])))
        return keyed.join(F.broadcast(asked.withColumnRenamed("body", "query")), "item_block")
    parts = max(1, index.sparkSession.sparkContext.defaultParallelism * 4)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = asked.withColumnRenamed("body", "query").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return index.withColumn("part", part("block")).join(every, "part").drop("part")


def frequencies(index: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(item_block, term, df): in how many documents each term of the queries occurs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for number, query, body in zip(*(column(batch, c) for c in ("item_block", "query", "body"))):
                number = number.as_py()
                if number not in total:
                    terms = unpack(query.as_py())[0]
                    total[number] = terms, np.zeros(len(terms), dtype=np.int64)
                terms, df = total[number]
                _, _, _, held, first, _, _ = unpack(body.as_py())
                at, found = lookup(held, terms)
                df[found] += np.diff(first)[at[found]]
        for number, (terms, df) in total.items():
            yield {"item_block": np.full(len(df), number), "place": np.arange(len(df)), "df": df}

    counts = map_batches(
        met(index, asked, size).select("item_block", "query", "body"), read, "item_block long, place long, df long"
    )
    return counts.groupBy("item_block", "place").agg(F.sum("df").alias("df"))


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def weighted(asked: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """The blocks of queries with the weight of each term: floor(1000 * ln((2n + 2) / (2df + 1)))."""
    gathered = counts.groupBy("item_block").agg(F.array_sort(F.collect_list(F.struct("place", "df"))).alias("found"))
    kind = asked.schema["ids"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            bodies = []
            for body, found in zip(column(batch, "body"), column(batch, "found").to_pylist()):
                terms, *rest = unpack(body.as_py())
                df = np.zeros(len(terms), dtype=np.float64)
                for r in found or ():
                    df[r["place"]] = r["df"]
                weight = np.floor(1000 * np.log((2.0 * n + 2) / (2 * df + 1))).astype(np.int64)
                bodies.append(pack(terms, weight, *rest))
            yield {"item_block": column(batch, "item_block"), "ids": column(batch, "ids"), "body": bodies}

    return map_batches(asked.join(gathered, "item_block", "left"), read, f"item_block long, ids {kind}, body binary")


class Best:
    """The ``k`` best (score, id) of a query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.rank = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.least = 1  # a smaller score is of no use

    def add(self, score: np.ndarray, rank: np.ndarray) -> None:
        useful = score >= self.least
        if useful.any():
            score, rank = np.concatenate([self.score, score[useful]]), np.concatenate([self.rank, rank[useful]])
            order = np.lexsort((rank, -score))[: self.k]
            self.score, self.rank = score[order], rank[order]
            if len(order) == self.k:
                self.least = max(1, int(self.score[-1]))


def search(best: Best, lists: list[tuple[np.ndarray, np.ndarray, int]], rank: np.ndarray, counter: dict | None = None) -> None:
    """Add a block's documents to ``best``. ``lists`` are (documents, scores, largest score) of the query's terms."""
    n = len(rank)
    summed = np.zeros(n, dtype=np.int64)
    long = []
    for docs, scores, most in lists:
        if len(docs) * SHORT_SHARE <= n:
            summed[docs] += scores
        else:
            long.append((docs, scores, most))
    held = np.flatnonzero(summed)
    if len(held):
        long.append((held, summed[held], int(summed[held].max())))
    long.sort(key=lambda x: x[2])
    reach = np.cumsum([most for *_, most in long]).tolist()
    if not reach or reach[-1] < best.least:
        return
    for low in range(0, n, WINDOW):
        high = min(n, low + WINDOW)
        passive = 0  # lists that together stay below the score to beat
        while passive < len(long) and reach[passive] < best.least:
            passive += 1
        if passive == len(long):
            return
        part, seen = np.zeros(high - low, dtype=np.int64), np.zeros(high - low, dtype=bool)
        for docs, scores, _ in long[passive:]:
            a, b = np.searchsorted(docs, (low, high))
            part[docs[a:b] - low] += scores[a:b]
            seen[docs[a:b] - low] = True
            if counter is not None:
                counter["read"] = counter.get("read", 0) + int(b - a)
        found = np.flatnonzero(seen)
        for i in range(passive - 1, -1, -1):
            found = found[part[found] + reach[i] >= best.least]
            if not len(found):
                break
            docs, scores, _ = long[i]
            at, there = lookup(docs, found + low)
            part[found[there]] += scores[at[there]]
            if counter is not None:
                counter["read"] = counter.get("read", 0) + int(there.sum())
        best.add(part[found], rank[found + low])


def candidates(pairs: DataFrame, n: int, length: int, k: int, kind: str) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best documents of every query."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        best: dict[int, tuple[list, list[Best]]] = {}
        opened: tuple[int | None, list] = (None, [])
        for batch in batches:
            names = ("item_block", "ids", "query", "block", "body")
            for number, ids, query, block, body in zip(*(column(batch, c) for c in names)):
                number, block = number.as_py(), block.as_py()
                if opened[0] != block:
                    opened = block, unpack(body.as_py())
                doc_ids, known, sizes, held, first, docs, tf = opened[1]
                terms, weight, bounds, which, repeats = unpack(query.as_py())
                if number not in best:
                    best[number] = ids.as_py(), [Best(k) for _ in range(len(bounds) - 1)]
                rank = np.where(known.astype(bool), doc_ids, LAST)
                norm = 75 + 25 * sizes * n // max(length, 1)
                at, there = lookup(held, terms)
                size = np.where(there, np.diff(first)[at] if len(held) else 0, 0)
                start = np.cumsum(size) - size
                chosen = np.repeat((first[at] if len(held) else at) - start, size) + np.arange(size.sum())
                row, times = docs[chosen].astype(np.int64), tf[chosen].astype(np.int64)
                impact = 1_000_000_000 * times // (1000 * times + 12 * norm[row])
                most = np.zeros(len(terms), dtype=np.int64)
                full = size > 0
                if full.any():
                    most[full] = np.maximum.reduceat(impact, start[full])
                for i, mine in enumerate(best[number][1]):
                    own = slice(bounds[i], bounds[i + 1])
                    lists = []
                    for t, q in zip(which[own].tolist(), repeats[own].tolist()):
                        w = int(weight[t]) * q
                        if size[t] and w > 0:
                            span = slice(start[t], start[t] + size[t])
                            lists.append((row[span], w * impact[span], w * int(most[t])))
                    if lists:
                        search(mine, lists, rank)
        for number, (ids, found) in best.items():
            for i, mine in enumerate(found):
                if len(mine.score):
                    yield {
                        "item_block": np.full(len(mine.score), number), "item": np.full(len(mine.score), i),
                        "item_id": pa.array([ids[i]] * len(mine.score)),
                        "doc_id": pa.array(mine.rank, mask=mine.rank == LAST), "score": mine.score,
                    }

    return map_batches(
        pairs.select("item_block", "ids", "query", "block", "body"), read,
        f"item_block long, item int, item_id {kind}, doc_id long, score long",
    )


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item, of all documents, by integer BM25 weights.

    Terms are runs of letters, digits and non-ASCII characters with A-Z folded; null texts have none. Every row of ``items`` is
    a query of its own, also where ids repeat or are null, and repeated terms count as often as they occur. Ties go to the
    smaller doc_id, null ids last; repeated rows of documents are documents. Only scores above 0 are returned. Empty tables give no rows; other columns are ignored.
    """
    index = stored(inverted_file(docs))
    asked = stored(query_blocks(items))
    n, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    size = asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    counts = frequencies(index, asked, size)
    known = stored(weighted(asked, counts, n or 0))
    kind = items.schema["item_id"].dataType.simpleString()
    found = candidates(met(index, known, size), n or 0, length or 0, k, kind)
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    item = ["item_block", "item"]
    part = F.pmod(F.spark_partition_id(), F.lit(DEALT)).alias("part")
    dealt = found.select("*", part)
    dealt = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*item, "part").orderBy(*best))).where(F.col("place") <= k)
    rank = F.row_number().over(Window.partitionBy(*item).orderBy(*best))
    return dealt.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
