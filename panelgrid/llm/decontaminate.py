"""Benchmark decontamination by winnowed fingerprints.

Words are hashed; of each window of ten words the smallest five-word hash is its
fingerprint, so equal windows have equal fingerprints wherever they stand. Neighbouring windows mostly share
theirs, and only one of such a stretch is kept. A text shared by ten words or more always shares one. A task drops
fingerprints that no benchmark window has (a Bloom filter whose size is capped at ``FILTER_BITS``), extends
the rest to the windows that they stand for, and joins these to runs of words. Equal runs of different
documents are one run: the fingerprints of distinct runs are joined with those of the benchmark, which settles what
the filter let through, and a run that keeps one is compared with the benchmark by the exact words of
each window, however many documents hold it. Hits go back by the run, one row a document and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelgrid.llm.job import column, fresh, map_batches, stored
from panelgrid.llm.text import ALNUM, LOWER, Words, bytes_of, gram_hash, mix, slabs, sliding_min, split_words, take_ranges

WINDOW = 10
GRAM = 5
FILTER_BITS = 1 << 27
BLOCK = 1 << 16
RUNS = pa.list_(pa.struct([("run", pa.string()), ("n", pa.int64()), ("prints", pa.list_(pa.int64()))]))


def fingerprints(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, fingerprint) of every window of ``length`` words inside its row."""
    h = words.hash
    n = len(h) - length + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64)
    row_end = np.repeat(words.bounds[1:], np.diff(words.bounds))
    start = np.flatnonzero(np.arange(n) + length <= row_end[:n])
    gram = min(GRAM, length)
    least = sliding_min(gram_hash(h, gram), length - gram + 1) + np.uint64(length)
    return start, least[start]


def winnowed(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, fingerprint): one a stretch of windows of a row with one fingerprint."""
    start, least = fingerprints(words, length)
    row = np.searchsorted(words.bounds, start, side="right")
    new = np.ones(len(start), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return start[first], np.diff(np.append(first, len(start))), least[first]


def words_of(data: np.ndarray, words: Words, first: int, stop: int) -> str:
    """The words as text, separated by spaces, A-Z folded."""
    low = LOWER[data[words.start[first] : words.end[stop - 1]]].tobytes()
    base = words.start[first]
    return b" ".join(
        low[a - base : b - base] for a, b in zip(words.start[first:stop].tolist(), words.end[first:stop].tolist())
    ).decode("utf-8")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id (as text), window (its words), length, fingerprint: one row per distinct window of an item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for slab in slabs(batches, "text"):
            data, offsets = bytes_of(column(slab, "text"))
            words = split_words(data, offsets, ALNUM)
            counts = np.diff(words.bounds)
            out = {k: [] for k in ("item_id", "window", "length", "fingerprint")}
            ids = column(slab, "item_id").to_pylist()
            for length in np.unique(np.minimum(counts, WINDOW)).tolist():
                if not length:
                    continue
                start, least = fingerprints(words, length)
                row = np.searchsorted(words.bounds, start, side="right") - 1
                for s, r, f in zip(start.tolist(), row.tolist(), least.view(np.int64).tolist()):
                    if min(counts[r], WINDOW) == length:
                        for k, v in zip(out, (ids[r], words_of(data, words, s, s + length), length, f)):
                            out[k].append(v)
            yield out

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return map_batches(items, read, "item_id string, window string, length int, fingerprint long").distinct()


def bloom_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """Packed bits of the ``h`` column; 32 bits a hash as long as that stays below ``FILTER_BITS``."""
    bits = min(FILTER_BITS, max(BLOCK, 1 << (32 * count).bit_length()))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(BLOCK, dtype=bool)
        held[frame["at"].to_numpy() % BLOCK] = True
        return pd.DataFrame({"block": [int(frame["at"].iloc[0]) // BLOCK], "bits": [np.packbits(held).tobytes()]})

    at = F.col("h").bitwiseAND(bits - 1)
    placed = hashes.select(at.alias("at")).distinct().withColumn("block", F.floor(F.col("at") / BLOCK))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in placed.groupBy("block").applyInPandas(fill, "block long, bits binary").collect():  # at most FILTER_BITS in all
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(filter_) - 1)).astype(np.int64)
    return (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def document_runs(docs: DataFrame, lengths: list[int], filter_: np.ndarray) -> DataFrame:
    """row_id, doc_id, text_key, n_words, runs: the distinct texts of the disjoint word runs that may hold benchmark windows,
    with how often each occurs (n) and its fingerprints (prints)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        row_id = TaskContext.get().partitionId() << 40
        for slab in slabs(batches, "text"):
            data, offsets = bytes_of(column(slab, "text"))
            words = split_words(data, offsets, ALNUM)
            covered = np.zeros(len(words.hash), dtype=bool)
            chained = np.zeros(len(words.hash) + 1, dtype=bool)  # the word is in one window with the word before
            met = []
            for length in lengths:
                start, windows, least = winnowed(words, length)
                kept = passes(filter_, mix(least))
                start, windows = start[kept], windows[kept]
                covered[take_ranges(start, windows + length - 1)] = True
                chained[take_ranges(start + 1, windows + length - 2)] = True
                met.append((start, least[kept].view(np.int64)))
            first = np.flatnonzero(covered & ~chained[:-1])
            stop = np.flatnonzero(covered & ~chained[1:]) + 1
            at = np.concatenate([s for s, _ in met]) if met else np.empty(0, dtype=np.int64)
            prints = np.concatenate([p for _, p in met]) if met else at
            place = np.searchsorted(first, at, side="right")  # the run that a fingerprint is in, from 1
            order = np.argsort(place, kind="stable")
            prints, ends = prints[order], np.searchsorted(place[order], np.arange(len(first) + 1), side="right")
            found: list[dict[str, dict]] = [{} for _ in range(slab.num_rows)]
            rows = np.searchsorted(words.bounds, first, side="right") - 1
            for i, (a, b, r) in enumerate(zip(first.tolist(), stop.tolist(), rows.tolist())):
                text = words_of(data, words, a, b)
                if text in found[r]:
                    found[r][text]["n"] += 1
                else:
                    found[r][text] = {"run": text, "n": 1, "prints": np.unique(prints[ends[i] : ends[i + 1]]).tolist()}
            runs = [list(f.values()) for f in found]
            yield {
                "row_id": row_id + np.arange(slab.num_rows), "doc_id": column(slab, "doc_id"),
                "text_key": column(slab, "text_key"),
                "n_words": np.diff(words.bounds), "runs": pa.array(runs, RUNS),
            }
            row_id += slab.num_rows

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")), read,
        "row_id long, doc_id long, text_key long, n_words long, runs array<struct<run: string, n: long, prints: array<bigint>>>",
    )


def window_at(length: int):
    """The window of ``length`` words of the array ``w`` from a place on."""

    def build(i):
        words = F.array_join(F.slice("w", i + 1, length), " ")
        return F.struct(i.alias("at"), F.lit(length).alias("length"), words.alias("window"))

    return build


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_words, n_hit (words inside an occurrence of a benchmark window),
    items (ids as sorted strings).

    A window is ten consecutive words of an item, or a shorter item as a whole. Null, empty and wordless texts
    have no words and no hits; wordless items have no window; an empty benchmark hits nothing. Repeated rows are
    answered one by one; null ids are kept (an item without an id hits but is not listed); other columns are ignored.
    """
    windows = stored(benchmark_windows(benchmark))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ten
    keys = windows.select("fingerprint").distinct()
    mixed = map_batches(
        keys,
        lambda batches: ({"h": mix(column(b, "fingerprint").to_numpy().view(np.uint64)).view(np.int64)} for b in batches),
        "h long",
    )
    filter_ = bloom_filter(mixed, keys.count())
    read = stored(document_runs(docs, lengths, filter_))
    held = read.where(F.size("runs") > 0).select("row_id", F.explode("runs").alias("r")).select("row_id", "r.run", "r.n", "r.prints")
    # the fingerprints of documents meet those of the benchmark; only a run that keeps one is extended
    distinct = (
        held.select("run", "prints").dropDuplicates(["run"]).select("run", F.explode("prints").alias("fingerprint"))
        .join(keys, "fingerprint", "left_semi").select("run").distinct()
    )
    none = F.array().cast("array<struct<at:int,length:int,window:string>>")
    at = [
        F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), window_at(n))).otherwise(none)
        for n in lengths
    ]
    met = (
        distinct.withColumn("w", F.split("run", " "))
        .select("run", F.explode(F.concat(*at) if at else none).alias("x"))
        .select("run", "x.*")
        .join(windows.select("item_id", "window", "length"), ["window", "length"])
        .groupBy("run")
        .agg(
            F.collect_set(F.struct("at", "length")).alias("spans"),
            F.collect_set("item_id").alias("items"),
        )
        .select(
            "run", "items",
            F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))).alias("hit"),
        )
    )
    hits = (
        held.select("row_id", "run", "n").join(met, "run").groupBy("row_id")
        .agg(F.sum(F.col("hit") * F.col("n")).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found"))
    )
    return read.join(hits, "row_id", "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no hit, with all their columns. Rows are told by id and text."""
    found = contamination(docs, benchmark).where("n_hit > 0")
    id_, text = fresh(docs, "_hit_id"), fresh(docs, "_hit_text")
    hit = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(text)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(text))
    return docs.join(hit, same, "left_anti")
