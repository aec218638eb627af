"""Whole texts as byte arrays: slabs of an Arrow batch, words, hashes, shingles.

Everything here works on the UTF-8 bytes of many documents at once, inside a task.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: every byte but the space and 0x09-0x0D
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: digits, letters and every byte of a non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True



def worker_cache() -> dict:
    """A dict that lives as long as the process. Functions reach a worker by value, so module state would not."""
    name = "_panelgrid_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for ``i < n``; grown on demand, kept by the worker."""
    cache = worker_cache()
    if len(cache.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(max(n, SLAB_BYTES + 1), base, dtype=np.uint64)
            steps[0] = 1
            cache[name] = np.multiply.accumulate(steps)
    return cache["up"][:n], cache["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and ``n + 1`` offsets into them; a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slabs(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or one row where that row is longer.

    A slab is working memory only: what is computed does not depend on where it ends.
    """
    for batch in batches:
        _, offsets = bytes_of(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of a slab in order; ``bounds[d]:bounds[d + 1]`` are those of row ``d``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of ``kind`` inside each row, with A-Z folded for the hash."""
    n = len(data)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64))
    inside = kind[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(start, end, range_hash(LOWER[data], start, end), np.searchsorted(start, offsets))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for many ranges: a polynomial, then mixed."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` consecutive entries that begin at each position but the last k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= BASE
        out += words[i : i + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each row.

    A row of fewer words, but not none, has its whole sequence as its only shingle.
    """
    grams = gram_hash(words.hash, k)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(gram_hash(words.hash[a:b], b - a) + np.uint64(b - a) if b > a else grams[:0])
    return out


def take_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start[i], start[i] + length[i])``."""
    if len(start) == 0:
        return np.empty(0, dtype=np.int64)
    end = np.cumsum(length)
    return np.arange(end[-1]) + np.repeat(start - (end - length), length)
