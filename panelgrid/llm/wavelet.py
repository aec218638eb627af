"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds whole documents in ascending id order. Its file image is a header, the
document table and, for each bit of a token id, one plane of bits cut into compressed
blocks with the count of ones before each. ``access``, ``rank``, ``count`` and
``select`` inflate only the blocks that they touch. A shard is one row of a Parquet
table, so that Spark's commit protocol decides which attempt of a task counts and any
store that Spark reaches will do; the ``image`` column is the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from panelgrid.llm.job import binary_slices, column, map_batches, stored
from panelgrid.llm.text import slabs
from panelgrid.llm.tokens import encoder, tokenizer_path

MAGIC = b"WVM1"
BLOCK_BITS = 1 << 18
SHARD_TOKENS = 1 << 22
HEADER = "<4sBQQQQ"  # magic, bits, tokens, documents, bytes of the document table, blocks a plane


class WaveletMatrix:
    """Reads one shard's image."""

    def __init__(self, image: bytes):
        self.image = memoryview(image)
        magic, self.bits, self.n, self.docs, table, blocks = struct.unpack_from(HEADER, self.image)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = struct.calcsize(HEADER)
        raw = zstandard.decompress(self.image[at : at + table])
        rows = np.frombuffer(raw, dtype=np.int64).reshape(3, self.docs)
        self.doc_ids, self.doc_valid, lengths = rows[0], rows[1].astype(bool), rows[2]
        self.doc_start = np.concatenate([[0], np.cumsum(lengths)])
        at += table
        shape = (self.bits, blocks + 1)
        size = 8 * self.bits * (blocks + 1)
        self.where = np.frombuffer(self.image[at : at + size], dtype=np.int64).reshape(shape)
        self.before = np.frombuffer(self.image[at + size : at + 2 * size], dtype=np.int64).reshape(shape)
        self.body = at + 2 * size
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def build(ids: np.ndarray, doc_ids: np.ndarray, doc_valid: np.ndarray, lengths: np.ndarray) -> bytes:
        n = len(ids)
        top = int(ids.max()) if n else 0
        bits = max(1, top.bit_length())
        level = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        pack = zstandard.ZstdCompressor(level=1)
        blocks = -(-n // BLOCK_BITS)
        where = np.zeros((bits, blocks + 1), dtype=np.int64)
        before = np.zeros((bits, blocks + 1), dtype=np.int64)
        body, size = [], 0
        for plane in range(bits):
            bit = (level >> level.dtype.type(bits - 1 - plane)) & level.dtype.type(1) != 0
            packed = np.packbits(bit)
            ones = np.add.reduceat(bit, np.arange(0, n, BLOCK_BITS), dtype=np.int64) if n else before[plane][1:]
            before[plane][1:] = np.cumsum(ones)
            for b in range(blocks):
                block = pack.compress(packed[b * BLOCK_BITS // 8 : (b + 1) * BLOCK_BITS // 8])
                where[plane][b] = size
                size += len(block)
                body.append(block)
            where[plane][blocks] = size
            level = np.concatenate([level[~bit], level[bit]])
        table = pack.compress(
            np.stack([doc_ids.astype(np.int64), doc_valid.astype(np.int64), lengths.astype(np.int64)]).tobytes()
        )
        head = struct.pack(HEADER, MAGIC, bits, n, len(doc_ids), len(table), blocks)
        return b"".join([head, table, where.tobytes(), before.tobytes(), *body])

    def _plane(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._blocks:
            a, b = self.body + self.where[plane][block], self.body + self.where[plane][block + 1]
            self._blocks[key] = np.unpackbits(np.frombuffer(zstandard.decompress(self.image[a:b]), dtype=np.uint8))
        return self._blocks[key]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        return int(self.before[plane][block]) + (int(self._plane(plane, block)[:rest].sum()) if rest else 0)

    def _zeros(self, plane: int) -> int:
        return self.n - int(self.before[plane][-1])

    def access(self, i: int) -> int:
        """The token at position ``i`` of the shard."""
        value = 0
        for plane in range(self.bits):
            bit = int(self._plane(plane, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._ones(plane, i)
            i = self._zeros(plane) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before ``stop`` stand after the last plane."""
        if token >> self.bits:
            return 0, 0
        a, b = 0, stop
        for plane in range(self.bits):
            ones_a, ones_b = self._ones(plane, a), self._ones(plane, b)
            if token >> (self.bits - 1 - plane) & 1:
                a, b = self._zeros(plane) + ones_a, self._zeros(plane) + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def rank(self, token: int, stop: int) -> int:
        """Occurrences of ``token`` among the first ``stop`` tokens."""
        a, b = self._range(token, stop)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence of ``token``, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for plane in reversed(range(self.bits)):
            if token >> (self.bits - 1 - plane) & 1:
                i = self._find(plane, i - self._zeros(plane), 1)
            else:
                i = self._find(plane, i, 0)
        return i

    def _find(self, plane: int, k: int, bit: int) -> int:
        """Position of the ``k``-th ``bit`` of a plane, from 0."""
        edges = np.arange(len(self.before[plane])) * BLOCK_BITS
        below = self.before[plane] if bit else np.minimum(edges, self.n) - self.before[plane]
        block = int(np.searchsorted(below, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._plane(plane, block) == bit)[k - below[block]])

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes are undone from the last to the first."""
        out = np.zeros(self.n, dtype=np.uint32)
        for plane in reversed(range(self.bits)):
            raw = b"".join(
                zstandard.decompress(self.image[self.body + a : self.body + b])
                for a, b in zip(self.where[plane][:-1].tolist(), self.where[plane][1:].tolist())
            )
            bit = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n).view(bool)
            zeros, up = self._zeros(plane), np.empty_like(out)
            up[~bit] = out[:zeros]
            up[bit] = out[zeros:] | np.uint32(1 << (self.bits - 1 - plane))
            out = up
        return out


def write_shards(
    docs: DataFrame, path: str | None = None, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encode ``docs(doc_id, text, ...)`` and write one wavelet matrix per shard.

    Rows are dealt by ranges of doc_id and sorted; a task walks its range once and closes a shard when
    it holds ``shard_tokens`` tokens, so memory follows the shard and the longest text, not the range.
    Null or empty texts have the end id alone; a null doc_id sorts first; repeated ids stand together,
    ordered by text. Extra columns are ignored. Returns the written table: part and shard (their order is
    the documents' order), tokens, documents, image.
    """
    model = tokenizer or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0
        code = encoder(model)

        def close():
            ids, keys, valid, lengths = (np.concatenate([h[i] for h in held]) for i in range(4))
            image = WaveletMatrix.build(ids, keys, valid, lengths)
            return {"part": [part], "shard": [shard], "tokens": [len(ids)], "documents": [len(keys)], "image": [image]}

        for slab in slabs(batches, "text"):
            ids, offsets = code.encode(column(slab, "text"))
            keys = column(slab, "doc_id")
            held.append((ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets)))
            size += len(ids)
            if size >= shard_tokens:
                yield close()
                shard, held, size = shard + 1, [], 0
        if held:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return stored(map_batches(ordered, write, "part int, shard int, tokens long, documents long, image binary"), path)


def read_documents(shards: DataFrame) -> DataFrame:
    """The documents of written shards: part, shard, doc_id, start in the shard, ids (little-endian uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix = WaveletMatrix(column(batch, "image")[row].as_py())
                tokens, start, step = matrix.tokens(), matrix.doc_start, 2000
                for a in range(0, matrix.docs, step):
                    b = min(a + step, matrix.docs)
                    yield {
                        "part": np.full(b - a, column(batch, "part")[row].as_py()),
                        "shard": np.full(b - a, column(batch, "shard")[row].as_py()),
                        "doc_id": pa.array(matrix.doc_ids[a:b], mask=~matrix.doc_valid[a:b]),
                        "start": start[a:b],
                        "ids": binary_slices(tokens[start[a] : start[b]].tobytes(), 4 * (start[a : b + 1] - start[a])),
                    }

    return map_batches(
        shards.select("part", "shard", "image"), read, "part int, shard int, doc_id long, start long, ids binary"
    )


def shard_starts(shards: DataFrame) -> DataFrame:
    """Tokens before each shard. One row a shard goes through the window, none a document."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("part", "shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
