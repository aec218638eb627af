"""Shards of nearly equal bytes as the leaves of a k-d tree over text metadata.

Every dimension is computed from the text (bytes, lines, share of multi-byte characters),
so rows of equal texts are one point. A node that owns several shards is cut at the
weighted median, or the weighted quantile for an odd number, of its widest dimension.
Points are ordered by (dimension, text hash, row hash): the text hash breaks ties between
texts, and the row hash splits a group of copies only where a cut needs it. Its upper half is the id's, its lower
half the row's own, so rows that are equal in id and text can be cut too. A cut is found digit
by digit from histograms of bytes, so one pass shuffles at most ``nodes * 2**BITS`` sums
from each task, and the cuts themselves are a handful of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelgrid.llm.job import crc32, stored

BITS = 11
TOLERANCE = 0.002  # of a leaf's bytes, in one cut
SLOT_ROWS = 50_000
#: digits of a key part: how many bits each part has
DIMENSION_BITS, HASH_BITS = 33, 44


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32, dimensions x0.., hashes text_key, row_key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long")
    short = lambda *c, bits=HASH_BITS: F.shiftrightunsigned(F.xxhash64(*c), 64 - bits)
    half = HASH_BITS // 2
    id_half = F.shiftleft(short(F.col("doc_id"), F.lit(7), bits=HASH_BITS - half), half)
    row_half = short(F.monotonically_increasing_id(), bits=half)  # fixed when the points are written
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (size + 8).alias("size"),
        crc32(text).alias("text_crc32"),
        size.alias("x0"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long").alias("x1"),
        F.when(size > 0, F.floor((size - F.length(text)) * 1_000_000 / size)).otherwise(0).cast("long").alias("x2"),
        short(text).alias("text_key"),
        id_half.bitwiseOR(row_half).alias("row_key"),
    )


DIMENSIONS = ("x0", "x1", "x2")


@dataclass
class Node:
    """The rows meant for shards ``first .. first + shards - 1``; smaller keys than the cut go to the lower half."""

    first: int
    shards: int
    dimension: str = ""
    cut: tuple[int, int, int] = (0, 0, 0)

    def halves(self) -> tuple[Node, Node]:
        half = self.shards // 2
        return Node(self.first, half), Node(self.first + half, self.shards - half)

    def below(self) -> Column:
        x, text, row = self.cut
        d, t = F.col(self.dimension), F.col("text_key")
        return (d < x) | ((d == x) & ((t < text) | ((t == text) & (F.col("row_key") < row))))


def _digits() -> list[tuple[int, int, int]]:
    """(part, shift, bits) of each digit of a key, from the highest."""
    out = []
    for part, bits in enumerate((DIMENSION_BITS, HASH_BITS, HASH_BITS)):
        out += [(part, shift, BITS) for shift in range(bits - BITS, -1, -BITS)]
    return out


def kd_leaves(points: DataFrame, shards: int) -> DataFrame:
    """Add ``node``, the leaf of each of the ``points``. A level is one written table with the rows' node of that
    level; only sums by node and digit reach the driver."""
    points = stored(points.withColumn("node", F.lit(0)))
    whole = points.agg(*[F.max(d).alias(d) for d in DIMENSIONS], F.sum("size").alias("size")).first()
    scale = {d: max(1, whole[d] or 0) for d in DIMENSIONS}
    enough = TOLERANCE * (whole["size"] or 0) / shards
    active = [Node(0, shards)] if shards > 1 else []
    while active:
        seen = {
            r["node"]: r
            for r in points.groupBy("node")
            .agg(F.sum("size").alias("size"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS])
            .collect()  # a row a node
        }
        active = [n for n in active if n.first in seen]
        cut_nodes(points, active, seen, scale, enough)
        moved = F.col("node")
        for n in active:
            upper = n.halves()[1].first
            moved = F.when((F.col("node") == n.first) & ~n.below(), F.lit(upper)).otherwise(moved)
        points = stored(points.withColumn("node", moved)) if active else points
        active = [half for n in active for half in n.halves() if half.shards > 1]
    return points


def cut_nodes(points: DataFrame, active: list[Node], seen: dict, scale: dict, enough: float) -> None:
    """Choose each node's widest dimension and find its cut, a digit of all open nodes in a pass."""
    wanted, open_ = {}, list(active)
    prefix = {n.first: [0, 0, 0] for n in active}
    for n in active:
        n.dimension = max(DIMENSIONS, key=lambda d: seen[n.first][d] / scale[d])
        wanted[n.first] = seen[n.first]["size"] * (n.shards // 2) / n.shards
    digits = _digits()
    for part, shift, bits in digits:
        if not open_:
            break
        if part == 0 and not any(scale[n.dimension] >> shift for n in open_):
            continue  # every value has 0 here
        x = F.coalesce(*[F.when(F.col("node") == n.first, F.col(n.dimension)) for n in open_])
        key = (x, F.col("text_key"), F.col("row_key"))
        path = F.lit(False)
        for n in open_:
            same = F.col("node") == n.first
            for p in range(part):
                same = same & (key[p] == prefix[n.first][p])
            path = path | (same & (F.shiftright(key[part], shift + bits) == prefix[n.first][part] >> (shift + bits)))
        digit = F.shiftright(key[part], shift).bitwiseAND((1 << bits) - 1)
        sums: dict[int, list] = {}
        for r in points.where(path).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("size")).collect():
            sums.setdefault(r["node"], []).append((r["digit"], r["size"]))
        still = []
        for n in open_:
            met = sorted(sums[n.first])
            for value, size in met:
                if size > wanted[n.first] or value == met[-1][0]:
                    break
                wanted[n.first] -= size
            prefix[n.first][part] |= value << shift
            if size > enough and (part, shift, bits) != digits[-1]:
                still.append(n)
            elif wanted[n.first] > size / 2:  # the cut is on the nearer side of what is left
                prefix[n.first][part] += 1 << shift
        open_ = still
    for n in active:
        n.cut = tuple(prefix[n.first])


def kd_shards(docs: DataFrame, shards: int = 24, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Put every row of ``docs(doc_id, text, ...)`` into one of ``shards`` leaves of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32, shard, and slot, the
    row's place in its shard from 0 without gaps. Slots are numbered in buckets of about ``slot_rows`` rows
    and shifted by the counts of earlier buckets, so no shard meets in one task. Null and empty texts are
    the same point; rows equal in id and text are rows of their own and are cut where a leaf would grow too
    large; an empty table gives no rows; other columns are ignored.
    """
    points = kd_leaves(measured(docs), shards)
    buckets = max(1, -(-points.count() // (shards * slot_rows)))
    placed = points.select(
        "doc_id", "size", "text_crc32", F.col("node").alias("shard"),
        F.pmod(F.xxhash64("row_key", "text_crc32"), F.lit(buckets)).alias("bucket"),
    )
    counted = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return placed.join(bases, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + number - 1).alias("slot")
    )
