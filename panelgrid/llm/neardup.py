"""Near-duplicate documents: universal hash minima, banding, verified links, components.

1. A task reads whole texts and keeps, per document, the size of its shingle set, a
   128-bit digest of the set and the keys of its bands.
2. Documents of one digest are one class; only its smallest id goes on, however many copies there are.
3. Classes that share a band key are linked to the smallest one of that key, which gives candidate
   groups (linear in the keys, never all pairs). Components of these are the only places
   where a link can be.
4. Inside a candidate group every pair that shares a band is considered: signatures first, then
   the full sets. A group of more than ``PART_DOCS`` documents is dealt into parts and each pair of
   parts is a task, so a task is bounded and no pair is left out. A task returns a forest of the
   links that it confirmed, at most one edge a document.
5. Components of the confirmed links are the result.

A band is a fixed random subset of the minima; bands share minima, which ``miss`` takes into account. A pair at the
threshold misses all its bands with a probability of at most 3e-6 (``rows_for`` chooses the band's rows), and a pair above it with less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelgrid.llm.components import connected_components
from panelgrid.llm.job import column, fresh, given_back, map_batches, stored
from panelgrid.llm.text import BASE, NOT_SPACE, bytes_of, mix, shingle_sets, slabs, split_words

SHINGLE = 5
MINIMA = 256
BANDS = 80
MISS = 3e-6
PART_DOCS = 1024
PART_SHINGLES = 1_500_000


def miss(similarity: float, rows: int) -> float:
    """Probability that a pair shares no band: over the number of minima that agree, of which a band needs ``rows``."""
    out = 0.0
    for agree in range(MINIMA + 1):
        log_chance = (
            math.lgamma(MINIMA + 1) - math.lgamma(agree + 1) - math.lgamma(MINIMA - agree + 1)
            + agree * math.log(similarity) + (MINIMA - agree) * math.log1p(-similarity)
        )
        out += math.exp(log_chance) * (1 - math.comb(agree, rows) / math.comb(MINIMA, rows)) ** BANDS
    return out


def rows_for(threshold: float) -> int:
    """The most rows a band may have so that a pair at the threshold is missed with at most ``MISS``."""
    return max(r for r in range(1, 20) if r == 1 or miss(threshold, r) <= MISS)


def hash_family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and additions of the universal hashes; fixed by a seed, so equal everywhere."""
    draw = np.random.default_rng(20)
    return (draw.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)), draw.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def minima_of(sets: list[np.ndarray]) -> np.ndarray:
    """``(documents, MINIMA)``; documents without shingles get the largest value throughout."""
    out = np.full((len(sets), MINIMA), np.uint32(0xFFFFFFFF))
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if len(full):
        flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for i, (a, b) in enumerate(zip(*hash_family())):
            out[full, i] = np.minimum.reduceat(flat * a + b, starts)
    return out


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """``(documents, BANDS)`` 64-bit keys."""
    draw = np.random.default_rng(21)
    out = np.empty((len(minima), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(minima), np.uint64(band + 1))
        for i in draw.choice(MINIMA, rows, replace=False):
            key = key * BASE + minima[:, i]
        out[:, band] = mix(key)
    return out


def features(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (two longs), bands; texts without words have no bands."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for slab in slabs(batches, "text"):
            data, offsets = bytes_of(column(slab, "text"))
            sets = shingle_sets(split_words(data, offsets, NOT_SPACE), SHINGLE)
            sizes = np.array([len(s) for s in sets])
            keys = band_keys(minima_of(sets), rows)
            sums = np.array(
                [(int(s.sum(dtype=np.uint64)), int(mix(s ^ BASE).sum(dtype=np.uint64))) for s in sets], dtype=np.uint64
            ).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]), pa.int32()),
                pa.array(keys[sizes > 0].reshape(-1).view(np.int64)),
            )
            yield {
                "doc_id": column(slab, "doc_id"), "n_shingles": sizes, "d1": sums[:, 0].view(np.int64) if len(sums) else [],
                "d2": np.ascontiguousarray(sums[:, 1]).view(np.int64), "bands": lists,
            }
        given_back()

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read,
        "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>",
    )


def confirmed_links(group: pa.Table, percent: int, rows: int) -> list[tuple[int, int]]:
    """A forest of the links between documents of a candidate group, or between its two parts."""
    data, offsets = bytes_of(group["text"].combine_chunks())
    ids, part = group["doc_id"].to_numpy(), group["part"].to_numpy()
    sets = shingle_sets(split_words(data, offsets, NOT_SPACE), SHINGLE)
    minima = minima_of(sets)
    keys = band_keys(minima, rows)
    sizes = np.array([len(s) for s in sets])
    n = len(ids)
    share = np.zeros((n, n), dtype=bool)
    for band in range(BANDS):
        order = np.argsort(keys[:, band], kind="stable")
        held = keys[order, band]
        edges = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                share[np.ix_(order[a:b], order[a:b])] = True
    left, right = np.nonzero(np.triu(share, 1))
    kept = 100 * np.minimum(sizes[left], sizes[right]) >= percent * np.maximum(sizes[left], sizes[right])
    kept &= (part[left] != part[right]) | (part.min() == part.max())
    left, right = left[kept], right[kept]
    t = percent / 100
    least = t - 5 * np.sqrt(t * (1 - t) / MINIMA)  # five deviations: a pair at the threshold passes
    agree = np.empty(len(left))
    for a in range(0, len(left), 1 << 15):
        agree[a : a + (1 << 15)] = (minima[left[a : a + (1 << 15)]] == minima[right[a : a + (1 << 15)]]).mean(axis=1)
    order = np.argsort(-agree, kind="stable")
    order = order[agree[order] >= least]
    label, links = np.arange(n), []
    for a in range(0, len(order), 1024):
        block = order[a : a + 1024]
        for i in block[label[left[block]] != label[right[block]]].tolist():
            x, y = int(left[i]), int(right[i])
            if label[x] == label[y]:
                continue  # already joined by confirmed links
            found = np.searchsorted(sets[x], sets[y])
            common = int((sets[x][np.minimum(found, sizes[x] - 1)] == sets[y]).sum())
            if 100 * common >= percent * (sizes[x] + sizes[y] - common):
                label[label == label[y]] = label[x]
                links.append((int(ids[x]), int(ids[y])))
    return links


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of at least ``percent``), kept.

    Words are runs without ASCII white space, A-Z folded; sets hold distinct five-word shingles, or the whole
    sequence of a shorter text. Null, empty and wordless texts are linked with nothing. Rows that share an id
    are one node: what is linked with one of their texts is linked with all. Rows without an id are linked with nothing: component_id
    is null and kept is true.
    An empty table gives no rows; other columns are ignored.
    """
    rows = rows_for(percent / 100)
    read = stored(features(docs, rows))
    known = read.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(known.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("first_id")))
    banded = (
        known.select("doc_id", "d1", "d2", "n_shingles", "bands")
        .join(classes, ["d1", "d2", "n_shingles"])
        .where("doc_id = first_id")
        .select("first_id", "n_shingles", F.explode("bands").alias("key"))
    )
    keyed = stored(banded.select("key", "first_id"))
    shared = keyed.groupBy("key").agg(F.min("first_id").alias("u"), F.max("first_id").alias("most")).where("u < most")
    near = keyed.join(shared.select("key", "u"), "key").where("u < first_id").select("u", F.col("first_id").alias("v"))
    groups = stored(connected_components(near.distinct()))
    links = _links(docs, groups, classes, percent, rows)
    # an id with several texts is in several classes
    own = known.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "first_id")
    several = own.groupBy("doc_id").agg(F.min("first_id").alias("u"), F.max("first_id").alias("most")).where("u < most")
    same_id = own.join(several.select("doc_id", "u"), "doc_id").where("u < first_id").select("u", F.col("first_id").alias("v"))
    found = connected_components(stored(links.unionByName(same_id.distinct())))
    labels = classes.join(found, F.col("first_id") == F.col("node"), "left").select(
        "d1", "d2", F.col("n_shingles").alias("size"), F.coalesce("component", "first_id").alias("component")
    )
    on = (read["d1"] == labels["d1"]) & (read["d2"] == labels["d2"]) & (read["n_shingles"] == labels["size"])
    component = F.coalesce("component", "doc_id")
    return read.join(labels, on & (read["n_shingles"] > 0) & read["doc_id"].isNotNull(), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _links(docs: DataFrame, groups: DataFrame, classes: DataFrame, percent: int, rows: int) -> DataFrame:
    sized = groups.join(
        classes.groupBy(F.col("first_id").alias("node")).agg(F.max("n_shingles").alias("n")), "node"
    )
    parts = sized.groupBy("component").agg(
        F.ceil(F.greatest(F.count("*") / PART_DOCS, F.sum("n") / PART_SHINGLES)).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = (
        sized.join(parts, "component")
        .select("node", "component", part.alias("part"), F.explode(other).alias("other"))
        .select(
            F.col("node").alias("doc_id"), "component", "part",
            F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        )
    )
    # repeated rows of a document are one text
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
        .withColumn("key", F.xxhash64("text")).dropDuplicates(["doc_id", "key"]).drop("key").join(dealt, "doc_id")
    )

    def link(group: pa.Table) -> pa.Table:
        found = confirmed_links(group, percent, rows)
        if group.num_rows > PART_DOCS // 4:
            given_back()
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return texts.groupBy("component", "i", "j").applyInArrow(link, "u long, v long")


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group of linked texts, that of the smallest id, with all its columns; rows without an id all stay.

    A document is an id with a text: rows that share an id but not a text are different documents, linked only if
    their texts are. Of repeated rows of the document that stays, the smallest by its columns in order stays.
    """
    node = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    known = docs.where(F.col("doc_id").cast("long").isNotNull())
    found = near_duplicates(known.select(node.alias("doc_id"), "text"), percent).select("doc_id", "component_id").distinct()
    ids = known.select(node.alias("doc_id"), F.col("doc_id").cast("long").alias("id")).distinct()
    labelled = stored(found.join(ids, "doc_id"))
    first = labelled.groupBy("component_id").agg(F.min(F.struct("id", "doc_id"))["doc_id"].alias("doc_id"))
    name, key, row = (fresh(docs, c) for c in ("_document", "_of", "_row"))
    gone = labelled.join(first, "doc_id", "left_anti").select(F.col("doc_id").alias(key))
    repeated = (
        known.select(node.alias(key)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    )
    tagged = docs.withColumn(name, F.when(F.col("doc_id").cast("long").isNotNull(), node))
    left = tagged.join(gone, F.col(name) == F.col(key), "left_anti")
    single = left.join(repeated, F.col(name) == F.col(key), "left_anti").drop(name)
    several = left.join(repeated, F.col(name) == F.col(key), "left_semi")
    # min merges before the shuffle, so a document with very many rows does not meet in one task
    one = several.groupBy(name).agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias(row)).select(f"{row}.*")
    return single.unionByName(one)
