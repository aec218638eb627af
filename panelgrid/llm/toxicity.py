"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly.

A text is a bag of character n-grams (3 to 5, with word edges marked) and whole words,
hashed into a table of vectors. Their mean goes through a linear softmax. Vectors and
weights are learned together by Adagrad on a bounded sample of labelled rows (``SAMPLE``
rows of the classes, the first by a hash of doc_id), in one task. Scoring reads every whole text;
as the model is linear after the mean, a bucket's vector acts through one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelgrid.llm.job import column, given_back, map_batches
from panelgrid.llm.text import bytes_of, powers, slabs

BUCKET_BITS = 17
WIDTH = 8
SAMPLE = (6000, 3000)  # labelled rows of class 0 and of class 1 that training may use
EPOCHS = 12
BATCH = 128
UPDATES = 100  # at least: small samples are seen more often
RATE = 0.5
SHARPNESS = 100.0  # scale of the mean before the softmax: a few words in hundreds must be able to decide
START = 0.01  # spread of untrained vectors: what training never met should hardly count
NEUTRAL = 300  # subwords without effect that every mean includes: a few words alone prove little
GRAMS = (3, 4, 5)
EDGE = ord("_")
SLAB = 1 << 19  # bytes of text at a time: a dozen arrays of eight bytes a character come with it


def subwords(column_: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, then for whole words: (bucket at each position, whether it counts), and last the row starts.

    Positions are code points of the rows joined by a line feed, A-Z folded.
    """
    data, offsets = bytes_of(column_)
    n = len(offsets) - 1
    # a separator before each row and after the last one: an n-gram that starts or ends at an edge of a row is the row's own
    joined = np.insert(data, offsets, 10)
    points = np.frombuffer(joined.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])[offsets + np.arange(n + 1)]
    low = np.where((points >= 65) & (points <= 90), points + 32, points)
    letter = ((low >= 97) & (low <= 122)) | (low >= 0xC0)
    low = np.where(letter, low, EDGE)
    size = len(low)
    up, down = powers(size + 1)
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
    breaks = np.concatenate([[0], np.cumsum(~letter, dtype=np.int32)])
    shift = np.uint64(64 - BUCKET_BITS)
    for k in GRAMS:
        if size < k:
            continue
        h = (total[k:] - total[:-k]) * down[: size - k + 1] * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        counts = breaks[k - 1 : size] == breaks[1 : size - k + 2]
        yield (h >> shift).astype(np.int32), counts
    edge = np.concatenate([[True], ~letter])
    start = np.flatnonzero(letter & edge[:-1])
    end = np.flatnonzero(letter & np.concatenate([~letter[1:], [True]])) + 1
    h = (total[end] - total[start]) * down[start] * np.uint64(0x9FB21C651E98DF25)
    words, counts = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=bool)
    words[start] = (h >> shift).astype(np.int32)
    counts[start] = True
    yield words, counts
    yield at, None


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[np.minimum(at[1:], len(values))] - total[np.minimum(at[:-1], len(values))]


def bags(column_: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts for each row."""
    parts = list(subwords(column_))
    at = parts.pop()[0]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        met = np.concatenate([bucket[a:b][counts[a:b]] for bucket, counts in parts])
        out.append(np.unique(met, return_counts=True))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float) -> dict:
    """Learn vectors, weights and bias. ``prior`` is the share of label 1 among all labelled rows: the sample's share
    may differ, and the bias is moved back."""
    draw = np.random.default_rng(0)
    vectors = draw.normal(0, START, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    weights = draw.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    seen_v = np.full(1 << BUCKET_BITS, 1e-3, dtype=np.float32)
    seen_w, seen_b = np.full_like(weights, 1e-3), np.full_like(bias, 1e-3)
    order = np.arange(len(rows))
    epochs = max(EPOCHS, -(-UPDATES * BATCH // max(1, len(rows))))
    for epoch in range(epochs):
        draw.shuffle(order)
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            batch = [rows[i] for i in order[a : a + BATCH] if len(rows[i][0])]
            y = np.array([labels[i] for i in order[a : a + BATCH] if len(rows[i][0])])
            if not batch:
                continue
            sizes = np.array([len(b) for b, _ in batch])
            buckets = np.concatenate([b for b, _ in batch])
            share = np.concatenate([c / (c.sum() + NEUTRAL) for _, c in batch]).astype(np.float32) * np.float32(SHARPNESS)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[buckets] * share[:, None], starts)
            z = mean @ weights + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grad_w, grad_b, grad_mean = mean.T @ p, p.sum(axis=0), p @ weights.T
            by = np.argsort(buckets, kind="stable")
            touched, first = np.unique(buckets[by], return_index=True)
            row = np.repeat(np.arange(len(sizes)), sizes)[by]
            grad_v = np.add.reduceat(grad_mean[row] * share[by][:, None], first)
            seen_v[touched] += (grad_v**2).mean(axis=1)
            vectors[touched] -= rate * grad_v / np.sqrt(seen_v[touched])[:, None]
            seen_w += grad_w**2
            weights -= rate * grad_w / np.sqrt(seen_w)
            seen_b += grad_b**2
            bias -= rate * grad_b / np.sqrt(seen_b)
    share = labels.mean() if len(labels) else 0.5
    if 0 < share < 1 and 0 < prior < 1:
        bias[1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return {"vectors": vectors, "weights": weights, "bias": bias}


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> dict | None:
    """Train on labelled rows outside fold 0. Without rows of both classes there is no model: None.

    An id labelled twice counts as toxic if any label says so. An id with several rows takes part once, by the text of the
    smallest hash. Null ids, null labels and labels other than 0 and 1 take no part; a null text is an empty one.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    met = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(met) < 2:
        return None
    first = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y])
    chosen = F.broadcast(first(0).union(first(1)))  # as many rows of two numbers as ``sample`` says, at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select(
        "doc_id", "y", F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("text_key"), "text"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for slab in slabs(batches, "text", SLAB):
            found = bags(column(slab, "text"))
            yield {
                "doc_id": column(slab, "doc_id"), "text_key": column(slab, "text_key"),
                "y": column(slab, "y"), "place": column(slab, "place"), "buckets": [b.astype(np.int32).tobytes() for b, _ in found],
                "counts": [c.astype(np.uint16 if c.max(initial=0) < 1 << 16 else np.uint32).tobytes() for _, c in found],
            }

    prior = met[1] / (met[0] + met[1])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, y, place = [], [], []
        for frame in frames:
            y += frame["y"].tolist()
            place += frame["place"].tolist()
            rows += [
                (np.frombuffer(b, dtype=np.int32), np.frombuffer(c, dtype=np.uint16 if 2 * len(c) == len(b) else np.uint32))
                for b, c in zip(frame["buckets"], frame["counts"])
            ]
        # the order in which rows arrive does not matter
        order = sorted(range(len(rows)), key=lambda i: (place[i], y[i], len(rows[i][0])))
        model = train([rows[i] for i in order], np.array([y[i] for i in order]), prior)
        rows.clear()
        given_back()
        yield pd.DataFrame({k: [v.tobytes()] for k, v in model.items()})

    bagged = map_batches(rows, read, "doc_id long, text_key long, y int, place long, buckets binary, counts binary")
    # an id's rows meet in their tasks first, so that one row an id reaches the training task
    once = bagged.groupBy("doc_id").agg(F.min_by(F.struct("y", "place", "buckets", "counts"), "text_key").alias("row"))
    found = once.select("row.*").repartition(1).mapInPandas(learn, "vectors binary, weights binary, bias binary").first()
    get = lambda k, *shape: np.frombuffer(found[k], dtype=np.float32).reshape(shape)
    return {"vectors": get("vectors", -1, WIDTH), "weights": get("weights", WIDTH, 2), "bias": get("bias", 2)}


def with_score(docs: DataFrame, model: dict | None, text: str = "text", score: str = "score") -> DataFrame:
    """Add the probability that a text is toxic. Null, empty and letterless texts get the model's prior; without a
    model every score is 0. Columns and rows stay; a column already called ``score`` is replaced."""
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    kept = [f for f in docs.schema if f.name != score]
    from pyspark.sql import types as T

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for slab, p in probabilities(batches, text):
            yield {f.name: column(slab, f.name) for f in kept} | {score: p}

    probabilities = scorer(model)
    schema = T.StructType([*kept, T.StructField(score, T.DoubleType())])
    return map_batches(docs.select(*[f.name for f in kept]), read, schema)


def without_toxic(docs: DataFrame, model: dict | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose probability is below ``threshold``, with all their columns; without a model all rows. Rows that go do
    not leave their task."""
    if model is None:
        return docs
    probabilities, names = scorer(model), docs.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for slab, p in probabilities(batches, text):
            left = slab.filter(pa.array(p < threshold))
            if left.num_rows:
                yield {name: column(left, name) for name in names}

    return map_batches(docs, read, docs.schema)


def scorer(model: dict):
    """A function from batches to (slab, probability of each of its rows)."""
    effect = (model["vectors"] @ (model["weights"][:, 1] - model["weights"][:, 0]) * SHARPNESS).astype(np.float32)
    bias = float(model["bias"][1] - model["bias"][0])

    def probabilities(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for slab in slabs(batches, text, SLAB):
            parts = list(subwords(column(slab, text)))
            at = parts.pop()[0]
            total, number = np.zeros(slab.num_rows), np.zeros(slab.num_rows)
            for bucket, counts in parts:
                total += row_sums(np.where(counts, effect[bucket], np.float32(0)), at)
                number += row_sums(counts, at)
            logit = total / (number + NEUTRAL) + bias
            yield slab, 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        given_back()

    return probabilities
