"""Language-model scores of whole documents: exact corpus counts and a gated recurrent model.

1. Documents become blocks of word numbers with the block's distinct words (64-bit hashes) and their training counts.
2. Blocks send their words to buckets of the hash; a bucket adds up the counts of its words and answers each block. A
   frequent word is one entry a block. Counts, their sum and their number cover the whole corpus.
3. The ``SYMBOLS`` most frequent words are the recurrent model's own. Every other word enters as the sum of hashed
   sub-vectors, as many as tell the corpus's words apart, and leaves as a symbol of its hash class followed by the
   bits of its hash: each bit is a decision of the recurrent state around the odds of the corpus counts, down to where
   fewer than ``LEARN_TOKENS`` training tokens are left; below, the word has its share by counts. So the decisions
   grow with the corpus. The model is a distribution over all known words, one unknown of each class and the end.
4. Every training document takes part in training once: in each of ``ROUNDS`` rounds the tasks train copies on
   their part of that round's blocks, and the mean of the copies, weighted by tokens, goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelgrid.llm.gru import Gru, Rare, flatten, initial, make_classes, unflatten
from panelgrid.llm.job import column, map_batches, pack, stored, unpack
from panelgrid.llm.text import NOT_SPACE, bytes_of, mix, slabs, split_words, take_ranges

SYMBOLS = 1022  # words with a symbol of their own
CLASS_BITS = 10  # of the hash: classes of the other words
PART = 512  # sub-vectors of each part of the hash
NODES = 1024  # vectors of the decisions, found by hash
LEARN_TOKENS = 1024  # training tokens below a decision that the recurrent state takes part in
FLAT = 4096  # parameters in a row when copies are averaged
ROUNDS = 2
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
RUN_TOKENS = 2_000_000  # tokens that a task lays out at a time
END = np.uint64(0x5EED0FE2D)  # the end's number among word hashes
UNKNOWN_WEIGHT = 0.5


def held_out(doc_id) -> "F.Column":
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def token_blocks(docs: DataFrame) -> DataFrame:
    """(block, size, body, words): body packs ids, known, held out, offsets and word numbers, each document with its end;
    words packs the distinct hashes in order and their training counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for slab in slabs(batches, "text", BLOCK_BYTES):
            data, offsets = bytes_of(column(slab, "text"))
            words = split_words(data, offsets, NOT_SPACE)
            n = slab.num_rows
            out = words.bounds + np.arange(n + 1)
            ends = out[1:] - 1
            hashes = np.full(len(words.hash) + n, END, dtype=np.uint64)
            inner = np.ones(len(hashes), dtype=bool)
            inner[ends] = False
            hashes[inner] = words.hash
            held = column(slab, "held_out").to_numpy(zero_copy_only=False)
            vocab, numbers = np.unique(hashes, return_inverse=True)
            trained = np.repeat(~held, np.diff(out))
            counts = np.bincount(numbers[trained], minlength=len(vocab)).astype(np.int32)
            ids = column(slab, "doc_id")
            body = pack(
                ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).view(np.uint8), held.view(np.uint8),
                out, numbers.astype(np.uint16 if len(vocab) < 1 << 16 else np.int32),
            )
            yield {"block": [block], "size": [len(data)], "body": [body], "words": [pack(vocab, counts)]}
            block += 1

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_batches(chosen, read, "block long, size long, body binary, words binary")


def word_messages(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, message): the words of a block in the bucket, a range of hashes, and their training counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for block, words in zip(column(batch, "block").to_pylist(), column(batch, "words")):
                vocab, counts = unpack(words.as_py())
                edges = np.searchsorted(vocab >> np.uint64(64 - buckets.bit_length() + 1), np.arange(buckets + 1)) if buckets > 1 else np.array([0, len(vocab)])
                full = np.flatnonzero(np.diff(edges))
                yield {
                    "bucket": full, "block": np.full(len(full), block),
                    "message": [pack(vocab[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]]) for i in full.tolist()],
                }

    return map_batches(blocks.select("block", "words"), send, "bucket long, block long, message binary")


def added(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct words of a bucket, their counts, and the places of each message's words among them."""
    parts = [unpack(m) for m in frame["message"]]
    words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.zeros(len(words), dtype=np.int64)
    np.add.at(total, which, np.concatenate([p[1] for p in parts]))
    return words, total, np.split(which, np.cumsum([len(p[0]) for p in parts])[:-1])


def cell_bits(buckets: int) -> int:
    """Bits of the hash by which words are summed: a cell lies in one bucket and in one class."""
    return max(CLASS_BITS, buckets.bit_length() - 1)


def bucket_sums(messages: DataFrame, buckets: int, symbols: int = SYMBOLS) -> DataFrame:
    """A row a bucket: tokens and distinct words of each of its cells, the count of the end, and its most frequent
    words, which may be among the first ``symbols`` of all."""
    cells = (1 << cell_bits(buckets)) // buckets

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        words, total, _ = added(frame)
        bucket = int(frame["bucket"].iloc[0])
        ends = int(total[words == END].sum())
        total[words == END] = 0
        cell = (words >> np.uint64(64 - cell_bits(buckets))).astype(np.int64) - bucket * cells
        best = np.lexsort((words, -total))[:symbols]
        best = best[total[best] > 0]
        return pd.DataFrame({
            "bucket": [bucket], "ends": [ends],
            "tokens": [np.bincount(cell, total, cells).astype(np.int64)], "distinct": [np.bincount(cell, total > 0, cells).astype(np.int64)],
            "top": [[{"word": int(w), "n": int(c)} for w, c in zip(words[best].view(np.int64), total[best])]],
        })

    return messages.groupBy("bucket").applyInPandas(
        add, "bucket long, ends long, tokens array<long>, distinct array<long>, top array<struct<word:long,n:long>>"
    )


def vocabulary(sums: DataFrame, buckets: int, symbols: int = SYMBOLS) -> dict:
    """Corpus totals, the symbols and the weight of the rare words of each cell; at most ``symbols`` words and two
    numbers a cell (1,024, or one a bucket) reach the driver."""
    bits = cell_bits(buckets)
    tokens, distinct = (np.zeros((buckets, (1 << bits) // buckets), dtype=np.int64) for _ in range(2))
    ends = 0
    for r in sums.select("bucket", "ends", "tokens", "distinct").collect():
        tokens[r["bucket"]], distinct[r["bucket"]] = r["tokens"], r["distinct"]
        ends += r["ends"]
    top = sums.select(F.explode("top").alias("t")).select("t.word", "t.n").orderBy(F.desc("n"), "word").limit(symbols).collect()
    n, v = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)
    words = np.array([r["word"] for r in top] + [END.astype(np.int64)], dtype=np.int64).view(np.uint64)
    own = np.array([r["n"] for r in top] + [ends], dtype=np.int64)
    tokens, distinct = tokens.reshape(-1), distinct.reshape(-1)
    cell = (words[:-1] >> np.uint64(64 - bits)).astype(np.int64)
    np.subtract.at(tokens, cell, own[:-1])
    np.subtract.at(distinct, cell, 1)
    mass = tokens + UNKNOWN_WEIGHT * distinct
    weights = np.concatenate([own, tokens.reshape(1 << CLASS_BITS, -1).sum(axis=1)])  # words, end, classes
    order = np.argsort(-weights, kind="stable")
    symbol = np.empty(len(weights), dtype=np.int16)
    symbol[order] = np.arange(len(weights))
    by_hash = np.argsort(words)
    parts = 1
    while PART**parts << CLASS_BITS < 8 * v:  # few words share their class and all parts
        parts += 1
    return {
        "n": n, "v": v, "words": words[by_hash], "symbols": symbol[: len(words)][by_hash], "classes": symbol[len(words) :],
        "end": int(symbol[len(top)]), "counts": weights[order].astype(np.float64), "parts": parts,
        "mass": mass, "class_mass": mass.reshape(1 << CLASS_BITS, -1).sum(axis=1),
    }


def paths(
    words: np.ndarray, weight: np.ndarray, bucket: int, buckets: int, mass: np.ndarray, least: float = LEARN_TOKENS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decisions of the ordered rare ``words`` of a bucket below their class, word by word: how many, the bit of each, and the
    log odds of the side taken by weight. Bits that all words of a node share are no decision, nor are nodes of less
    weight than ``least``: the last array has the log share that each word has of what its decisions lead to."""
    at, bit, odds = [], [], []
    depth, bits = buckets.bit_length() - 1, cell_bits(buckets)
    inside = np.full(len(words), mass.reshape(1 << CLASS_BITS, -1)[(bucket << CLASS_BITS) >> depth].sum()) if depth > CLASS_BITS else None
    for b in range(CLASS_BITS, depth):  # above the bucket
        own = bucket >> (depth - b - 1)
        taken, other = (mass[c << (bits - b - 1) : (c + 1) << (bits - b - 1)].sum() for c in (own, own ^ 1))
        if taken + other < least:
            break
        inside[:] = taken
        if other > 0:
            at.append(np.arange(len(words)))
            bit.append(np.full(len(words), b))
            odds.append(np.full(len(words), np.log(taken / other)))
    left, b = np.arange(len(words)), max(CLASS_BITS, depth)
    if inside is None:
        held = words >> np.uint64(64 - b)
        node = np.cumsum(np.append(True, held[1:] != held[:-1])[: len(words)]) - 1
        inside = np.bincount(node, weight)[node] if len(words) else np.empty(0)
    while len(left):
        held = words[left] >> np.uint64(64 - b)
        new = np.append(True, held[1:] != held[:-1])
        node = np.cumsum(new) - 1
        whole = np.bincount(node, weight[left])[node]
        several = (np.bincount(node)[node] > 1) & (whole >= least)
        left, new, whole = left[several], new[several], whole[several]
        if not len(left):
            break
        node = np.cumsum(new) - 1
        below = words[left] >> np.uint64(63 - b)
        child = np.cumsum(np.append(True, below[1:] != below[:-1])) - 1
        taken = np.bincount(child, weight[left])[child]
        split = np.bincount(node)[node] > np.bincount(child)[child]
        inside[left] = taken
        at.append(left[split])
        bit.append(np.full(int(split.sum()), b))
        odds.append(np.log(taken[split] / (whole - taken)[split]))
        b += 1
    share = np.log(weight / inside).astype(np.float32)
    if not at:
        return np.zeros(len(words), dtype=np.uint8), np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.float16), share
    at, bit, odds = np.concatenate(at), np.concatenate(bit), np.concatenate(odds)
    order = np.argsort(at, kind="stable")
    return np.bincount(at, minlength=len(words)).astype(np.uint8), bit[order].astype(np.uint8), odds[order].astype(np.float16), share


def word_replies(messages: DataFrame, model: dict, buckets: int) -> DataFrame:
    """(block, bucket, reply): counts, decisions and last shares of a block's words, in their order."""
    frequent, mass = model["words"], model["mass"]

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        words, total, places = added(frame)
        rare = (total > 0) & ~np.isin(words, frequent)
        sizes = np.zeros(len(words), dtype=np.uint8)
        share = np.zeros(len(words), dtype=np.float32)
        own = int(frame["bucket"].iloc[0])
        sizes[rare], bit, odds, share[rare] = paths(words[rare], total[rare] + UNKNOWN_WEIGHT, own, buckets, mass)
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        replies = []
        for own in places:
            steps = take_ranges(first[own], sizes[own].astype(np.int64))
            by_bit = np.argsort(bit[steps], kind="stable")  # neighbours share the odds of their first bits
            replies.append(pack(total[own], sizes[own], bit[steps], odds[steps][by_bit], share[own]))
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "reply": replies})

    return messages.groupBy("bucket").applyInPandas(add, "block long, bucket long, reply binary")


def opened(words: bytes, replies: list, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rare]:
    """Of a block's distinct words: hash, count, log share below all decisions, symbol, place among the rare ones or -1; and these."""
    vocab = unpack(words)[0]
    parts = [unpack(r["reply"]) for r in sorted(replies, key=lambda r: r["bucket"])]
    count, sizes, bit, share = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 4))
    bias, done = np.empty(len(bit), dtype=np.float16), 0
    for p in parts:
        bias[done + np.argsort(p[2], kind="stable")] = p[3]
        done += len(p[2])
    at = np.minimum(np.searchsorted(model["words"], vocab), len(model["words"]) - 1)
    rare = model["words"][at] != vocab
    symbol = np.where(rare, model["classes"][(vocab >> np.uint64(64 - CLASS_BITS)).astype(np.int64)], model["symbols"][at])
    place = np.where(rare, np.cumsum(rare) - 1, -1).astype(np.int32)
    mixed = mix(vocab[rare])
    rows = [len(model["counts"]) + PART * j + ((mixed >> np.uint64(9 * j)) & np.uint64(PART - 1)) for j in range(model["parts"])]
    held, bit = np.repeat(vocab, sizes), bit.astype(np.uint64)
    prefix = held >> (np.uint64(64) - bit)
    node = mix(prefix * np.uint64(64) + bit) & np.uint64(NODES - 1)
    side = ((held >> (np.uint64(63) - bit)) & np.uint64(1)).astype(np.int8) * np.int8(2) - np.int8(1)
    first = np.append(0, np.cumsum(sizes[rare], dtype=np.int64))
    return vocab, count, share, symbol.astype(np.int16), place, Rare(
        np.stack(rows, axis=1).astype(np.int16), first, node.astype(np.int16), side, bias
    )


def joined(tables: list[Rare], words: list[np.ndarray]) -> tuple[np.ndarray, Rare]:
    """Rare words of several blocks as one table, and the blocks' words in it."""
    kinds = np.cumsum([0] + [len(t.parts) for t in tables])
    steps = np.cumsum([0] + [len(t.node) for t in tables])
    rare = Rare(
        np.concatenate([t.parts for t in tables]),
        np.concatenate([t.first[:-1] + s for t, s in zip(tables, steps)] + [steps[-1:]]),
        *(np.concatenate([getattr(t, name) for t in tables]) for name in ("node", "side", "bias")),
    )
    return np.concatenate([np.where(w >= 0, w + k, -1).astype(np.int32) for w, k in zip(words, kinds.tolist())]), rare


def train(blocks: DataFrame, model: dict, rounds: int = ROUNDS) -> tuple[dict, np.ndarray]:
    """Parameters after all training documents were seen once, and the class edges."""
    edges = make_classes(model["counts"])
    params = initial(model["counts"], edges, parts=PART * model["parts"], nodes=NODES)
    for turn in range(rounds):
        flat = flatten(params)
        share = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == turn)

        def learn(batches: Iterator[pa.RecordBatch], flat=flat) -> Iterator[dict]:
            gru, seen = Gru(unflatten(flat, params), edges), 0
            ids, sizes, words, tables = [], [], [], []

            def step():
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                gru.run(np.concatenate(ids), offsets, model["end"], True, *joined(tables, words))

            for batch in batches:
                for body, hashes, got in zip(column(batch, "body"), column(batch, "words"), column(batch, "replies").to_pylist()):
                    _, _, held, offsets, numbers = unpack(body.as_py())
                    *_, symbol, place, rare = opened(hashes.as_py(), got, model)
                    length = np.diff(offsets)
                    keep = held == 0
                    numbers = numbers[np.repeat(keep, length)]
                    ids.append(symbol[numbers])
                    words.append(place[numbers])
                    tables.append(rare)
                    sizes.append(length[keep])
                    seen += len(numbers)
                    if sum(map(len, ids)) >= RUN_TOKENS:
                        step()
                        ids, sizes, words, tables = [], [], [], []
            if ids and sum(map(len, ids)):
                step()
            if seen:
                gru.finish()
                flat = flatten(gru.p)
                for a in range(0, len(flat), FLAT):
                    yield {"at": [a], "seen": [seen], "flat": [flat[a : a + FLAT].tobytes()]}

        def average(frame: pd.DataFrame) -> pd.DataFrame:
            own = sum(n * np.frombuffer(f, dtype=np.float32).astype(np.float64) for n, f in zip(frame["seen"], frame["flat"]))
            return pd.DataFrame({"at": frame["at"].iloc[:1], "flat": [(own / frame["seen"].sum()).tobytes()]})

        copies = map_batches(share.select("body", "words", "replies"), learn, "at long, seen long, flat binary")
        found = stored(copies).groupBy("at").applyInPandas(average, "at long, flat binary").toPandas()  # the model's parameters
        if len(found):
            params = unflatten(np.frombuffer(b"".join(found.sort_values("at")["flat"]), dtype=np.float64), params)
    return params, edges


def score_documents(docs: DataFrame, symbols: int = SYMBOLS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text; scores are log10.

    Training documents are those whose crc32(doc_id as text) mod 5 is not 1; a null id counts as an empty text. Null, empty and
    wordless texts are the end alone. Repeated rows count and are scored each. Without training documents no token is known
    and the model is the untrained one. An empty table gives no rows; other columns are ignored.
    """
    blocks = stored(token_blocks(docs))
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = 1 << int(total // BUCKET_BYTES).bit_length()
    messages = word_messages(blocks, buckets)
    model = vocabulary(stored(bucket_sums(messages, buckets, symbols)), buckets, symbols)
    replies = stored(word_replies(messages, model, buckets)).groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("replies")
    )
    table = blocks.select("block", "body", "words").join(replies, "block")
    params, edges = train(table, model, rounds)
    n, v = model["n"], model["v"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        gru, held_blocks = Gru(params, edges), []

        def answer():
            sizes = [np.diff(row[3]) for row, _ in held_blocks]
            ids = [words[3][row[4]] for row, words in held_blocks]
            words = joined([words[5] for _, words in held_blocks], [words[4][row[4]] for row, words in held_blocks])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            found = gru.run(np.concatenate(ids), offsets, model["end"], False, *words).astype(np.float64) / np.log(10)
            first = 0
            for (doc_ids, known, held, bounds, numbers), (vocab, c, share, _, place, _) in held_blocks:
                at = found[first : first + len(numbers)]
                first += len(numbers)
                logs = np.log10((c + UNKNOWN_WEIGHT) / (n + UNKNOWN_WEIGHT * (v + 1)))
                rest = model["class_mass"][(vocab >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
                # a class holds its known words and one unknown
                inside = np.log10(np.where(c > 0, rest, UNKNOWN_WEIGHT) / (rest + UNKNOWN_WEIGHT), where=place >= 0, out=np.zeros(len(c)))
                tokens = at + (inside + share / np.log(10))[numbers]
                sums = lambda values: np.add.reduceat(values, bounds[:-1])
                yield {
                    "doc_id": pa.array(doc_ids, mask=known == 0), "held_out": held.astype(bool), "n_tokens": np.diff(bounds),
                    "n_known": sums((c > 0)[numbers].astype(np.int64)), "train_tokens": np.full(len(doc_ids), n),
                    "base_score": sums(logs[numbers]), "score": sums(tokens),
                }

        for batch in batches:
            for body, words, got in zip(column(batch, "body"), column(batch, "words"), column(batch, "replies").to_pylist()):
                held_blocks.append((unpack(body.as_py()), opened(words.as_py(), got, model)))
                if sum(len(row[4]) for row, _ in held_blocks) >= RUN_TOKENS:
                    yield from answer()
                    held_blocks = []
        if held_blocks:
            yield from answer()

    return map_batches(
        table.select("body", "words", "replies"), read,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
