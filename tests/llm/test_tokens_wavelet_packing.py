import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelgrid.llm import packing, wavelet
from panelgrid.llm.tokens import encoder, tokenizer_path
from tests.llm.conftest import awkward_rows

ODD = [
    "", None, "Hello'S it'll ½ ² café É İstanbul ΑΣ", "x\u0085y\u001cz <|endoftext|> q", "日本語", "don't 'll''s ..'s x'",
    "naïve — “q”", "\n\t", "'s", "it'", "'", "'re'vexx l'l", "Ünder's ÉCOLE's 12's3 ' 's", "é nfc", "a" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_the_library(library):
    texts = ODD + [t for _, t in awkward_rows()]
    code = encoder(tokenizer_path())
    for _ in range(2):  # the second time from the table
        ids, offsets = code.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == ids_of(library, text), text
        code.clear()


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (700, 3), (5000, 49000), (300_000, 900)])
def test_wavelet_matrix_answers(n, top):
    draw = np.random.default_rng(n)
    ids = draw.integers(0, top, n).astype(np.uint32)
    lengths = np.array([n // 3, 0, n - n // 3])
    m = wavelet.WaveletMatrix(
        wavelet.WaveletMatrix.build(ids, np.array([4, 9, 2]), np.array([True, True, False]), lengths)
    )
    assert m.tokens().tolist() == ids.tolist()
    assert m.doc_start.tolist() == [0, n // 3, n // 3, n]
    for i in draw.integers(0, n, 12) if n else []:
        token = int(ids[i])
        assert m.access(int(i)) == token
        assert m.rank(token, int(i)) == int((ids[:i] == token).sum())
        assert m.count(token) == int((ids == token).sum())
        assert m.select(token, m.rank(token, int(i))) == i
    assert m.count(top + 70_000) == 0
    with pytest.raises(IndexError):
        m.select(1, n + 1)


@pytest.mark.parametrize("shard_tokens", [500, 1 << 22])
def test_shards_round_trip(spark, awkward, library, shard_tokens):
    shards = wavelet.write_shards(awkward, shard_tokens=shard_tokens)
    starts = {(r["part"], r["shard"]): r["before"] for r in wavelet.shard_starts(shards).collect()}
    got = sorted(
        (starts[r["part"], r["shard"]] + r["start"], r["doc_id"], bytes(r["ids"])) for r in wavelet.read_documents(shards).collect()
    )
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for doc_id, text in rows:
        ids = np.array(ids_of(library, text), dtype="<u4")
        want.append((at, doc_id, ids.tobytes()))
        at += len(ids)
    assert got == want


def test_empty_table(spark, empty):
    assert wavelet.read_documents(wavelet.write_shards(empty)).count() == 0
    assert packing.pack_documents(empty).count() == 0


def naive_best_fit(lengths, capacity):
    free = []
    for length in sorted(lengths, reverse=True):
        fit = [(f, i) for i, f in enumerate(free) if f >= length]
        if fit:
            free[min(fit)[1]] -= length
        else:
            free.append(capacity - length)
    return sorted(free)


@pytest.mark.parametrize("capacity,seed", [(10, 0), (64, 1), (64, 2), (100, 3)])
def test_runs_are_best_fit_decreasing(capacity, seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, capacity + 1, 400).tolist() + [capacity // 3] * 90 + [1] * 50
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.best_fit_runs(counts, capacity)
    bins: dict[int, list] = {}
    keys = runs[:, 0] * (1 << 48) + runs[:, 1]
    for length, n in counts.items():
        for rank in range(n):
            run = runs[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            step = rank - run[1]
            bins.setdefault(int(run[2] + step // run[3]), []).append((int(run[4] + step % run[3] * length), length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == naive_best_fit(lengths, capacity)


def test_packed_documents(spark, awkward, library):
    capacity = 700
    rows = packing.pack_documents(awkward, capacity).collect()
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc_id, text in awkward_rows():
        ids = np.array(ids_of(library, text), dtype="<u4")
        for piece in range(-(-len(ids) // capacity)):
            part = ids[piece * capacity : (piece + 1) * capacity]
            want.append((doc_id, piece, piece * capacity, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len(held) == len(naive_best_fit([r["length"] for r in rows], capacity))


def test_sequences_hold_the_ids(spark, library):
    texts = {1: "a few words", 2: "other words here", 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = packing.sequences(docs, packing.pack_documents(docs, 4)).collect()
    found = {}
    for row in out:
        for p in row["pieces"]:
            found.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], dtype="<u4").tolist())
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(ids_of(library, t)) for k, t in texts.items()}
