import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.llm import bwt, neardup, substrings
from panelgrid.llm.components import connected_components
from panelgrid.llm.text import NOT_SPACE, bytes_of, range_hash, shingle_sets, split_words
from tests.llm.conftest import awkward_rows, prose, with_clashes


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(shingles(t)), find(i) if i is not None else None, i is None or find(i) == i) for i, t in rows), key=str)


def variants(n, edits, seed):
    draw = random.Random(seed)
    base = prose(50, 140).split()
    out = []
    for i in range(n):
        words = list(draw.choice(out)[1].split()) if out and draw.random() < 0.5 else list(base)
        for _ in range(draw.randrange(edits)):
            words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
        out.append((1000 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("part_docs", [16, 1024])
def test_components_equal_brute_force(spark, monkeypatch, part_docs):
    monkeypatch.setattr(neardup, "PART_DOCS", part_docs)
    rows = awkward_rows() + variants(150, 5, 0) + [(3000 + i, prose(1, 120)) for i in range(40)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    for percent in (85, 80):
        got = sorted((tuple(r) for r in neardup.near_duplicates(df, percent).collect()), key=str)
        assert got == brute(rows, percent)


def test_empty_and_rows_that_stay(spark, empty, awkward):
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.without_near_duplicates(awkward, 85)
    assert sorted(kept.columns) == sorted(awkward.columns)
    want = [r for r in brute(awkward_rows(), 85) if r[3]]
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # of the two rows with id 5 one stays; rows without an id all do
    assert ids == sorted([*{str(r[0]) for r in want if r[0] is not None}, "None", "None"])


def test_stars_find_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300) if i % 37] + [(1000, 1000 + i) for i in range(1, 400)] + [(draw.randrange(5000, 5060), draw.randrange(5000, 5060)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingle_sizes_and_band_recall():
    import pyarrow as pa

    texts = [t for _, t in awkward_rows()]
    data, offsets = bytes_of(pa.array(texts))
    sets = shingle_sets(split_words(data, offsets, NOT_SPACE))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for t in (0.8, 0.85):
        assert neardup.miss(t, neardup.rows_for(t)) <= neardup.MISS < neardup.miss(t, neardup.rows_for(t) + 1)
    draw = np.random.default_rng(4)
    missed = 0
    for _ in range(300):  # pairs right at the threshold
        common, own = draw.integers(0, 1 << 63, 170, dtype=np.uint64), draw.integers(0, 1 << 63, 30, dtype=np.uint64)
        pair = [np.unique(np.concatenate([common, own[:15]])), np.unique(np.concatenate([common, own[15:]]))]
        keys = neardup.band_keys(neardup.minima_of(pair), neardup.rows_for(0.85))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


@pytest.mark.parametrize("seed,symbols,length", [(0, 2, 5), (1, 3, 6), (2, 200, 3), (3, 1, 4)])
def test_interval_expansion_equals_brute_force(seed, symbols, length):
    draw = np.random.default_rng(seed)
    strings = [draw.integers(1, symbols + 1, n) for n in draw.integers(0, 40, 30)]
    text = np.concatenate([np.append(s, 0) for s in strings]).astype(np.int16)
    wide = np.array([len(s) + 1 for s in strings])
    ends = np.repeat(np.cumsum(wide) - 1, wide)
    order = bwt.suffix_order(text, ends, 40)
    suffixes = [tuple(text[i : ends[i]].tolist()) for i in order]
    assert suffixes == sorted(suffixes)
    places, classes = bwt.repeats(text, ends, length)
    found = {}
    for p, c in zip(places.tolist(), classes.tolist()):
        found.setdefault(c, set()).add(p)
    want = {}
    for p in range(len(text)):
        if p + length <= ends[p]:
            want.setdefault(tuple(text[p : p + length].tolist()), set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("length", [9, 20, 50])
def test_expansion_from_the_ranks_of_the_sort_equals_brute_force(length):
    draw = np.random.default_rng(length)
    pool = draw.integers(1, 4, 300)
    strings = [np.concatenate([pool[a : a + n], draw.integers(1, 256, 3), pool[b : b + n]]) for a, b, n in draw.integers(0, 220, (40, 3))]
    strings += [np.full(n, 7) for n in (0, 1, 30, 90)]
    text = np.concatenate([np.append(s, 0) for s in strings]).astype(np.int16)
    wide = np.array([len(s) + 1 for s in strings])
    ends = np.repeat(np.cumsum(wide) - 1, wide)
    order, known, rank = bwt.ordered(text, ends, length)
    assert 8 <= known < length
    first = [tuple(text[i : min(i + known, ends[i] + 1)].tolist()) for i in order]
    assert [a == b for a, b in zip(first, first[1:])] == (np.diff(rank[order].astype(int)) == 0).tolist()
    want = {}
    for p in range(len(text)):
        if p + length <= ends[p]:
            want.setdefault(tuple(text[p : p + length].tolist()), set()).add(p)
    found = {}
    for p, c in zip(*map(np.ndarray.tolist, bwt.repeats(text, ends, length))):
        found.setdefault(c, set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def removed(rows, length):
    last = 1 << 70
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, last + 1), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (last if i is None else i):
                gone[k : k + length] = [True] * length
        spans, kept = [], bytes(c for c, g in zip(b, gone) if not g)
        for k, g in enumerate(gone):
            if g and (k == 0 or not gone[k - 1]):
                spans.append([k, k])
            if g:
                spans[-1][1] = k + 1
        out.append((i, len(b), tuple(map(tuple, spans)), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes", [1 << 11, 1 << 24])
def test_repeated_substrings_equal_brute_force(spark, bucket_bytes):
    rows = awkward_rows() + variants(25, 6, 1) + [(500 + i, "ab" * 40 + prose(60 + i, 12) + "x" * (40 + i)) for i in range(12)]
    rows += [(700, prose(70, 60)), (699, prose(71, 20) + prose(70, 60)[30:200] + prose(72, 9)), (None, prose(70, 60)[100:])]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    got = [
        (r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"]))
        for r in substrings.remove_repeats(df, 50, bucket_bytes).collect()
    ]
    assert sorted(got, key=str) == removed(rows, 50)


def phrases():
    """A frequent phrase in texts that all differ around it."""
    rows = [(900 + i, prose(2000 + i, 6) + " the same frequent phrase of more than fifty bytes, in every text " + prose(4000 + i, 6)) for i in range(60)]
    return rows + awkward_rows()


@pytest.mark.parametrize("hot", [2, 20])
def test_hot_anchors_equal_brute_force(spark, hot):
    df = with_clashes(spark.createDataFrame(phrases(), "doc_id long, text string")).repartition(4)
    got = [
        (r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"]))
        for r in substrings.remove_repeats(df, 50, 1 << 11, hot).collect()
    ]
    assert sorted(got, key=str) == removed(phrases(), 50)


@pytest.mark.parametrize("hot", [20, 1 << 16])
def test_segments_of_a_group_are_bounded(spark, hot):
    table = substrings.chunks(spark.createDataFrame(phrases(), "doc_id long, text string").repartition(4)).cache()
    marks = substrings.marked_anchors(substrings.anchor_messages(table, 8, 50), hot).withColumnRenamed("marks", "reply")
    groups = {}
    for r in substrings.segment_messages(substrings.with_replies(table, marks), 8, 50).where("bucket >= 0").collect():
        anchor, _, count, data = substrings.unpack(bytes(r["block"]))
        at = 0
        for a, n in zip(anchor.tolist(), count.tolist()):
            groups.setdefault(a, set()).add(data[at : at + n + 49].tobytes())
            at += n + 49
    assert (max(map(len, groups.values())) <= 20) == (hot == 20)  # without splitting the phrase's edges are one group


def segments_of(texts):
    """The segments of the texts, text i in document i; as they reach the task that solves them."""
    import pyarrow as pa

    data, offsets = bytes_of(pa.array(texts))
    s = substrings.Segments(data, offsets, 50)
    size = s.count + 49
    return s.anchor, s.row, s.count, np.cumsum(size) - size, s.bytes_at(np.arange(len(s.start)))


def test_strings_that_occur_once_stay_out_of_the_transform(monkeypatch):
    """A frequent anchor in texts that share no 50 bytes, and one pair that does: the transform has the pair's runs only."""
    texts = [prose(100 + i, 8) + " sixteen bytes, and " + prose(300 + i, 8) for i in range(400)]
    both = prose(9, 40)
    texts += [both + " " + prose(10, 9), prose(11, 9) + " " + both[60:]]
    sizes = []
    expand = substrings.repeats
    monkeypatch.setattr(substrings, "repeats", lambda text, *more: sizes.append(len(text)) or expand(text, *more))
    anchor, row, count, begin, data = segments_of(texts)
    least = substrings.smallest_documents(anchor, row, count, begin, data, 50)
    first, want = {}, []
    for b, n, d in zip(begin.tolist(), count.tolist(), row.tolist()):
        for k in range(b, b + n):
            first[data[k : k + 50].tobytes()] = min(d, first.get(data[k : k + 50].tobytes(), d))
            want.append(data[k : k + 50].tobytes())
    assert least.tolist() == [first[s] for s in want]
    assert (least != np.repeat(row, count)).any()
    assert sum(sizes) < 1000 < len(data) / 100


@pytest.mark.parametrize("piece", [7, 100, 1 << 16])
def test_segments_do_not_depend_on_the_pieces_that_are_hashed(monkeypatch, piece):
    texts = [t or "" for _, t in awkward_rows()]
    whole = segments_of(texts)
    monkeypatch.setattr(substrings, "PIECE_BYTES", piece)
    assert all(np.array_equal(a, b) for a, b in zip(whole, segments_of(texts)))
    strings = sum(max(0, len(t.encode()) - 49) for t in texts)
    assert whole[2].sum() == strings
    size = whole[2] + 49
    assert substrings.hashes(whole[4], whole[3], size).tolist() == range_hash(whole[4], whole[3], whole[3] + size).tolist()


def test_ranges_with_equal_keys_are_told_apart_by_their_bytes():
    words = [b"one word and more", b"one word and mord", b"one word and more", b"eight by", b"one word and more!", b"two word and more"]
    size = np.array(list(map(len, words)))
    one, same = substrings.equal_ranges(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, np.zeros(6, np.uint64))
    assert [words[i] for i in one[same]] == words


def test_a_chunk_and_a_bucket_exchange_one_message_for_many_documents(spark):
    """The number of messages grows with chunks times buckets: chunks hold megabytes of text."""
    docs = spark.createDataFrame([(i, prose(i % 7, 40) * 1000) for i in range(20)], "doc_id long, text string").coalesce(1)
    sizes = [r["size"] for r in substrings.chunks(docs).select("size").collect()]
    assert sum(sizes) > 5 << 20 and len(sizes) <= 2


def test_no_documents(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0


def test_miss_counts_the_minima_that_bands_share():
    draw = np.random.default_rng(6)
    t, rows, trials = 0.6, 6, 4000
    band = np.random.default_rng(21)
    chosen = [band.choice(neardup.MINIMA, rows, replace=False) for _ in range(neardup.BANDS)]
    agree = draw.random((trials, neardup.MINIMA)) < t
    found = np.zeros(trials, dtype=bool)
    for c in chosen:
        found |= agree[:, c].all(axis=1)
    assert (~found).mean() == pytest.approx(neardup.miss(t, rows), rel=0.2)


def test_rows_that_share_an_id(spark):
    a, b = prose(61, 60), prose(62, 60)
    docs = spark.createDataFrame([(1, a, "x"), (9, a, "x"), (9, b, "x"), (12, b + " end", "x"), (7, None, "x"), (7, "", "x"), (30, a, "y"), (9, b, "w")], "doc_id long, text string, _gone string")
    for name in ("_again", "_document", "_of", "_row", "_n", "component_id", "id"):
        docs = docs.withColumn(name, F.lit("extra"))
    found = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs, 80).collect()}
    assert found == {(1, 1), (9, 1), (12, 1), (7, 7), (30, 1)}
    kept = neardup.without_near_duplicates(docs, 80)
    assert kept.columns == docs.columns
    # b is no copy of a smaller document's text: it stays, once
    assert sorted((r["doc_id"], str(r["text"]), r["_gone"]) for r in kept.collect()) == sorted([(1, a, "x"), (9, b, "w"), (7, "None", "x"), (7, "", "x")])
