"""Ranked search, part codes and repeated word windows against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.llm import debruijn, partcodes, ranked
from panelgrid.llm.job import stored
from panelgrid.llm.partcodes import compress, nearest, pivot_distances
from panelgrid.llm.ranked import Best, ranked_search, search
from tests.llm.conftest import awkward_rows, prose, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_ranking(docs, items, k):
    words = [terms(t) for _, t in docs]
    n, length = sum(1 for w in words if w), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w in zip(docs, words):
            tf, score = Counter(w), 0
            for t in terms(text):
                if tf[t]:
                    m = 75 + 25 * len(w) * n // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def ranking(df):
    return sorted(str(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


ITEMS = [
    (1, prose(1, 12)), (2, "alpha3 ALPHA3 beta7 nothing-at-all"), (3, None), (4, ""), (5, "çödé 日本"), (5, prose(3, 30)), (None, "one two"),
    (7, " ".join(prose(1, 120).split()[:60])), (8, "xyzzy"), (9, "alpha1 " * 50),
]


@pytest.mark.parametrize("k", [3, 20])
def test_ranked_search_equals_scoring_every_document(spark, awkward, k):
    items = with_clashes(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert ranking(ranked_search(awkward, items, k)) == plain_ranking(awkward_rows(), ITEMS, k)


def test_ranked_search_in_many_blocks_and_without_broadcast(spark, monkeypatch):
    rows = [(i, prose(i % 97, 20 + i % 40)) for i in range(600)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(ranked, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ranked, "ITEM_TERMS", 20)
    assert ranking(ranked_search(docs, items, 5)) == plain_ranking(rows, ITEMS, 5)


def test_ranked_search_of_empty_tables(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(empty, items).count() == 0
    assert ranked_search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0
    assert ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("false")).count() == 0


def test_search_skips_long_lists_and_loses_nothing():
    draw = np.random.default_rng(3)
    n, lists, every = 20_000, [], np.zeros(20_000, dtype=np.int64)
    for size, most in ((15_000, 5), (12_000, 8), (9_000, 30), (400, 900), (60, 2_000)):
        docs = np.sort(draw.choice(n, size, replace=False))
        scores = draw.integers(1, most + 1, size)
        every[docs] += scores
        lists.append((docs, scores, int(scores.max())))
    best, counter = Best(10), {}
    search(best, lists, np.arange(n), counter)
    order = np.lexsort((np.arange(n), -every))[:10]
    assert best.rank.tolist() == order.tolist() and best.score.tolist() == every[order].tolist()
    assert counter["read"] < 0.3 * sum(len(d) for d, _, _ in lists)


# --- part codes --------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-len(kept[0][2]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda c: [min(range(len(book[p])), key=lambda e: (square(c[p], book[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        codes = [assign(c) for c in cut]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if own:
                    book[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = [assign(c) for c in cut]
    errors = [sum(square(c[p], book[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    total = Counter()
    for (_, label, _), e in zip(kept, errors):
        total[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, "".join(f"{x:02x}" for x in code), e, total[label], sha)) for (i, label, _), code, e in zip(kept, codes, errors))


def vectors(seed, n, dim):
    draw = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in draw.normal(size=dim)], int(i % 3) if i % 5 else None) for i in range(n)]
    rows += [(2, rows[2][1], 1), (n, None, 1), (n + 1, [], 1)][:2] + [(n + 2, rows[0][1][:-1] + [float("nan")], 0)]
    rows += [(n + 3, rows[0][1][:-1] + [float("-inf")], 0), (n + 4, rows[0][1][:-1] + [None], 0), (None, rows[5][1], 2)]
    return rows + [(n + 5 + i, [3.0] * dim, 7) for i in range(40)]


@pytest.mark.parametrize("dim, parts, entries", [(8, 4, 16), (10, 4, 7), (6, 6, 64)])
def test_codes_equal_plain_rounds(spark, dim, parts, entries):
    rows = vectors(dim, 50, dim)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for name in ("block", "of", "in_block", "body", "code", "error", "v", "x"):
        table = table.withColumn(name, F.lit("extra"))
    found = compress(table, parts=parts, entries=entries)
    assert sorted(str(tuple(r)) for r in found.collect()) == plain_codes(rows, parts, entries, 2)


def test_codes_of_empty_other_dimensions_and_large_components(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert compress(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1e300, -1e300], "a"), (2, [0.0, 0.0], "a"), (3, [1.0, 2.0, 3.0], "b")]
    found = compress(spark.createDataFrame(rows, schema), parts=2, entries=1, rounds=0).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in found] == [1, 2] and found[1]["error"] == 2 * partcodes.LIMIT**2
    assert all(r["label_error"] == found[1]["error"] for r in found)


def test_pivots_save_distances():
    draw = np.random.default_rng(1)
    part, entries = draw.integers(-500, 500, (3000, 4)), draw.integers(-500, 500, (64, 4))
    pivots = partcodes.choose_pivots(entries[None], 4)
    index, best, done = nearest(part, pivot_distances(part[:, None], pivots)[0], entries, pivots[0])
    every = ((part[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert done < 0.35 * every.size


# --- repeated word windows ---------------------------------------------------------


def plain_windows(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [(i is None, i or 0) for i, _ in rows]
    least: dict = {}
    for r, w in zip(rank, words):
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            least[key] = min(least.get(key, r), r)
    out = []
    for (doc, _), r, w in zip(rows, rank, words):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < r:
                gone[i : i + length] = [True] * length
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(map(str, out))


def windows(df):
    out = []
    for r in df.collect():
        out.append((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"].decode()))
    return sorted(map(str, out))


def overlapping_rows():
    """Passages that begin and end anywhere in others, branch, repeat inside a document, and one word many times."""
    long = prose(40, 1500).split()
    rows = awkward_rows()
    for i in range(60):
        a = (i * 37) % 1400
        rows.append((100 + i, " ".join([*prose(200 + i, 9).split(), *long[a : a + 30 + i * 5], *prose(300 + i, 7).split(), *long[a // 2 : a // 2 + 70]])))
    rows += [(90, "same " * 130), (91, "same " * 61), (92, "same " * 49), (95, " ".join(long)), (95, " ".join(long[:400]) + " end"), (None, " ".join(long[100:300]))]
    return rows + [(500 + i, f"a{i} b{i} " + prose(77, 55) + f" c{i} d{i}") for i in range(40)]


@pytest.mark.parametrize("length, bucket_bytes, hot", [(50, 1 << 24, 1 << 16), (50, 4000, 25), (12, 3000, 0)])
def test_windows_equal_brute_force(spark, length, bucket_bytes, hot):
    rows = overlapping_rows()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    assert windows(debruijn.remove_repeated_windows(docs, length, bucket_bytes, hot)) == plain_windows(rows, length)


def test_windows_of_empty_and_wordless_tables(spark, empty):
    assert debruijn.remove_repeated_windows(empty).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " \t")], "doc_id long, text string")
    assert windows(debruijn.remove_repeated_windows(docs)) == sorted(map(str, [(1, 0, 0, ""), (2, 0, 0, ""), (None, 0, 0, "")]))


def paths(spark, rows, hot=1 << 16):
    table = stored(debruijn.word_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    messages = stored(debruijn.run_messages(table, debruijn.marked(debruijn.anchors(table, 50), hot), 8, 50))
    return table, debruijn.path_heads(stored(debruijn.solved(messages)))


def test_paths_are_whole_repeats_cut_where_they_branch(spark):
    long = prose(41, 900).split()
    _, heads = paths(spark, [(1, " ".join(long)), (2, "x " + " ".join(long) + " y")])
    found = heads.groupBy("source", "head").agg(F.max("end").alias("end"), F.count("*").alias("n")).collect()
    assert [(r["head"], r["end"]) for r in found] == [(0, 851)] and found[0]["n"] > 8
    # two documents leave the passage at word 400 in one way, two in another
    rows = [(i, " ".join([*long[:400], *(long[400:500] if i % 2 else prose(42, 100).split())])) for i in range(4)]
    _, heads = paths(spark, rows)
    found = sorted((r["head"], r["end"]) for r in heads.groupBy("source", "head").agg(F.max("end").alias("end")).collect())
    assert found == [(0, 351), (351, 451), (351, 451)]


def test_spans_that_differ_from_their_source_are_found(spark):
    long = prose(41, 300)
    table, _ = paths(spark, [(1, long), (2, long)])
    first = next(r for r in table.collect() if 1 in debruijn.opened(r["body"]).ids.tolist())
    c = debruijn.opened(first["body"])
    row = c.ids.tolist().index(1)
    at = c.bounds[row : row + 1] + 5
    true = int(debruijn.stretch(debruijn.second_sums(c), at, np.array([20 + 49])).view(np.int64)[0])
    source = (first["chunk"] << debruijn.ROW_BITS) | row
    hashes = spark.createDataFrame([(9, source, 5, 20, true), (9, source, 5, 20, true + 1)], "chunk long, source long, word long, n long, hash long")
    assert [r["hash"] for r in debruijn.differing(table, hashes, 50).collect()] == [true + 1]
