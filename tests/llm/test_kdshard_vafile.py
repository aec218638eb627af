import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelgrid.llm import kdshard, vafile
from tests.llm.conftest import awkward_rows, prose


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out


def test_shards_are_even_and_slots_gapless(spark):
    hot = prose(0, 30)  # a third of all rows
    rows = [(i, hot if i % 3 == 0 else prose(i, 5 + i % 70)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = kdshard.kd_shards(df, 24, slot_rows=20).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    shards = by_shard(got)
    assert sorted(shards) == list(range(24))
    sizes = [sum(r["size"] for r in s) for s in shards.values()]
    assert max(sizes) < 1.03 * min(sizes)
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    texts = dict(rows)
    where = defaultdict(set)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        where[texts[r["doc_id"]]].add(r["shard"])
    split = [t for t, s in where.items() if len(s) > 1]
    assert all(t == hot or len(where[t]) <= 2 for t in split) and len(split) <= 24


def test_one_row_repeated_is_cut_too(spark):
    rows = [(7, prose(0, 30)) if i % 3 == 0 else (i, prose(i, 5 + i % 70)) for i in range(1500)]
    got = kdshard.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24, slot_rows=20).collect()
    shards = by_shard(got)
    sizes = [sum(r["size"] for r in s) for s in shards.values()]
    assert len(got) == 1500 and len(shards) == 24 and max(sizes) < 1.05 * min(sizes)
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))


def plain_leaves(points, shards, scale, first=0):
    """The same tree by sorting: {row_key: leaf}."""
    if shards == 1 or not points:
        return {p["row_key"]: first for p in points}
    spread = lambda d: (max(p[d] for p in points) - min(p[d] for p in points)) / scale[d]
    widest = max(kdshard.DIMENSIONS, key=spread)
    points = sorted(points, key=lambda p: (p[widest], p["text_key"], p["row_key"]))
    half = shards // 2
    wanted, lower = sum(p["size"] for p in points) * half / shards, 0
    while lower < len(points) - 1 and points[lower]["size"] <= wanted:
        wanted -= points[lower]["size"]
        lower += 1
    lower += wanted > points[lower]["size"] / 2
    return plain_leaves(points[:lower], half, scale, first) | plain_leaves(points[lower:], shards - half, scale, first + half)


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_leaves_equal_sorted_medians(spark, monkeypatch, shards):
    monkeypatch.setattr(kdshard, "TOLERANCE", 0)
    rows = [(i, prose(0, 30) if i % 4 == 0 else prose(i, 3 + i % 50) + "\n" * (i % 7) + "é" * (i % 11)) for i in range(160)]
    rows += [(1, rows[1][1])] * 20 + [(200, None), (201, "")]
    points = kdshard.stored(kdshard.measured(spark.createDataFrame(rows, "doc_id long, text string")))
    got = {r["row_key"]: r["node"] for r in kdshard.kd_leaves(points, shards).collect()}
    plain = [r.asDict() for r in points.collect()]
    assert len(got) == len(plain) == len(rows)
    assert got == plain_leaves(plain, shards, {d: max(1, max(p[d] for p in plain)) for d in kdshard.DIMENSIONS})


def test_awkward_and_empty(spark, awkward, empty):
    got = kdshard.kd_shards(awkward, 5).collect()
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in awkward_rows())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert all(0 <= r["shard"] < 5 for r in got)
    for s in by_shard(got).values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    assert kdshard.kd_shards(empty, 5).count() == 0


def brute(rows, k, every):
    ok = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    out = []
    for q, a in ok.items():
        if q % every:
            continue
        near = sorted((-int(a @ b), i) for i, b in ok.items() if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_search_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", block_rows)
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(0, 0.3, 6).tolist()) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(120, 180)]  # ties in plenty
    rows += [(200, None), (201, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (210, [float("nan")] * 6), (220, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (230, [0.2, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = vafile.integer_vectors(df.selectExpr("vec_id", "embedding", "'x' AS block", "1 AS rank"), "vec_id", "embedding")
    got = vafile.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 5, 10)


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<double>")
    v = vafile.integer_vectors(one, "vec_id", "embedding")
    assert [tuple(r)[:4] for r in vafile.top_k(v, v.where("vec_id = 0"), 5).collect()] == [(0, 1, 5, 131072)]
    none = v.where("vec_id > 9")
    assert vafile.top_k(none, none, 5).count() == 0


def test_queries_that_share_an_id_get_a_list_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])]
    v = vafile.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    lists = defaultdict(list)
    for r in vafile.top_k(v, v.where("vec_id = 0"), 2).orderBy("rank").collect():
        lists[r["query_key"]].append((r["query_id"], r["rank"], r["vec_id"], r["score"] // 65536))
    assert sorted(lists.values()) == [[(0, 1, 1, 3), (0, 2, 2, 1)], [(0, 1, 2, 3), (0, 2, 2, 3)]]


def test_bounds_hold():
    draw = np.random.default_rng(3)
    exact = draw.integers(-500, 500, (200, 8))
    q = draw.integers(-500, 500, (9, 8))
    low = exact.min(axis=0)
    width = (exact.max(axis=0) - low) // vafile.CELLS + 1
    under, over = vafile.bounds(q, ((exact - low) // width), low, width)
    score = q @ exact.T
    assert (under <= score).all() and (score <= over).all()
