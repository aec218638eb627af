import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelgrid.llm import gru, gru_lm, toxicity
from tests.llm.conftest import awkward_rows, prose, with_clashes

FOLDER = "/root/testdata/sf0.01"


def small_model(seed=0):
    counts = np.array([50.0, 30, 20, 10, 5, 5, 3, 2, 1, 1])
    edges = gru.make_classes(counts, 3)
    return gru.initial(counts, edges, 4, seed), edges


def test_probabilities_sum_to_one():
    params, edges = small_model()
    model = gru.Gru(params, edges)
    for first in ([], [3], [3, 7, 1]):
        total = 0.0
        for symbol in range(10):
            ids = np.array([*first, symbol], dtype=np.int16)
            total += math.exp(model.run(ids, np.array([0, len(ids)]), 0, False)[-1])
        assert total == pytest.approx(1, abs=1e-5)


def test_state_is_carried_over_windows_and_cleared_between_documents(monkeypatch):
    params, edges = small_model()
    draw = np.random.default_rng(0)
    ids = draw.integers(0, 10, 90).astype(np.int16)
    offsets = np.array([0, 40, 41, 90])
    whole = gru.Gru(params, edges).run(ids, offsets, 0, False)
    monkeypatch.setattr(gru, "WINDOW", 3)
    assert gru.Gru(params, edges).run(ids, offsets, 0, False) == pytest.approx(whole, abs=1e-5)
    alone = np.concatenate([gru.Gru(params, edges).run(ids[a:b], np.array([0, b - a]), 0, False) for a, b in zip(offsets, offsets[1:])])
    assert alone == pytest.approx(whole, abs=1e-5)


def test_gradients(monkeypatch):
    params, edges = small_model(1)
    params = {k: v.astype(np.float64) for k, v in params.items()}
    monkeypatch.setattr(gru, "UPDATE_TOKENS", 1)
    seen = {}
    monkeypatch.setattr(gru.Gru, "_update", lambda self, grads, n: seen.update(grads))
    ids = np.array([1, 4, 2, 9, 0, 3, 3, 8, 0], dtype=np.int16)
    offsets = np.array([0, 5, 9])
    gru.Gru(params, edges).run(ids, offsets, 0, True)
    loss = lambda p: -gru.Gru(p, edges).run(ids, offsets, 0, False).astype(np.float64).sum()
    draw = np.random.default_rng(0)
    for name, grad in seen.items():
        flat = draw.integers(0, grad.size, 6)
        for i in flat.tolist():
            moved = []
            for step in (1e-2, -1e-2):
                p = {k: v.copy() for k, v in params.items()}
                p[name].reshape(-1)[i] += step
                moved.append(loss(p))
            assert (moved[0] - moved[1]) / 2e-2 == pytest.approx(float(grad.reshape(-1)[i]), abs=5e-3), name


def test_training_beats_the_unigram():
    draw = np.random.default_rng(0)
    ids, offsets = [], [0]
    for _ in range(400):  # each symbol is followed by the next but one
        start = int(draw.integers(1, 10))
        ids += [(start + 2 * i) % 9 + 1 for i in range(30)] + [0]
        offsets.append(len(ids))
    ids, offsets = np.array(ids, dtype=np.int16), np.array(offsets)
    counts = np.bincount(ids, minlength=10).astype(float)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(10, dtype=np.int16)
    rank[order] = np.arange(10)
    counts = counts[order]
    edges = gru.make_classes(counts, 3)
    model = gru.Gru(gru.initial(counts, edges), edges)
    before = model.run(rank[ids], offsets, int(rank[0]), False).mean()
    for _ in range(12):
        model.run(rank[ids], offsets, int(rank[0]), True)
    assert model.run(rank[ids], offsets, int(rank[0]), False).mean() > before + 0.5


def rare_model():
    """Six rare words behind the symbols 8 and 9, with two further rows of x each and a tree below each symbol."""
    params, edges = small_model(2)
    draw = np.random.default_rng(3)
    params["x"] = np.concatenate([params["x"], draw.normal(0, 0.5, (4, 12)).astype(np.float32)])
    params["v"] = draw.normal(0, 0.5, (4, 4)).astype(np.float32)
    # each symbol: a decision for the first word against the others, then one between these
    rare = gru.Rare(
        np.array([[10, 12], [11, 12], [10, 13]] * 2), np.array([0, 1, 3, 5, 6, 8, 10]), np.array([0, 0, 1, 0, 1, 2, 2, 3, 2, 3]),
        np.array([1, -1, 1, -1, -1] * 2, dtype=np.float32), np.array([0.7, -0.7, 0.2, -0.7, -0.2] * 2, dtype=np.float32),
    )
    return params, edges, rare


def test_rare_words_are_told_apart_and_sum_to_one():
    params, edges, rare = rare_model()
    model = gru.Gru(params, edges)
    kinds = [(i, -1) for i in range(8)] + [(8 + w // 3, w) for w in range(6)]
    last = {}
    for before in ([], [(8, 0)], [(8, 1)], [(3, -1), (9, 4)]):
        found = []
        for kind in kinds:
            symbols, words = (np.array(x) for x in zip(*before, kind))
            found.append(model.run(symbols.astype(np.int16), np.array([0, len(symbols)]), 0, False, words, rare)[-1])
        assert np.exp(found).sum() == pytest.approx(1, abs=1e-5)
        last[str(before)] = found
    assert abs(np.subtract(last["[(8, 0)]"], last["[(8, 1)]"])).min() > 1e-4  # one symbol, two words


def test_gradients_of_rare_words(monkeypatch):
    params, edges, rare = rare_model()
    params = {k: v.astype(np.float64) for k, v in params.items()}
    monkeypatch.setattr(gru, "UPDATE_TOKENS", 1)
    seen = {}
    monkeypatch.setattr(gru.Gru, "_update", lambda self, grads, n: seen.update(grads))
    ids, words = np.array([8, 4, 9, 8, 0, 3, 9, 8, 0], dtype=np.int16), np.array([0, -1, 5, 1, -1, -1, 4, 2, -1])
    offsets = np.array([0, 5, 9])
    gru.Gru(params, edges).run(ids, offsets, 0, True, words, rare)
    loss = lambda p: -gru.Gru(p, edges).run(ids, offsets, 0, False, words, rare).astype(np.float64).sum()
    draw = np.random.default_rng(0)
    for name, grad in seen.items():
        for i in draw.integers(0, grad.size, 24).tolist():
            moved = []
            for step in (1e-2, -1e-2):
                p = {k: v.copy() for k, v in params.items()}
                p[name].reshape(-1)[i] += step
                moved.append(loss(p))
            assert (moved[0] - moved[1]) / 2e-2 == pytest.approx(float(grad.reshape(-1)[i]), abs=5e-3), name


@pytest.mark.parametrize("most", [1, 16, 17, 700])
def test_rows_are_added_whatever_their_number(most):
    draw = np.random.default_rng(most)
    row = np.concatenate([np.repeat(5, most), draw.integers(0, 9, 40)]).astype(np.int16)
    values, source = draw.normal(size=(12, 3)), draw.integers(0, 12, len(row))
    total, expected = np.ones((10, 3)), np.ones((10, 3))
    np.add.at(expected, row, values[source])
    gru._add_rows(total, row, values, source)
    assert total == pytest.approx(expected)


@pytest.mark.parametrize("size", [1, 100, 3000])
def test_softmax_of_any_weights_and_shut_gates(size):
    """Logits up to thousands, where exponentials of unshifted rows leave the float range, and gates that are wholly shut."""
    params, edges = small_model(4)
    draw = np.random.default_rng(5)
    for name in ("wc", "wo", "x"):
        params[name] = draw.normal(0, size, params[name].shape).astype(np.float32)
    model = gru.Gru(params, edges)
    h = np.tanh(draw.normal(size=(30, 4))).astype(np.float32)
    y = draw.integers(0, 10, 30)
    whole = lambda logits: logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
    expected = []
    for state, symbol in zip(h.astype(np.float64), y.tolist()):
        c = int(model.class_of[symbol])
        a, b = edges[c], edges[c + 1]
        expected.append(whole(state @ params["wc"] + params["bc"])[c] + whole(state @ params["wo"][:, a:b] + params["bo"][a:b])[symbol - a])
    assert model._softmax(h, y, False)[0] == pytest.approx(np.array(expected), rel=1e-4, abs=1e-4)
    with np.errstate(all="raise", under="ignore"):
        assert np.isfinite(model.run(y.astype(np.int16), np.array([0, 30]), 0, True)).all()


@pytest.mark.parametrize("least", [0, 1500, 1e9])
@pytest.mark.parametrize("buckets", [1, 4, 4096])
def test_paths_give_each_word_its_share(buckets, least):
    draw = np.random.default_rng(1)
    words = np.sort(draw.integers(0, 1 << 55, 500, dtype=np.uint64))  # two classes
    weight = draw.integers(1, 50, 500) + 0.5
    bits = gru_lm.cell_bits(buckets)
    mass = np.bincount((words >> np.uint64(64 - bits)).astype(int), weight, 1 << bits)
    bucket = ((words >> np.uint64(44)).astype(int) * buckets) >> 20
    cls = (words >> np.uint64(54)).astype(int)
    for b in np.unique(bucket).tolist():
        mine = bucket == b
        sizes, _, odds, below = gru_lm.paths(words[mine], weight[mine], b, buckets, mass, least)
        assert (sizes.sum() == 0) == (least == 1e9)
        row = np.repeat(np.arange(len(sizes)), sizes)
        share = np.exp(below - np.bincount(row, np.logaddexp(0, -odds.astype(float)), len(sizes)))
        assert share == pytest.approx(weight[mine] / np.bincount(cls, weight)[cls[mine]], rel=2e-2)


def test_one_long_document_takes_few_lanes():
    lengths = np.array([5000] + [10] * 600)
    lane, first, total = gru.lay_out(lengths)
    assert len(total) == 3 and total.sum() == lengths.sum() and total.max() == 5000
    assert gru.lay_out(np.array([7]))[2].tolist() == [7] and gru.lay_out(np.array([3] * 2000))[2].max() == 12


def test_windows_of_few_lanes_do_not_change_scores(monkeypatch):
    counts = np.arange(20, 0, -1).astype(float)
    edges = gru.make_classes(counts, 4)
    draw = np.random.default_rng(2)
    offsets = np.array([0, 700, 705, 740])
    ids = draw.integers(0, 20, 740).astype(np.int16)
    model = gru.Gru(gru.initial(counts, edges, 8), edges)
    long = model.run(ids, offsets, 0, False)
    monkeypatch.setattr(gru, "WINDOW_TOKENS", 1)
    assert model.run(ids, offsets, 0, False) == pytest.approx(long, abs=1e-5)


def test_order_of_rare_words_counts(spark):
    held = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 1]
    trained = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 != 1]
    draw = np.random.default_rng(0)
    text = lambda k, step: " ".join(f"w{(k + step * i) % 60}" for i in range(40))
    rows = [(i, text(int(draw.integers(60)), 1)) for i in trained[:600]]
    rows += [(held[2 * k], text(k, 1)) for k in range(20)] + [(held[2 * k + 1], text(k + 39, -1)) for k in range(20)]  # the same words, backwards
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    score = {r["doc_id"]: r["score"] for r in gru_lm.score_documents(df, symbols=4).collect()}
    ahead, back = (np.array([score[held[2 * k + j]] for k in range(20)]) for j in (0, 1))
    assert (abs(ahead - back) > 1e-3).all() and ahead.sum() > back.sum()


def test_few_tokens_train_and_the_end_is_counted(spark):
    rows = [(i, prose(i, 300)) for i in range(8)]
    blocks = gru_lm.token_blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).cache()
    messages = gru_lm.word_messages(blocks, 1)
    model = gru_lm.vocabulary(gru_lm.bucket_sums(messages, 1, 3), 1, 3)  # the end is not among the three
    assert model["counts"][model["end"]] == sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(8))
    replies = gru_lm.word_replies(messages, model, 1).selectExpr("block", "array(struct(bucket, reply)) AS replies")
    params, edges = gru_lm.train(blocks.join(replies, "block"), model)
    start = gru.initial(model["counts"], edges, parts=gru_lm.PART * model["parts"], nodes=gru_lm.NODES)
    assert model["n"] < gru.UPDATE_TOKENS and abs(params["u"] - start["u"]).max() > 0


def base_of(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    counts = Counter()
    for i, t in rows:
        if fold(i) != 1:
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, fold(i) == 1, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


def test_counts_and_base_scores(spark):
    rows = awkward_rows() + [(40 + i, prose(40 + i, 60)) for i in range(30)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = gru_lm.score_documents(df).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(found, sorted(base_of(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_held_out_text_is_likelier_than_by_counts(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r for r in gru_lm.score_documents(df).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_documents_and_no_training(spark, empty):
    assert gru_lm.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = spark.createDataFrame([(held, "a b a")], "doc_id long, text string")
    r = gru_lm.score_documents(one).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (4, 0, 0) and math.isfinite(r["score"])


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.with_score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    right = np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows])
    assert right >= 0.85
    toxic, clean = [[r["score"] for r in rows if r["toxic"] == y] for y in (1, 0)]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.8


def test_a_row_keeps_its_own_subwords():
    texts = [t for _, t in awkward_rows()] + ["scum", "", "a", None, "kind"]
    together = toxicity.bags(pa.array(texts, pa.string()))
    for text, (buckets, counts) in zip(texts, together):
        alone = toxicity.bags(pa.array([text], pa.string()))[0]
        assert np.array_equal(buckets, alone[0]) and np.array_equal(counts, alone[1])


def test_an_id_with_many_rows_trains_once(spark):
    rows = [(i, ("vile scum " if i % 2 else "kind words ") + prose(i, 12)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    once = toxicity.fit(frame(rows), labels)
    hot = next(i for i in range(1, 60, 2) if zlib.crc32(str(i).encode()) % 5)
    many = toxicity.fit(frame(rows + [rows[hot]] * 200).repartition(4), labels)
    for name in once:
        assert np.array_equal(once[name], many[name])


def test_misspelt_words_share_vectors(spark):
    draw = np.random.default_rng(0)
    rows = [(i, prose(i, 40) + (f" stupid{'' if i % 4 else 'o'} idiot" if i % 2 else " friend teacher")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(0, prose(9000, 40) + " stupiid idiott"), (1, prose(9001, 40) + " teachers friendly")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.with_score(new, model).collect()}
    assert score[0] > 0.5 > score[1]


def test_scores_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 18)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    out = toxicity.with_score(awkward, model, score="p_toxic")
    assert out.columns == [*awkward.columns, "p_toxic"] and out.count() == awkward.count()
    assert all(0 <= r["p_toxic"] <= 1 and r["_toxicity"] == "extra" for r in out.collect())
    again = toxicity.with_score(awkward, model, score="_toxicity")  # a column of that name is replaced
    assert sorted(again.columns) == sorted(awkward.columns) and dict(again.dtypes)["_toxicity"] == "double"
    assert toxicity.with_score(empty, model).count() == 0
    assert toxicity.fit(awkward, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.with_score(awkward, None).collect()} == {0.0}
