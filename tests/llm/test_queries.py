"""The registered queries against their SQL, and the pipeline's stages on planted rows."""

import pytest

import corpus_pipeline
from panelgrid.llm.queries import QUERIES, SQL
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.001"
LABELS = ["stupid idiot moron", "pathetic loser scum"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_document_is_answered(spark, name):
    df = QUERIES[name](spark, FOLDER)
    key = "vec_id" if "va_file" in name or "part_codes" in name else "doc_id"
    assert key in df.columns and df.count() > 0


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    bench = prose(5000, 30)
    rows = [(i, prose(i, 80) + ((" " + LABELS[i % 2]) * 6 if i % 4 == 1 else ""), "en", "s", 0) for i in range(800)]
    copy = prose(2, 80)
    rows += [(900, copy, "en", "s", 0), (901, copy + " end", "en", "s", 0), (902, prose(7777, 20) + " " + bench + " " + prose(7778, 30), "en", "s", 0)]
    rows += [(903, prose(7779, 30) + " write to some.one@mail.example or 10.1.2.3", "en", "s", 0), (904, None, None, None, None), (None, "", "en", "s", 0)]
    rows += [(905, prose(7780, 3000), "en", "s", 0), (906, prose(7781, 30), "en", "s", 0), (906, prose(7781, 30), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(0, 800) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, planted).cache()
        kept[name] = docs
        if name != "pack":
            assert docs.columns == before.columns
    ids = lambda name: [r["doc_id"] for r in kept[name].collect()]
    toxic = {i for i in range(800) if i % 4 == 1}
    left = set(ids("toxicity"))
    assert len(toxic & left) <= 0.05 * len(toxic)
    clean = {i for i in range(800) if i % 4 != 1} | {901, 902, 903, 904, 905, 906}
    assert len(clean - left) <= 0.03 * len(clean)
    once = ids("near_dedup")
    assert 2 in once and 900 not in once and 901 not in once and once.count(906) == 1
    assert None in once and 904 in once
    assert set(ids("near_dedup")) - set(ids("decontaminate")) == {902}
    texts = {r["doc_id"]: r["text"] for r in kept["pii"].collect()}
    assert "<email>" in texts[903] and "<ip>" in texts[903] and "@" not in texts[903]
    assert sorted(map(str, texts)) == sorted(map(str, set(ids("decontaminate"))))
    packed = kept["pack"].collect()
    assert sorted({str(r["doc_id"]) for r in packed}) == sorted(map(str, texts))
    total = {}
    for r in packed:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 4096
    assert len(packed) == corpus_pipeline.run(spark, planted).count()


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
