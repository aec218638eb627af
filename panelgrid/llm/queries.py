"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelgrid.llm.job import crc32

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    from panelgrid.llm.wavelet import read_documents, shard_starts, write_shards

    shards = write_shards(table(spark, folder, "documents"))
    read = read_documents(shards).select(
        "part", "shard", "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        crc32(F.col("ids")).alias("ids_crc32"),
    )
    return read.join(shard_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


@query
def op2_best_fit_packing(spark, folder):
    from panelgrid.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"))


@query
def op3_kd_shards(spark, folder):
    from panelgrid.llm.kdshard import kd_shards

    return kd_shards(table(spark, folder, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_subword_toxicity(spark, folder):
    from panelgrid.llm.toxicity import fit, fold, with_score

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels"))
    return with_score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op5_winnowed_contamination(spark, folder):
    from panelgrid.llm.decontaminate import contamination

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_pii_spans(spark, folder):
    from panelgrid.llm.pii import BASE, joined, with_spans

    found = with_spans(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"),
    )


@query
def op7_gru_scores(spark, folder):
    from panelgrid.llm.gru_lm import score_documents

    return score_documents(table(spark, folder, "documents"))


@query
def op8_minhash_components(spark, folder):
    from panelgrid.llm.neardup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), percent=85)


@query
def op9_va_file_top_k(spark, folder):
    from panelgrid.llm.vafile import integer_vectors, top_k

    vectors = integer_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    found = top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)
    return found.select("query_id", "rank", "vec_id", "score")


@query
def op10_bwt_repeats(spark, folder):
    from panelgrid.llm.substrings import remove_repeats

    found = remove_repeats(table(spark, folder, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL["op9_va_file_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SQL["op8_minhash_components"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w
), n AS (
  SELECT doc_id, count(g) AS n FROM s GROUP BY doc_id
), sets AS (
  SELECT min(doc_id) AS id, n, k FROM (
    SELECT doc_id, count(*) AS n, sum(CAST(hash(g) AS HUGEINT)) AS k FROM s GROUP BY doc_id) GROUP BY n, k
), member AS (
  SELECT d.doc_id, t.id FROM (SELECT doc_id, count(*) AS n, sum(CAST(hash(g) AS HUGEINT)) AS k FROM s GROUP BY doc_id) d
  JOIN sets t ON d.n = t.n AND d.k = t.k
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT id FROM sets) AND b.doc_id IN (SELECT id FROM sets) GROUP BY 1, 2
), link AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), pair AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT id AS x, id AS y FROM sets UNION SELECT r.x, e.b FROM reach r JOIN pair e ON r.y = e.a
), comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id,
       d.doc_id = coalesce(comp.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN member m ON m.doc_id = d.doc_id
LEFT JOIN comp ON comp.x = m.id
"""


@query
def op12_pivot_part_codes(spark, folder):
    from panelgrid.llm.partcodes import compress

    return compress(table(spark, folder, "embeddings"))


def _part_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of assignment and update over all (part, entry) pairs."""
    steps = [f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, part, v[part * w + 1 : part * w + w] AS x
  FROM (SELECT r, v, len(v) // {parts} AS w, unnest(range({parts})) AS part FROM v)
), b0 AS (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= {entries})"""]
    near = """
, a{i} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, [d, entry]) AS entry, min(d) AS d FROM (
    SELECT p.r, p.part, b.entry, CAST(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN b{i} b ON p.part = b.part) GROUP BY r, part
)"""
    for i in range(rounds):
        steps.append(near.format(i=i))
        steps.append(f"""
, m{i} AS (
  SELECT part, entry, list(m ORDER BY k) AS e FROM (
    SELECT part, entry, k, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (
      SELECT a.part, a.entry, unnest(range(len(p.x))) AS k, unnest(p.x) AS c FROM a{i} a JOIN p ON a.r = p.r AND a.part = p.part)
    GROUP BY part, entry, k) GROUP BY part, entry
), b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry
)""")
    steps.append(near.format(i=rounds))
    steps.append(f"""
, h AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
), c AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r
)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN v ON c.r = v.r, h""")
    return "".join(steps)


SQL["op12_pivot_part_codes"] = _part_codes_sql()


@query
def op11_hybrid_ranked_search(spark, folder):
    from panelgrid.llm.ranked import ranked_search

    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op11_hybrid_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT row_number() OVER () AS q, item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), p AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY r, term
), t AS (
  SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, s.n
), v AS (
  SELECT p.r, p.term, t.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * len(d.w) * s.n) // s.l))) AS x
  FROM p JOIN t ON p.term = t.term JOIN d ON p.r = d.r, s
), scored AS (
  SELECT i.q, i.item_id, v.r, CAST(sum(v.x) AS BIGINT) AS score FROM i JOIN v ON i.term = v.term GROUP BY i.q, i.item_id, v.r
), ranked AS (
  SELECT q, item_id, d.doc_id, score,
         CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, d.doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored JOIN d ON scored.r = d.r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op13_debruijn_repeats(spark, folder):
    from panelgrid.llm.debruijn import remove_repeated_windows

    found = remove_repeated_windows(table(spark, folder, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", size.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL["op13_debruijn_repeats"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT r, doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h, md5(array_to_string(w[i:i + 49], ' ')) AS m
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), least AS (
  SELECT h, m, min(doc_id) AS first_id FROM windows GROUP BY h, m
), hit AS (
  SELECT r, i FROM windows JOIN least ON windows.h = least.h AND windows.m = least.m
  WHERE first_id < doc_id OR (doc_id IS NULL AND first_id IS NOT NULL)
), word AS (
  SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d
), marked AS (
  SELECT word.r, word.i, word.word,
         max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.r ORDER BY word.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN hit ON word.r = hit.r AND word.i = hit.i
), kept AS (
  SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY r
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""
