"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, folds, language_id, lexical_search, near_dup, pii, quality_model, quality_rules, secrets, sentencepiece_scan, toxicity, url_filter, vector_search
from .common import read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


ORACLE_SQL["op2_url_filter"] = """
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
  ('net/es/', 'block'), ('net/fr/', 'block')),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM rules),
p AS (SELECT page_id, url, row_number() OVER () AS rid,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    base = quality_rules.fails("base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~quality_rules.fails("v1")).alias("kept"),
    )


ORACLE_SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
  FROM w LEFT JOIN cov ON cov.rid = w.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 3 * n_words
    OR word_chars > 12 * n_words OR (n_words >= 10 AND 2 * n_upper > word_chars) OR 2 * n_marks > n_words) AS kept
FROM f
"""


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE_KINDS],
        F.sha2(pii.spans_string(base), 256).alias("base_sha256"), pii.spans_string(F.col("spans")).alias("spans"),
    )


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.phrase_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL["op9_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({LOWERED}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({LOWERED}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
h AS (SELECT rid, n, i, item_id FROM dw JOIN iw USING (n, g)),
w AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (rid) LEFT JOIN t USING (rid)
"""


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in secrets.BASE_KINDS],
        F.sha2(secrets.spans_string(F.col("base")), 256).alias("base_sha256"), secrets.spans_string(F.col("spans")).alias("spans"),
    )


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


ORACLE_SQL["op7_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c.k >= 80 * (nx.k + ny.k - c.k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x)
SELECT w.doc_id, coalesce(n.k, 0) AS n_shingles, min(m) AS component_id, w.doc_id = min(m) AS kept FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.k
"""


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(folds.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    encoded = sentencepiece_scan.encode(docs, decoded_col="decoded")
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("bigint").alias("n_pieces"),
        sentencepiece_scan.ids_digest(F.col("piece_ids")).alias("ids_hash"),
        (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"),
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(folds.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held_out), "toxic")
    return toxicity.score_texts(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence"
    )


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(folds.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_model.fit(docs, labels.filter(~held_out), "quality")
    return quality_model.score_texts(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)
    named = F.broadcast(found.centroid_rows().drop("centroid"))
    return found.rows.join(named, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _centroid_sql(rounds: int) -> str:
    """Round by round; vectors are numbered, components lie in rows."""
    parts = [
        """WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS (SELECT rid, vec_id, list_transform(v, lambda x: CAST(x AS BIGINT)) AS v FROM e),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c FROM kept QUALIFY cluster < 40)"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""d{n} AS MATERIALIZED (SELECT rid, vec_id, v, cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS distance FROM kept, c{n}),
a{n} AS MATERIALIZED (SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"""
        )
        if n < rounds:
            parts.append(
                f"""s{n} AS (SELECT cluster, i, sum(x) AS s, count(*) AS k FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY 1, 2),
m{n} AS (SELECT cluster, list(CAST((CAST(s AS BIGINT) - (((CAST(s AS BIGINT) % k) + k) % k)) // k AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY 1),
c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"""
            )
    return (
        ",\n".join(parts)
        + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
    )


ORACLE_SQL["op11_centroids"] = _centroid_sql(5)


@query
def op13_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vector_search.build_index(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return vector_search.top_k(index, k=10).withColumnRenamed("id", "vec_id")


ORACLE_SQL["op13_vector_topk"] = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(read_table(spark, sf_dir, "documents"))
    found = lexical_search.search(index, read_table(spark, sf_dir, "benchmark"), k=10)
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


ORACLE_SQL["op12_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS t FROM benchmark),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(ts)) AS BIGINT) AS l_all FROM d WHERE len(ts) > 0),
p AS (SELECT rid, doc_id, t, CAST(n AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(w * q * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM (SELECT iid, item_id, t, count(*) AS q FROM i GROUP BY ALL) JOIN p USING (t) JOIN w USING (t), g GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 10
"""
