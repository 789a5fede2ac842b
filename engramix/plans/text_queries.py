"""Queries over text: scalars, search, mentions, query classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import analysis, postings, search
from ..operators.authority import visible_at
from ..sources.scratch import scratch_path
from .registry import query

TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
FIELDS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"
BM25 = f"""q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query_text')}) AS term FROM queries),
d AS (SELECT node_id, {TOKENS.format('search_text')} AS ts FROM search_documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM d),
p AS (SELECT term, node_id, dl, count(*) AS tf FROM (SELECT node_id, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
  FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY 1, 2),
bm AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_s DESC NULLS LAST, node_id) AS rank_position FROM s JOIN (SELECT node_id, updated_s FROM search_documents) USING (node_id))"""


@query(f"WITH {BM25} SELECT query_id, node_id, score, rank_position FROM bm WHERE rank_position <= 20", ("search_documents", "queries"))
def bm25_topk(m):
    return search.bm25(m.search_documents, m.queries, 20)


CHANGED = """changed AS (SELECT node_id, CASE lifecycle_status WHEN 'dormant' THEN concat(substr(search_text, 1, 120), ' revised') ELSE search_text END AS search_text FROM search_documents WHERE visibility_status <> 'hidden'
  UNION ALL SELECT node_id + 1000000000, search_text FROM search_documents WHERE lifecycle_status = 'consolidated')"""


@query(
    f"""WITH {CHANGED}, {BM25.replace('FROM search_documents)', 'FROM changed)', 1).split('bm AS')[0].rstrip().rstrip(',')}
SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank_position FROM s QUALIFY rank_position <= 20""", ("search_documents", "queries"))
def incremental_search(m):
    """Ranked search over an index that got its changes as segments: texts revised, copies added, hidden documents deleted."""
    docs = m.search_documents
    index = postings.build(docs.select("node_id", "search_text"), scratch_path(m.spark))
    revised = docs.filter("lifecycle_status = 'dormant'").select("node_id", F.concat(F.substring("search_text", 1, 120), F.lit(" revised")).alias("search_text"))
    index = index.upsert(revised)
    index = index.upsert(docs.filter("lifecycle_status = 'consolidated'").select((F.col("node_id") + 1_000_000_000).alias("node_id"), "search_text"))
    index = index.delete(docs.filter("visibility_status = 'hidden'").select("node_id"))
    return index.bm25(m.queries, 20)


@query(
    f"""WITH q AS (SELECT query_id, lower(query_text) AS q, list_distinct({FIELDS.format('query_text')}) AS ts FROM queries),
s AS (SELECT query_id, node_id, updated_s, (CASE WHEN contains(lower(search_text), q) THEN len(ts) + 1 ELSE 0 END) + len(list_filter(ts, lambda t: contains(lower(search_text), t))) AS score
  FROM search_documents, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_s DESC NULLS LAST, node_id) AS rank_position FROM s WHERE score > 0)
SELECT query_id, node_id, CAST(score AS BIGINT) AS score, rank_position FROM r WHERE rank_position <= 10""",
    ("search_documents", "queries"))
def containment_topk(m):
    return search.containment(m.search_documents, m.queries, 10)


FRAGMENTS = "SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN substr(regexp_extract(lower(text), '[a-z]{7,}'), 2, 5) ELSE text END AS query_text FROM benchmark"


@query(
    f"""WITH fq AS ({FRAGMENTS}), {BM25.replace('FROM queries', 'FROM fq')},
top AS (SELECT query_id, node_id, score, rank_position FROM bm WHERE rank_position <= 5),
cq AS (SELECT query_id, lower(query_text) AS q, list_distinct({FIELDS.format('query_text')}) AS ts FROM fq WHERE query_id NOT IN (SELECT query_id FROM top)),
cs AS (SELECT query_id, node_id, updated_s, (CASE WHEN contains(lower(search_text), q) THEN len(ts) + 1 ELSE 0 END) + len(list_filter(ts, lambda t: contains(lower(search_text), t))) AS score FROM search_documents, cq WHERE len(ts) > 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_s DESC NULLS LAST, node_id) AS rank_position FROM cs WHERE score > 0)
SELECT * FROM top UNION ALL SELECT query_id, node_id, CAST(score AS DOUBLE), rank_position FROM cr WHERE rank_position <= 5""",
    ("search_documents",))
def search_with_fallback(m):
    """Ranked search; queries whose words no document holds (a third are pieces of words) are searched by containment."""
    piece = F.substring(F.regexp_extract(F.lower("text"), "[a-z]{7,}", 0), 2, 5)
    asked = m.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, piece).otherwise(F.col("text")).alias("query_text"))
    ranked = search.bm25(m.search_documents, asked, 5)
    rest = asked.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    held = search.containment(m.search_documents, rest, 5).withColumn("score", F.col("score").cast("double"))
    return ranked.unionByName(held)


@query(
    r"""SELECT episode_id, CAST(CASE WHEN length(content) = 0 THEN 1 ELSE length(content) // 2 + 8 END AS BIGINT) AS tokens FROM episodes""", ("episodes",))
def token_estimate(m):
    return m.episodes.select("episode_id", S.estimate_tokens(F.col("content")).alias("tokens"))


@query(
    r"""SELECT episode_id, sha256(content) AS content_hash, trim(regexp_replace(lower(content), '\s+', ' ', 'g')) AS normalized,
  len(list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> ''))) AS n_fields FROM episodes""", ("episodes",))
def text_normalization(m):
    c = F.col("content")
    return m.episodes.select("episode_id", F.sha2(c, 256).alias("content_hash"), T.normalize(c).alias("normalized"), F.size(T.fields(c)).cast("bigint").alias("n_fields"))


@query(
    f"""WITH q AS (SELECT query_id, trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) AS q, list_distinct({FIELDS.format('query_text')}) AS ts FROM queries),
d AS (SELECT node_id, lower(search_text) AS t FROM search_documents)
SELECT query_id, node_id, round(CASE WHEN contains(t, q) THEN 1.0 ELSE len(list_filter(ts, lambda x: contains(t, x))) / CAST(len(ts) AS DOUBLE) END, 6) AS score FROM q, d
WHERE contains(t, q) OR len(list_filter(ts, lambda x: contains(t, x))) * 2 > len(ts)""",
    ("search_documents", "queries"))
def text_match_score(m):
    """All queries, in blocks, against all documents. A text that holds the whole query holds all of its terms, so the terms decide."""
    asked = m.queries.select("query_id", T.normalize(F.col("query_text")).alias("q"), T.query_terms(F.col("query_text")).alias("terms"))
    found = search.term_counts(m.search_documents, asked, None)
    if found is None:
        return m.spark.createDataFrame([], "query_id bigint, node_id bigint, score double")
    return found.select("query_id", "node_id", F.round(F.col("n") / F.col("size"), 6).alias("score"))


@query(
    """WITH p AS (SELECT fact_id, lower(f.content_summary) AS c, f.content_summary, e.canonical_name AS e, f.predicate FROM facts f LEFT JOIN entities e
  ON e.entity_id = f.object_entity_id AND e.visibility_status = 'visible' AND e.searchable)
SELECT fact_id, concat_ws(' ', content_summary, e, CASE WHEN contains(concat_ws(' ', c, lower(e)), predicate) THEN NULL ELSE predicate END) AS search_text,
  CASE WHEN e IS NULL THEN 0 ELSE 1 END AS has_object FROM p""", ("facts", "entities"))
def search_document_build(m):
    ok = m.entities.filter("visibility_status = 'visible' AND searchable").select(F.col("entity_id").alias("object_entity_id"), "canonical_name")
    rows = m.facts.join(ok, "object_entity_id", "left")
    return rows.select("fact_id", T.join_unique(F.array("content_summary", "canonical_name", "predicate")).alias("search_text"), F.when(F.col("canonical_name").isNull(), 0).otherwise(1).alias("has_object"))


MENTIONING = "SELECT query_id, concat(query_text, ' in ', n_name, ', says Customer#', lpad(CAST(query_id + 1 AS VARCHAR), 9, '0'), ' and client number ', query_id + 2, ', or the far land of ', n_name) AS t FROM queries JOIN nation ON n_nationkey = query_id % 25"


@query(
    rf"""WITH q AS (SELECT query_id, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') AS t FROM ({MENTIONING})),
e AS (SELECT entity_id, canonical_name FROM entities WHERE visibility_status = 'visible' AND searchable AND sensitivity_level = 'normal'),
nm AS (SELECT entity_id, canonical_name AS name FROM e UNION ALL SELECT entity_id, alias FROM entity_aliases JOIN e USING (entity_id)),
n AS (SELECT DISTINCT entity_id, trim(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS k FROM nm)
SELECT query_id, entity_id, k AS matched_text FROM q, n WHERE k <> '' AND contains(' ' || t || ' ', ' ' || k || ' ')""", ("queries", "entities", "entity_aliases"))
def entity_mentions(m):
    """Names and aliases of all eligible entities."""
    place = m.nation.select(F.col("n_nationkey").cast("bigint").alias("nk"), "n_name")
    k = F.col("query_id")
    text = F.concat(
        "query_text", F.lit(" in "), "n_name", F.lit(", says Customer#"), F.lpad((k + 1).cast("string"), 9, "0"), F.lit(" and client number "), (k + 2).cast("string"), F.lit(", or the far land of "), "n_name")
    asked = m.queries.join(place, k % 25 == F.col("nk")).select("query_id", text.alias("query_text"))
    return search.entity_mentions(asked, m.entities.filter(visible_at(0)), m.entity_aliases)


QUESTIONS = "SELECT 100 * q.query_id + k AS query_id, concat(p, ' ', q.query_text) AS query_text FROM queries q, (VALUES {0}) AS v(k, p)".format(
    ", ".join(f"({i}, '{p}')" for i, p in enumerate(analysis.SAMPLE_PREFIXES)))


@query(
    f"""WITH x AS ({QUESTIONS}), n AS (SELECT query_id, trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) AS t FROM x)
SELECT query_id, {analysis.time_mode_sql('t')} AS time_mode, {analysis.domain_sql('t')} AS domain, {analysis.need_sql('t')} AS evidence_need FROM n""", ("queries",))
def query_classifier(m):
    prefixes = m.spark.createDataFrame(list(enumerate(analysis.SAMPLE_PREFIXES)), "k int, p string")
    asked = m.queries.join(F.broadcast(prefixes)).select((100 * F.col("query_id") + F.col("k")).alias("query_id"), F.concat("p", F.lit(" "), "query_text").alias("query_text"))
    t = T.normalize(F.col("query_text"))
    return asked.select("query_id", analysis.time_mode(t).alias("time_mode"), analysis.domain(t).alias("domain"), analysis.evidence_need(t).alias("evidence_need"))
