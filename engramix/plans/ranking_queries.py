"""Queries over anchors, fusion, graph, scoring, selection and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import analysis, fusion, graph, metrics, scoring, search
from .authority_queries import AUTHORIZED, FACT_TABLES, NOW, authorized
from .registry import query
from .selection_sql import mmr_sql
from .text_queries import BM25

SEEDS = "seeds AS (SELECT fact_id FROM facts WHERE pinned AND fact_type = 'core_identity')"
OPEN = "visibility_status = 'visible' AND searchable"
MULT = "CASE link_type WHEN 'CAUSED_BY' THEN 1.0 WHEN 'SUPERSEDES' THEN 0.9 WHEN 'SUPPORTS' THEN 0.85 WHEN 'EXPLAINS' THEN 0.85 WHEN 'ABOUT_ENTITY' THEN 0.8 WHEN 'EVIDENCED_BY' THEN 0.0 ELSE 0.5 END"
ADJACENCY = f"""ends AS (SELECT 'fact:' || from_id AS a, to_type || ':' || to_id AS b, direction, link_type, weight FROM links),
adj AS (SELECT a AS source, b AS target, link_type, weight FROM ends WHERE direction IN ('forward', 'bidirectional')
  UNION ALL SELECT b, a, link_type, weight FROM ends WHERE direction IN ('backward', 'bidirectional')),
deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ends UNION ALL SELECT b FROM ends) GROUP BY 1)"""


def seeds(m):
    return m.facts.filter("pinned AND fact_type = 'core_identity'").select("fact_id")


@query(
    "SELECT fact_id, rank_position FROM (SELECT fact_id, row_number() OVER (ORDER BY importance DESC, created_at DESC, fact_id) AS rank_position FROM facts "
    f"WHERE pinned AND fact_type = 'core_identity' AND {OPEN} AND validity_status <> 'invalidated') WHERE rank_position <= 30", ("facts",))
def pinned_core_topk(m):
    rows = m.facts.filter(f"pinned AND fact_type = 'core_identity' AND {OPEN} AND validity_status <> 'invalidated'")
    top = rows.orderBy(F.desc("importance"), F.desc("created_at"), "fact_id").limit(30)
    return search.top_k(top, 30, [F.desc("importance"), F.desc("created_at"), F.asc("fact_id")], []).select("fact_id", "rank_position")


@query(
    f"""SELECT persona_id, fact_id, rank_position FROM (SELECT persona_id, fact_id, row_number() OVER (PARTITION BY persona_id ORDER BY created_at DESC, importance DESC, fact_id) AS rank_position
FROM facts WHERE importance >= 0.7 AND {OPEN}) WHERE rank_position <= 30""", ("facts",))
def recent_important_topk(m):
    rows = m.facts.filter(f"importance >= 0.7 AND {OPEN}")
    return search.top_k(rows, 30, [F.desc("created_at"), F.desc("importance"), F.asc("fact_id")], "persona_id").select("persona_id", "fact_id", "rank_position")


@query(
    f"""SELECT subject_entity_id, fact_id, rank_position FROM (SELECT e.entity_id AS subject_entity_id, fact_id,
  row_number() OVER (PARTITION BY e.entity_id ORDER BY importance DESC, created_at DESC, fact_id) AS rank_position
  FROM facts f JOIN entities e ON e.entity_id = f.subject_entity_id OR e.entity_id = f.object_entity_id) WHERE rank_position <= 5""", ("facts", "entities"))
def entity_facts_topk(m):
    sides = m.facts.select("fact_id", "importance", "created_at", F.explode(F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))).alias("entity_id"))
    rows = sides.join(m.entities.select("entity_id"), "entity_id", "left_semi")
    return search.top_k(rows, 5, [F.desc("importance"), F.desc("created_at"), F.asc("fact_id")], "entity_id").select(F.col("entity_id").alias("subject_entity_id"), "fact_id", "rank_position")


ANCHORS = f"""{BM25}, hits AS (SELECT query_id, 'fts' AS source, 'insight' AS node_type, node_id, rank_position FROM bm WHERE rank_position <= 60
  UNION ALL SELECT query_id, 'recent_important', 'fact', node_id, row_number() OVER (PARTITION BY query_id ORDER BY updated_s DESC, node_id)
    FROM (SELECT query_id, d.node_id, d.updated_s FROM bm JOIN search_documents d USING (node_id) WHERE rank_position <= 60)
  UNION ALL SELECT query_id, 'pinned_core', 'insight', node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id) FROM bm JOIN search_documents d USING (node_id) WHERE rank_position <= 60 AND lifecycle_status = 'active')"""
RRF = f"""{ANCHORS}, fused AS (SELECT query_id, node_type, node_id,
  sum(CASE source WHEN 'pinned_core' THEN 1.8 WHEN 'recent_important' THEN 1.2 ELSE 1.0 END / (60 + rank_position)) AS score, count(*) AS n_sources
  FROM hits WHERE rank_position <= 40 GROUP BY 1, 2, 3),
scaled AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) * CASE node_type WHEN 'insight' THEN 1.1 ELSE 1.0 END AS seed_energy FROM fused),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_type, node_id) AS rank_position FROM scaled)"""


def anchors(m):
    ranked = search.bm25(m.search_documents, m.queries, 60)
    fts = ranked.select("query_id", F.lit("fts").alias("source"), F.lit("insight").alias("node_type"), "node_id", "rank_position")
    dated = ranked.select("query_id", "node_id").join(m.search_documents.select("node_id", "updated_s", "lifecycle_status"), "node_id")
    recent = search.top_k(dated, 60, [F.desc("updated_s"), F.asc("node_id")], "query_id").select("query_id", F.lit("recent_important").alias("source"), F.lit("fact").alias("node_type"), "node_id", "rank_position")
    pinned = search.top_k(dated.filter("lifecycle_status = 'active'"), 60, [F.asc("node_id")], "query_id").select(
        "query_id", F.lit("pinned_core").alias("source"), F.lit("insight").alias("node_type"), "node_id", "rank_position")
    return fts.unionByName(recent).unionByName(pinned)


@query(
    f"""WITH {RRF} SELECT query_id, node_type, node_id, round(score, 6) AS score, round(seed_energy, 6) AS seed_energy, n_sources, rank_position FROM placed WHERE rank_position <= 80""",
    ("search_documents", "queries"))
def rrf_fusion(m):
    return fusion.fuse_anchors(anchors(m))


COS = "round(list_dot_product(e.embedding::DOUBLE[], q.q::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.q::DOUBLE[], q.q::DOUBLE[]))), 6)"
DENSE = f"""q AS (SELECT vec_id // 50 AS query_id, CASE vec_id % 50 WHEN 0 THEN 'raw' WHEN 1 THEN 'rewrite' ELSE 'anchor' END AS variant,
  CASE vec_id % 50 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.5 END AS weight, embedding AS q FROM embeddings WHERE vec_id % 50 < 3),
sc AS (SELECT query_id, variant, weight, e.vec_id, {COS} AS score FROM q, embeddings e),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, vec_id) AS rank_position FROM sc WHERE score > 0),
hits AS (SELECT * FROM rk WHERE rank_position <= 32)"""


def dense_hits(m):
    """Queries: every vector whose id is divisible by 50, with the next two as its rewrite and anchor."""
    k = F.col("vec_id") % 50
    weight = F.when(k == 0, 1.0).when(k == 1, 0.7).otherwise(0.5)
    variant = F.when(k == 0, "raw").when(k == 1, "rewrite").otherwise("anchor")
    asked = m.embeddings.filter(k < 3).select(F.floor(F.col("vec_id") / 50).alias("query_id"), variant.alias("variant"), weight.alias("weight"), F.col("embedding").alias("q"))
    return fusion.dense_top_k(asked, m.embeddings, 32)


@query(f"WITH {DENSE} SELECT query_id, variant, vec_id, score, rank_position FROM hits")
def dense_topk(m):
    return dense_hits(m).select("query_id", "variant", "vec_id", "score", "rank_position")


@query(
    f"""WITH {DENSE}, g AS (SELECT query_id, vec_id, max(least(1.0, greatest(0.0, score)) * weight) AS p, count(*) AS hits, sum(weight / (60 + rank_position)) AS rrf FROM hits GROUP BY 1, 2),
w AS (SELECT query_id, sum(weight) AS aw FROM (SELECT DISTINCT query_id, variant, weight FROM hits) GROUP BY 1)
SELECT query_id, vec_id, hits, round(p, 9) AS primary_score,
  round(least(1.0, p + CASE WHEN hits > 1 THEN least(0.12, 0.18 * least(1.0, rrf / (aw / 61)) * (1 - p)) ELSE 0.0 END), 9) AS fused_score FROM g JOIN w USING (query_id)""")
def dense_weighted_max_fusion(m):
    return fusion.fuse_dense(dense_hits(m))


@query(f"WITH {ADJACENCY} SELECT node, degree FROM deg", ("links",))
def node_degree(m):
    return graph.degrees(m.links)


@query(
    f"""WITH {ADJACENCY}, {SEEDS}, sh AS (SELECT source, target, 0.7 * greatest(weight, 0.0) * {MULT} / power(greatest(degree, 1), 0.5) AS share FROM adj JOIN deg ON node = target WHERE greatest(weight, 0.0) * {MULT} > 0),
s0 AS (SELECT fact_id % 5 AS query_id, 'fact:' || fact_id AS node, CASE fact_id % 4 WHEN 0 THEN 0.004 WHEN 1 THEN 0.4 ELSE 1.0 END AS energy FROM seeds UNION ALL SELECT fact_id % 5, 'fact:' || fact_id, 0.3 FROM seeds WHERE fact_id % 4 <> 0),
s AS (SELECT query_id, node, max(energy) AS energy FROM s0 GROUP BY 1, 2),
h1 AS (SELECT query_id, target AS node, energy * share AS energy FROM s JOIN sh ON source = node WHERE energy * share >= 0.01),
f1 AS (SELECT query_id, node, max(energy) AS e FROM h1 GROUP BY 1, 2),
h2 AS (SELECT query_id, target AS node, e * share AS energy FROM f1 JOIN sh ON source = node WHERE e * share >= 0.01),
t AS (SELECT query_id, node, round(least(1.0, sum(energy)), 6) AS energy FROM (SELECT * FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2 HAVING sum(energy) >= 0.01)
SELECT * FROM (SELECT query_id, node, energy, row_number() OVER (PARTITION BY query_id ORDER BY energy DESC, node) AS rank_position FROM t) WHERE rank_position <= 80""",
    ("facts", "links"))
def graph_activation_2hop(m):
    """Repeated and tiny seeds among them."""
    k = F.col("fact_id") % 4
    start = seeds(m).select(
        (F.col("fact_id") % 5).alias("query_id"), graph.node_key("fact", "fact_id").alias("node"), F.when(k == 0, 0.004).when(k == 1, 0.4).otherwise(1.0).alias("energy"), k.alias("k"))
    start = start.drop("k").unionAll(start.filter("k <> 0").select("query_id", "node", F.lit(0.3).alias("energy")))
    return graph.activate(start, m.links)


CITED = f"cited AS (SELECT DISTINCT from_id AS fact_id, to_id AS episode_id FROM links WHERE link_type = 'EVIDENCED_BY' AND {OPEN} AND to_id IN (SELECT episode_id FROM episodes WHERE {OPEN}))"


@query(
    f"WITH {SEEDS}, {CITED} SELECT DISTINCT a.fact_id AS seed_id, b.fact_id FROM cited a JOIN cited b USING (episode_id) WHERE a.fact_id IN (SELECT fact_id FROM seeds) AND a.fact_id <> b.fact_id",
    ("facts", "links", "episodes"))
def shared_episode_facts(m):
    return graph.shared_evidence(m.links, m.episodes, seeds(m))


@query(
    f"""WITH {SEEDS}, {CITED}, p AS (SELECT DISTINCT fact_id, session_id, at_s FROM cited JOIN episodes USING (episode_id))
SELECT DISTINCT a.fact_id AS seed_id, b.fact_id FROM p a JOIN p b ON a.session_id = b.session_id AND abs(a.at_s - b.at_s) <= 7200 WHERE a.fact_id IN (SELECT fact_id FROM seeds) AND a.fact_id <> b.fact_id""",
    ("facts", "links", "episodes"))
def session_window_facts(m):
    return graph.session_window(m.links, m.episodes, seeds(m))


@query(
    f"""WITH {SEEDS}, a AS (SELECT DISTINCT from_id AS fact_id, to_id AS entity_id FROM links WHERE link_type = 'ABOUT_ENTITY' AND {OPEN}
  AND to_id IN (SELECT entity_id FROM entities WHERE {OPEN} AND sensitivity_level = 'normal'))
SELECT DISTINCT x.fact_id AS seed_id, y.fact_id FROM a x JOIN a y USING (entity_id) WHERE x.fact_id IN (SELECT fact_id FROM seeds) AND x.fact_id <> y.fact_id""", ("facts", "links", "entities"))
def shared_entity_facts(m):
    return graph.shared_entities(m.links, m.entities, seeds(m))


@query(
    f"""WITH {SEEDS}, t AS (SELECT from_id AS a, to_id AS b, link_type FROM links WHERE {OPEN} AND link_type IN ('CAUSED_BY', 'EXPLAINS', 'TRIGGERED_BY') AND to_type = 'fact')
SELECT DISTINCT seed_id, fact_id, link_type FROM (SELECT a AS seed_id, b AS fact_id, link_type FROM t UNION ALL SELECT b, a, link_type FROM t)
WHERE seed_id IN (SELECT fact_id FROM seeds) AND seed_id <> fact_id""", ("facts", "links"))
def causal_completions(m):
    return graph.linked_facts(m.links, seeds(m), ["CAUSED_BY", "EXPLAINS", "TRIGGERED_BY"])


@query(
    f"""WITH s AS (SELECT DISTINCT to_id AS fact_id FROM links WHERE link_type = 'SUPERSEDES' AND to_type = 'fact' AND {OPEN})
SELECT f.fact_id, CASE WHEN s.fact_id IS NOT NULL THEN 'superseded' WHEN validity_status = 'invalidated' OR lifecycle_status IN ('archived', 'deep_archived') OR valid_to IS NOT NULL THEN 'historical' ELSE 'current' END AS status
FROM facts f LEFT JOIN s USING (fact_id)""", ("facts", "links"))
def supersedes_status(m):
    inbound = graph.open_links(m.links).filter("link_type = 'SUPERSEDES' AND to_type = 'fact'").select(F.col("to_id").alias("fact_id"), F.lit(True).alias("hit")).distinct()
    past = (F.col("validity_status") == "invalidated") | F.col("lifecycle_status").isin("archived", "deep_archived") | F.col("valid_to").isNotNull()
    return m.facts.join(inbound, "fact_id", "left").select("fact_id", F.when(F.col("hit"), "superseded").when(past, "historical").otherwise("current").alias("status"))


FATIGUE = "fat AS (SELECT session_id, node_id, count(*) AS n FROM access_events WHERE access_type = 'retrieved' GROUP BY 1, 2)"


@query(f"WITH {FATIGUE} SELECT session_id, node_id, n FROM fat", ("access_events",))
def fatigue_counts(m):
    return m.access_events.filter("access_type = 'retrieved'").groupBy("session_id", "node_id").agg(F.count(F.lit(1)).alias("n"))


SCORES = f"""{AUTHORIZED}, fat AS (SELECT node_id AS fact_id, count(*) AS fatigue FROM access_events WHERE access_type = 'retrieved' AND session_id = 7 GROUP BY 1),
sc AS (SELECT fact_id, persona_id, content_summary, predicate, validity_status, lifecycle_status, subject_entity_id, object_entity_id,
  round((0.55 * CAST(fact_id % 89 AS DOUBLE) / 88 + 0.25 * CAST(fact_id % 31 AS DOUBLE) / 30 + 0.20 * importance
    + 0.10 * (CASE WHEN date_diff('second', created_at, TIMESTAMP '{NOW}') <= 0 THEN 1.0 ELSE 1 / (1 + date_diff('second', created_at, TIMESTAMP '{NOW}') / 86400.0 / 30) END)
    + 0.10 * (CASE fact_type WHEN 'core_identity' THEN 1.0 WHEN 'stable_preference' THEN 0.8 WHEN 'relational_state' THEN 0.8 WHEN 'commitment' THEN 0.7 ELSE 0.5 END)
    + 0.10 * (0.45 * (CASE WHEN confidence > 0 THEN confidence ELSE 0.5 END) + 0.25 * least(1.0, ln(1 + n_allowed) / ln(4)) + 0.20 * (CASE WHEN n_allowed > 0 THEN 1.0 WHEN pinned THEN 0.5 ELSE 0.0 END) + 0.10 * least(1.0, ln(1 + reinforcement_count) / ln(4)))
    + (CASE WHEN pinned THEN 0.05 ELSE 0.0 END) + 0.12 * CAST(fact_id % 7 AS DOUBLE) / 6 - (CASE WHEN coalesce(fatigue, 0) > 0 THEN 0.6 ELSE 0.0 END))
    * (CASE lifecycle_status WHEN 'consolidated' THEN 0.92 WHEN 'dormant' THEN 0.82 ELSE 1.0 END), 6) AS score
  FROM auth LEFT JOIN fat USING (fact_id))"""


def scored(m):
    fatigue = m.access_events.filter("access_type = 'retrieved' AND session_id = 7").groupBy(F.col("node_id").alias("fact_id")).agg(F.count(F.lit(1)).alias("fatigue_count"))
    part = lambda k: (F.col("fact_id") % k).cast("double") / (k - 1)
    rows = authorized(m).join(fatigue, "fact_id", "left").fillna(0, ["fatigue_count"]).withColumns(
        {
            "anchor": part(89), "graph": part(31), "lexical": part(7), **{c: F.lit(0.0) for c in ("slot_boost", "reflection", "completion", "hub_penalty", "premise_penalty")},
            "evidence_strength": S.evidence_strength(F.col("confidence"), F.col("n_allowed"), F.col("pinned"), F.col("reinforcement_count")),
        }
    )
    return rows.withColumn("score", F.round(scoring.final_score(F.lit(NOW).cast("timestamp_ntz")), 6))


@query(f"WITH {SCORES} SELECT fact_id, score FROM sc WHERE score >= 0.2", (*FACT_TABLES, "access_events"))
def final_score(m):
    return scored(m).filter(F.col("score") >= scoring.LEAST_SCORE).select("fact_id", "score")


@query(
    f"""WITH {SCORES}, r AS (SELECT fact_id, persona_id, score + CASE WHEN fact_id % 2 = 0 THEN 0.08 * CAST(fact_id % 10 AS DOUBLE) / 10 * (CASE lifecycle_status WHEN 'consolidated' THEN 0.92 WHEN 'dormant' THEN 0.82 ELSE 1.0 END) ELSE 0.0 END AS s FROM sc)
SELECT persona_id, fact_id, round(s, 6) AS score, rank_position FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY round(s, 6) DESC, fact_id) AS rank_position FROM r) WHERE rank_position <= 30""",
    (*FACT_TABLES, "access_events"))
def rerank_topk(m):
    boosted = scoring.rerank_boost(F.col("score"), (F.col("fact_id") % 10).cast("double") / 10, F.col("lifecycle_status"), F.col("fact_id") % 2 == 0)
    rows = scored(m).select("persona_id", "fact_id", F.round(boosted, 6).alias("score"))
    return search.top_k(rows, 30, [F.desc("score"), F.asc("fact_id")], "persona_id")


@query(f"WITH RECURSIVE {SCORES}, {mmr_sql('SELECT persona_id AS query_id, * FROM sc')} SELECT query_id, fact_id, rank_position FROM picked", (*FACT_TABLES, "access_events"))
def mmr_select(m):
    """Greedy selection for every persona among its eighty best facts."""
    best = search.top_k(scored(m), 80, [F.desc("score"), F.asc("fact_id")], "persona_id")
    cites = graph.open_links(m.links).filter("link_type = 'EVIDENCED_BY'").groupBy(F.col("from_id").alias("fact_id")).agg(F.sort_array(F.collect_set("to_id")).alias("episode_ids"))
    rows = best.join(cites, "fact_id", "left").select(
        F.col("persona_id").alias("query_id"),
        F.struct(
            "score", "fact_id", S.estimate_tokens(F.col("content_summary")).alias("tokens"), T.summary_terms(F.col("content_summary")).alias("terms"),
            F.array_compact(F.array("subject_entity_id", "object_entity_id")).alias("entity_ids"), "predicate",
            F.coalesce("episode_ids", F.array().cast("array<bigint>")).alias("episode_ids"), F.col("validity_status").alias("validity"), F.col("lifecycle_status").alias("lifecycle"),
        ).alias("c"),
    )
    return scoring.select_mmr(rows)


@query(
    f"""WITH {RRF}, top AS (SELECT query_id, node_id, rank_position FROM placed WHERE node_type = 'insight'),
tk AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY rank_position) AS rank_position FROM top),
gold AS (SELECT DISTINCT query_id, node_id FROM bm JOIN labels ON doc_id = node_id WHERE bm.rank_position <= 30 AND quality = 1),
hit AS (SELECT tk.*, g.node_id IS NOT NULL AS hit FROM tk LEFT JOIN gold g USING (query_id, node_id) WHERE tk.rank_position <= 8),
per AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE hit) AS found, min(rank_position) FILTER (WHERE hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank_position + 1) ELSE 0 END) AS dcg FROM hit GROUP BY 1),
gs AS (SELECT query_id, count(*) AS gold, list_sum(list_transform(range(1, least(count(*), 8) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM gold GROUP BY 1),
j AS (SELECT query_id, coalesce(n, 0) AS n, coalesce(found, 0) AS found, first, coalesce(dcg, 0) AS dcg, coalesce(gold, 0) AS gold, ideal FROM per FULL JOIN gs USING (query_id))
SELECT query_id, round(CASE WHEN gold = 0 THEN 1.0 ELSE found / CAST(gold AS DOUBLE) END, 6) AS recall_at_k, round(CASE WHEN n = 0 THEN 0.0 ELSE found / CAST(n AS DOUBLE) END, 6) AS precision_at_k,
  round(coalesce(1.0 / first, 0.0), 6) AS reciprocal_rank, round(CASE WHEN gold = 0 THEN 1.0 ELSE dcg / ideal END, 6) AS ndcg_at_k FROM j""",
    ("search_documents", "queries"))
def retrieval_quality(m):
    ranked = fusion.fuse_anchors(anchors(m)).filter("node_type = 'insight'").select("query_id", "node_id", F.col("rank_position").alias("r"))
    ranked = search.top_k(ranked, 8, [F.asc("r")], "query_id")
    gold = search.bm25(m.search_documents, m.queries, 30).join(m.labels.filter("quality = 1").select(F.col("doc_id").alias("node_id")), "node_id", "left_semi")
    return metrics.ranked_quality(ranked, gold, 8)


@query(
    """WITH v AS (SELECT access_type, CAST(round(retrieval_score * 100) AS BIGINT) AS ms FROM access_events WHERE retrieval_score IS NOT NULL),
r AS (SELECT access_type, ms, row_number() OVER (PARTITION BY access_type ORDER BY ms) AS i, count(*) OVER (PARTITION BY access_type) AS n FROM v)
SELECT access_type, min(ms) FILTER (WHERE i = greatest(CAST(ceil(n * 50 / 100.0) AS BIGINT), 1)) AS p50, min(ms) FILTER (WHERE i = greatest(CAST(ceil(n * 95 / 100.0) AS BIGINT), 1)) AS p95 FROM r GROUP BY 1""",
    ("access_events",))
def nearest_rank_percentile(m):
    rows = m.access_events.select("access_type", F.round(F.col("retrieval_score") * 100).cast("bigint").alias("ms"))
    return metrics.nearest_rank(rows, "access_type", "ms", [50, 95])


@query(
    """WITH a AS (SELECT access_type AS profile, round(avg(retrieval_score), 4) AS s, count(*) AS n FROM access_events GROUP BY 1),
x AS (SELECT 'score' AS name, profile, s AS value FROM a UNION ALL SELECT 'count', profile, CAST(n AS DOUBLE) FROM a)
SELECT x.name, x.profile, round(x.value - b.value, 6) AS delta FROM x JOIN x b ON b.name = x.name AND b.profile = 'retrieved' WHERE x.profile <> 'retrieved'""", ("access_events",))
def profile_deltas(m):
    per = m.access_events.groupBy(F.col("access_type").alias("profile")).agg(F.round(F.avg("retrieval_score"), 4).alias("score"), F.count(F.lit(1)).cast("double").alias("count"))
    long = per.unpivot("profile", ["score", "count"], "name", "value")
    return metrics.deltas(long, "profile", "value", "retrieved")


@query(
    """WITH s AS (SELECT session_id, count(*) AS n, count(DISTINCT access_type) AS kinds, count(*) FILTER (WHERE access_type = 'filtered') AS dropped, max(retrieval_score) AS hi, min(retrieval_score) AS lo FROM access_events GROUP BY 1),
r AS (SELECT session_id, least(1.0, n / 80.0) AS anchor_coverage, kinds / 5.0 AS source_diversity, least(1.0, greatest(0.0, (hi - lo) / (hi + 1))) AS top_rank_margin, (n - dropped) / CAST(n AS DOUBLE) AS authority_pass_ratio, dropped,
  CASE WHEN session_id % 17 = 0 THEN 0.0 ELSE 1.0 END AS temporal_consistency, CASE WHEN session_id % 3 = 0 THEN 0.4 ELSE 1.0 END AS required_chain_coverage, CASE WHEN session_id % 5 = 0 THEN 0.6 ELSE 1.0 END AS mmr_diversity, 1.0 AS sensitivity_safety FROM s)
SELECT session_id, round(least(1.0, greatest(0.0, 0.18 * anchor_coverage + 0.15 * source_diversity + 0.14 * top_rank_margin + 0.14 * authority_pass_ratio + 0.12 * temporal_consistency + 0.12 * required_chain_coverage + 0.08 * mmr_diversity + 0.07 * sensitivity_safety)), 6) AS overall,
  CASE WHEN temporal_consistency <= 0 THEN 'suppress_memory_injection' WHEN authority_pass_ratio < 0.7 AND dropped > 0 THEN 'sqlite_fallback' WHEN anchor_coverage < 0.4 THEN 'semantic_light'
    WHEN required_chain_coverage < 0.5 AND session_id % 2 = 0 THEN 'semantic_light' WHEN source_diversity < 0.5 THEN 'semantic_light' WHEN mmr_diversity < 0.7 THEN 'semantic_light' ELSE 'none' END AS corrective_action FROM r""",
    ("access_events",))
def observed_confidence(m):
    kind = F.col("access_type")
    per = m.access_events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(kind).alias("kinds"), F.count_if(kind == "filtered").alias("authority_dropped"), F.max("retrieval_score").alias("hi"), F.min("retrieval_score").alias("lo"))
    key = F.col("session_id")
    rows = per.withColumns(
        {
            "anchor_coverage": F.least(F.lit(1.0), F.col("n") / 80.0), "source_diversity": F.col("kinds") / 5.0, "top_rank_margin": S.clamp01((F.col("hi") - F.col("lo")) / (F.col("hi") + 1)),
            "authority_pass_ratio": metrics.ratio(F.col("n") - F.col("authority_dropped"), F.col("n"), 0.0), "temporal_consistency": F.when(key % 17 == 0, 0.0).otherwise(1.0),
            "required_chain_coverage": F.when(key % 3 == 0, 0.4).otherwise(1.0), "mmr_diversity": F.when(key % 5 == 0, 0.6).otherwise(1.0), "sensitivity_safety": F.lit(1.0),
            "semantic_allowed": F.lit(True), "chain_required": key % 2 == 0,
        }
    )
    return rows.select("session_id", F.round(scoring.observed_confidence(), 6).alias("overall"), scoring.corrective_action().alias("corrective_action"))


@query(
    """WITH s AS (SELECT fact_id, 1 - (1 - importance) * (1 - confidence) * (1 - CAST(fact_id % 3 AS DOUBLE) / 10) AS base FROM facts),
r AS (SELECT fact_id, least(1.0, greatest(0.0, base * (CASE WHEN fact_id % 10 > 6 THEN 0.75 ELSE 1.0 END) * (CASE WHEN fact_id % 20 = 1 THEN 0.85 ELSE 1.0 END))) AS readiness, CAST(fact_id % 10 AS DOUBLE) / 10 AS fit, CAST(fact_id % 9 AS DOUBLE) / 9 AS complexity FROM s),
n AS (SELECT *, least(1.0, greatest(0.0, 0.35 * (1 - fit) + 0.25 * (1 - readiness) + 0.25 * complexity + 0.15 * 0.2)) AS need FROM r)
SELECT fact_id, round(readiness, 9) AS readiness, round(need, 9) AS semantic_need, CASE WHEN NOT (round(need, 9) >= 0.58 OR fit < 0.66 OR (readiness < 0.45 AND complexity >= 0.5)) THEN 'rule' WHEN complexity >= 0.8 THEN 'semantic_decompose' WHEN complexity >= 0.72 THEN 'semantic_full' ELSE 'semantic_light' END AS route FROM n""",
    ("facts",))
def anchor_readiness(m):
    k = F.col("fact_id")
    probes = F.array("importance", "confidence", (k % 3).cast("double") / 10)
    ready = analysis.anchor_readiness(probes, F.when(k % 10 > 6, 0.7).otherwise(0.0), F.when(k % 20 == 1, 0.05).otherwise(0.5), F.lit(6))
    rows = m.facts.select("fact_id", ready.alias("readiness"), ((k % 10).cast("double") / 10).alias("fit"), ((k % 9).cast("double") / 9).alias("complexity"))
    need = analysis.semantic_need(F.col("fit"), F.col("readiness"), F.col("complexity"), F.lit(0.2), F.lit(False))
    rows = rows.withColumn("need", need)
    routed = analysis.route(F.round("need", 9), F.col("fit"), F.col("readiness"), F.col("complexity"), F.lit(0.0))
    return rows.select("fact_id", F.round("readiness", 9).alias("readiness"), F.round("need", 9).alias("semantic_need"), routed.alias("route"))


@query(
    f"""WITH {RRF}, docs AS (SELECT * FROM search_documents WHERE {OPEN} AND sensitivity_level = 'normal' AND lifecycle_status NOT IN ('archived', 'deep_archived')),
c AS (SELECT query_id, node_id, round((0.55 * max(round(seed_energy, 6)) + 0.12 * count(*) / 2.0 + 0.10 * (1 / (1 + (1000000 - max(updated_s)) / 86400.0 / 30))) * max(CASE lifecycle_status WHEN 'consolidated' THEN 0.92 WHEN 'dormant' THEN 0.82 ELSE 1.0 END), 9) AS score
  FROM placed JOIN docs USING (node_id) WHERE rank_position <= 80 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank_position FROM c WHERE score >= 0.2)
SELECT query_id, node_id, score, rank_position FROM r WHERE rank_position <= 8""", ("search_documents", "queries"))
def retrieval_pipeline(m):
    """The flagship: search and anchors, fusion, authority, score, the best eight of each query."""
    fused = fusion.fuse_anchors(anchors(m))
    docs = m.search_documents.filter(f"{OPEN} AND sensitivity_level = 'normal' AND lifecycle_status NOT IN ('archived', 'deep_archived')").select("node_id", "lifecycle_status", "updated_s")
    rows = fused.join(docs, "node_id").groupBy("query_id", "node_id").agg(
        F.max("seed_energy").alias("e"), F.count(F.lit(1)).alias("n"), F.max("updated_s").alias("u"), F.max(S.lifecycle_multiplier(F.col("lifecycle_status"))).alias("life"))
    fresh = 1 / (1 + (1_000_000 - F.col("u")) / 86400.0 / 30)
    scores = rows.select("query_id", "node_id", F.round((0.55 * F.col("e") + 0.12 * F.col("n") / 2.0 + 0.10 * fresh) * F.col("life"), 9).alias("score"))
    return search.top_k(scores.filter(F.col("score") >= scoring.LEAST_SCORE), 8, [F.desc("score"), F.asc("node_id")], "query_id")


