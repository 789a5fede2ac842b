"""Queries over question analysis, context building, mapping, upserts and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as Q
from ..operators import context as C
from ..operators import search, upserts
from .registry import query
from .text_queries import BM25, QUESTIONS

ASKED = f"x AS ({QUESTIONS}), n AS (SELECT query_id, trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) AS t FROM x)"
NOTE = f"ab AS (SELECT query_id, t, {Q.ability_sql('t')} AS ability, {Q.need_sql('t')} AS need, {Q.signals_sql('t')} AS signals FROM n)"


def questions(m):
    prefixes = m.spark.createDataFrame(list(enumerate(Q.SAMPLE_PREFIXES)), "k int, p string")
    asked = m.queries.join(F.broadcast(prefixes)).select((100 * F.col("query_id") + F.col("k")).alias("query_id"), F.concat("p", F.lit(" "), "query_text").alias("query_text"))
    return asked.select("query_id", T.normalize(F.col("query_text")).alias("t"))


def noted(m):
    t = F.col("t")
    return questions(m).select("query_id", "t", Q.ability(t).alias("ability"), Q.evidence_need(t).alias("need"), Q.signals(t).alias("signals"))


@query(f"WITH {ASKED}, {NOTE} SELECT query_id, ability, need, signals FROM ab", ("queries",))
def query_signals(m):
    return noted(m).select("query_id", "ability", "need", F.array_join("signals", ",").alias("signals"))


@query(
    f"""WITH {ASKED}, {NOTE}, o AS (SELECT *, NOT {Q.DELETING.sql('t')} AS open FROM ab)
SELECT query_id, open AND ability IN ('boundary', 'supportive', 'premise_check') AS pinned_core,
  open AND ability IN ('causal_explain', 'historical', 'provenance', 'planning', 'premise_check', 'gotcha', 'workflow') AS recent_important,
  open AND ((ability IN ('relationship_arc', 'dynamic_state') AND need IN ('state_transition', 'relationship_timeline')) OR ability IN ('causal_explain', 'supportive', 'provenance', 'planning', 'premise_check')) AS narrative_insight FROM o""",
    ("queries",))
def anchor_gates(m):
    gates = Q.anchor_gates(F.col("t"), F.col("ability"), F.col("need"))
    return noted(m).select("query_id", *[c.alias(k) for k, c in gates.items()])


@query(
    f"""WITH {ASKED}, {NOTE}, h AS (SELECT *, ',' || signals || ',' AS s, query_id % 7 = 0 AS superseding, query_id % 3 AS n_sources FROM ab),
d AS (SELECT *, ability = 'direct_fact' OR need = 'exact_observation' OR contains(s, ',exact_fact,') OR contains(s, ',past_event_direct_fact,') AS direct FROM h)
SELECT query_id, CASE WHEN ability IN ('supportive', 'boundary') OR contains(s, ',forget_delete,') THEN 'supportive_memory'
  WHEN need = 'provenance_source' OR contains(s, ',provenance') THEN 'provenance_memory'
  WHEN superseding OR (NOT direct AND (need = 'state_transition' OR contains(s, ',state_transition,'))) THEN 'historical_transition_memory'
  WHEN contains(s, ',causal') THEN 'relevant_causal_memory' WHEN need = 'premise_counterexample' OR contains(s, ',premise_counterexample,') THEN 'premise_check_memory'
  WHEN need = 'relationship_timeline' OR contains(s, ',relationship_arc,') THEN 'relationship_arc_memory' WHEN ability IN ('gotcha', 'workflow') THEN 'experience_context'
  WHEN NOT direct AND n_sources > 0 THEN 'provenance_memory' ELSE 'facts' END AS block FROM d""", ("queries",))
def context_blocks(m):
    return noted(m).select("query_id", C.block_type(F.col("ability"), F.col("need"), F.col("signals"), F.col("query_id") % 7 == 0, F.col("query_id") % 3).alias("block"))


TERM = r"list_filter(list_distinct(list_filter(regexp_split_to_array(lower(query_text), '\s+'), lambda x: x <> '')), lambda x: length(x) >= 2 AND x NOT IN ('the', 'and', 'or', 'who', 'what', 'when', 'where', 'why', 'how') AND regexp_full_match(x, '[\p{L}\p{N}]+'))"


@query(
    f"""WITH {BM25}, t AS (SELECT query_id, {TERM} AS ts FROM queries), j AS (SELECT query_id, node_id, ts, lower(search_text) AS low, node_id % 2 = 0 AS protects FROM bm JOIN t USING (query_id) JOIN search_documents USING (node_id) WHERE rank_position <= 20),
c AS (SELECT query_id, node_id, protects, CASE WHEN len(ts) = 0 THEN 0.0 ELSE len(list_filter(ts, lambda x: contains(low, x))) / CAST(len(ts) AS DOUBLE) END AS cov FROM j)
SELECT query_id, node_id, round(cov, 6) AS coverage, round(CASE WHEN protects THEN 0.16 * cov ELSE 0.0 END, 8) AS boost, CAST(CASE WHEN protects AND cov < 0.5 AND node_id % 3 = 0 THEN 0.45 ELSE 0.0 END AS DOUBLE) AS hub FROM c""",
    ("search_documents", "queries"))
def slot_coverage(m):
    ranked = search.bm25(m.search_documents, m.queries, 20)
    terms = m.queries.select("query_id", C.slot_terms(F.col("query_text")).alias("terms"))
    docs = m.search_documents.select("node_id", F.lower("search_text").alias("low"))
    rows = ranked.join(terms, "query_id").join(docs, "node_id").select("query_id", "node_id", C.slot_coverage(F.col("terms"), F.col("low")).alias("cov"), (F.col("node_id") % 2 == 0).alias("protects"))
    kind = F.when(F.col("node_id") % 3 == 0, "core_identity").otherwise("task_state")
    hub = C.hub_penalty(F.col("protects"), F.lit(False), F.lit(False), F.col("cov"), F.lit(0.0), kind, F.lit(""), F.lit(False))
    return rows.select("query_id", "node_id", F.round("cov", 6).alias("coverage"), F.round(C.slot_boost(F.col("protects"), F.col("cov")), 8).alias("boost"), hub.alias("hub"))


def _list_sql(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    f"""WITH {ASKED} SELECT query_id, CASE WHEN {Q.words(*C.NEGATIONS).sql('t')} THEN array_to_string(list_sort(list_distinct({_list_sql(C.POSITIVE_MARKERS)}
  {' '.join(f"|| CASE WHEN {Q.words(*triggers).sql('t')} THEN {_list_sql(more)} ELSE [] END" for triggers, more in C.CONCEPT_GROUPS)})), ',') ELSE '' END AS expansions FROM n""",
    ("queries",))
def premise_expansions(m):
    return questions(m).select("query_id", F.array_join(F.array_sort(C.premise_expansions(F.col("t"))), ",").alias("expansions"))


GENERATED = """g AS (SELECT query_id, 'rewrite' AS kind, v.place, CASE v.place WHEN 1 THEN query_text WHEN 2 THEN 'Memory' WHEN 3 THEN concat('topic ', query_id) WHEN 4 THEN concat('Topic  ', query_id) WHEN 5 THEN '' ELSE concat('more ', query_id, ' of ', v.place) END AS text,
  CAST(v.place AS DOUBLE) / 4 AS weight, CASE WHEN v.place = 7 THEN 'operation_target' ELSE 'semantic_recall' END AS purpose, query_text AS raw_text, query_id % 10 = 3 AS forgets FROM {queries}, (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS v(place)
  UNION ALL SELECT query_id, 'anchor', v.place, CASE v.place WHEN 1 THEN concat('topic ', query_id) ELSE concat('anchor ', query_id, ' ', v.place) END, CAST(v.place AS DOUBLE) / 4, 'semantic_anchor', query_text, query_id % 10 = 3 FROM {queries}, (VALUES (1), (2), (3), (4)) AS v(place))"""


@query(
    f"""WITH {GENERATED.replace('{queries}', 'queries')}, a AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS nt, trim(regexp_replace(lower(raw_text), '\\s+', ' ', 'g')) AS nr FROM g),
b AS (SELECT *, CASE WHEN nt = '' THEN 'empty' WHEN nt = nr THEN 'similar' WHEN forgets AND (kind = 'anchor' OR purpose <> 'operation_target') THEN 'forget_delete' WHEN nt IN ('memory', 'memories', 'context') THEN 'generic' END AS r FROM a),
c AS (SELECT *, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY query_id, nt, r IS NULL ORDER BY CASE kind WHEN 'rewrite' THEN 0 ELSE 1 END, place) > 1 THEN 'duplicate' END) AS r2 FROM b),
d AS (SELECT *, coalesce(r2, CASE WHEN row_number() OVER (PARTITION BY query_id, kind, r2 IS NULL ORDER BY place) > CASE kind WHEN 'rewrite' THEN 3 ELSE 2 END THEN 'fanout_limit' END, 'accepted') AS reason FROM c)
SELECT query_id, kind, place, reason, round(least(greatest(weight, 0.1), CASE kind WHEN 'rewrite' THEN 0.9 ELSE 0.65 END), 6) AS weight FROM d""", ("queries",))
def dense_query_plan(m):
    generated = m.spark.sql(f"WITH {GENERATED} SELECT * FROM g", queries=m.queries)
    return C.dense_plan(generated)


@query(
    """WITH c AS (SELECT DISTINCT from_id AS fact_id, to_id AS episode_id FROM links WHERE link_type = 'EVIDENCED_BY' AND visibility_status = 'visible' AND searchable),
r AS (SELECT fact_id, episode_id, row_number() OVER (PARTITION BY fact_id ORDER BY at_s, episode_id) AS r, count(*) OVER (PARTITION BY fact_id) AS n FROM c JOIN episodes USING (episode_id) WHERE visibility_status = 'visible' AND searchable)
SELECT fact_id, string_agg(CAST(episode_id AS VARCHAR), ',' ORDER BY r) AS refs, max(n) AS n_sources FROM r WHERE r <= 2 GROUP BY 1""", ("links", "episodes"))
def source_refs(m):
    return C.source_refs(m.links, m.episodes)


@query(
    """WITH t AS (SELECT * FROM links WHERE link_type IN ('CAUSED_BY', 'SUPPORTS', 'EXPLAINS') AND to_type = 'fact' AND visibility_status = 'visible' AND searchable),
b AS (SELECT from_id AS fact_id, to_id AS related_id, weight, link_id, 'out' AS way FROM t UNION ALL SELECT to_id, from_id, weight, link_id, 'in' FROM t)
SELECT fact_id, related_id, way, rank_position FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY abs(weight) DESC, link_id, way, related_id) AS rank_position FROM b WHERE fact_id <> related_id) WHERE rank_position <= 2""", ("links",))
def related_facts(m):
    return C.related_facts(m.links, ["CAUSED_BY", "SUPPORTS", "EXPLAINS"])


FLOOR = "SELECT user_id AS query_id, event_id AS fact_id, CASE event_type WHEN 'view' THEN 'raw_dense' WHEN 'click' THEN 'raw_query' WHEN 'purchase' THEN 'raw_exact' ELSE 'other' END AS source, value AS score, user_id % 2 = 0 AS exact_need FROM {events}"


@query(
    f"""WITH c AS ({FLOOR.replace('{events}', 'events')}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC NULLS LAST, fact_id) AS r FROM c WHERE source <> 'other'),
d AS (SELECT query_id, count(*) AS have FROM r WHERE source = 'raw_dense' AND r <= 4 GROUP BY 1)
SELECT DISTINCT query_id, fact_id FROM r LEFT JOIN d USING (query_id) WHERE (source = 'raw_dense' AND r <= 4) OR (source = 'raw_query' AND r <= 4 - coalesce(have, 0)) OR (source = 'raw_exact' AND exact_need AND r <= 2)""")
def raw_floor(m):
    return C.raw_floor(m.spark.sql(FLOOR, events=m.events))


MAPPED = "SELECT event_id AS node_key, CASE WHEN event_id % 6 = 5 THEN 'entity' ELSE 'fact' END AS node_type, event_id % 1500 AS node_id, CASE event_id % 9 WHEN 0 THEN 'stale' WHEN 1 THEN 'deleted' ELSE 'indexed' END AS index_status FROM {events} WHERE event_type <> 'error'"


@query(
    f"""WITH i AS ({MAPPED.replace('{events}', 'events')}), c AS (SELECT event_id AS node_key, CASE WHEN event_id % 12 = 0 THEN 0.0 ELSE value END AS score FROM events)
SELECT node_key, CASE WHEN score IS NULL OR score <= 0 THEN 'invalid_candidate' WHEN index_status IS NULL THEN 'unmapped_node' WHEN index_status <> 'indexed' THEN 'stale_mapping_status_' || index_status
  WHEN node_type <> 'fact' THEN 'non_fact_candidate' WHEN NOT coalesce(f.visibility_status = 'visible', false) THEN 'dropped_by_authority_filter' ELSE 'kept' END AS drop_reason
FROM c LEFT JOIN i USING (node_key) LEFT JOIN facts f ON f.fact_id = i.node_id""", ("facts",))
def candidate_mapping(m):
    candidates = m.events.select(F.col("event_id").alias("node_key"), F.when(F.col("event_id") % 12 == 0, 0.0).otherwise(F.col("value")).alias("score"))
    return C.map_candidates(candidates, m.spark.sql(MAPPED, events=m.events), m.facts)


ALIASES = "SELECT concat('customer ', CAST(c_custkey % 100 AS VARCHAR(20))) AS alias, c_custkey AS entity_id, CAST(c_custkey % 13 AS DOUBLE) / 13 AS confidence, c_custkey AS created FROM {customer}"


@query(f"WITH a AS ({ALIASES.replace('{customer}', 'customer')}) SELECT alias, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY confidence DESC, created DESC) AS k FROM a) WHERE k = 1")
def alias_resolution(m):
    return upserts.resolve_aliases(m.spark.sql(ALIASES.replace("VARCHAR(20)", "STRING"), customer=m.customer))


@query(
    f"""WITH a AS ({ALIASES.replace('{customer}', 'customer')}), w AS (SELECT DISTINCT alias AS name FROM a UNION SELECT c_name FROM customer)
SELECT name, entity_id FROM (SELECT name, c_custkey AS entity_id FROM w JOIN customer ON name = c_name UNION SELECT name, entity_id FROM w JOIN a ON name = alias)""")
def name_or_alias_match(m):
    aliases = m.spark.sql(ALIASES.replace("VARCHAR(20)", "STRING"), customer=m.customer)
    entities = m.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("entity_id"))
    wanted = aliases.select(F.col("alias").alias("name")).union(entities.select("name")).distinct()
    return upserts.names_or_aliases(wanted, entities, aliases)


@query(
    f"""WITH a AS ({ALIASES.replace('{customer}', 'customer')}) SELECT entity_id, concat_ws(' ', max(c_name), string_agg(alias, ' ' ORDER BY alias)) AS search_text FROM a JOIN customer ON c_custkey = entity_id GROUP BY 1""")
def entity_search_text(m):
    aliases = m.spark.sql(ALIASES.replace("VARCHAR(20)", "STRING"), customer=m.customer)
    names = m.customer.select(F.col("c_custkey").alias("entity_id"), "c_name")
    joined = F.array_join(F.sort_array(F.collect_list("alias")), " ")
    return aliases.join(names, "entity_id").groupBy("entity_id").agg(F.concat_ws(" ", F.max("c_name"), joined).alias("search_text"))


@query(
    """WITH new AS (SELECT c_custkey + 5 AS entity_id, concat('new ', c_name) AS canonical_name FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT entity_id, canonical_name FROM (SELECT c_custkey AS entity_id, c_name AS canonical_name FROM customer) UNION ALL SELECT entity_id, canonical_name FROM new WHERE entity_id NOT IN (SELECT c_custkey FROM customer)""")
def entity_ensure(m):
    have = m.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"))
    fresh = m.customer.filter("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 5).alias("entity_id"), F.concat(F.lit("new "), "c_name").alias("canonical_name"))
    return upserts.ensure(have, fresh, ["entity_id"])


@query(
    """WITH n AS (SELECT o_orderkey AS fact_id, o_custkey AS to_id FROM orders), have AS (SELECT DISTINCT from_id, to_id FROM links WHERE link_type = 'ABOUT_ENTITY')
SELECT from_id, to_id, 'old' AS origin FROM have UNION ALL SELECT DISTINCT fact_id, to_id, 'new' FROM n WHERE (fact_id, to_id) NOT IN (SELECT (from_id, to_id) FROM have)""", ("links",))
def link_dedup(m):
    have = m.links.filter("link_type = 'ABOUT_ENTITY'").select("from_id", "to_id").distinct().withColumn("origin", F.lit("old"))
    fresh = m.facts.select(F.col("fact_id").alias("from_id"), F.col("subject_entity_id").alias("to_id")).distinct().withColumn("origin", F.lit("new"))
    return upserts.ensure(have, fresh, ["from_id", "to_id"])


@query(
    """SELECT fact_id, CASE WHEN visibility_status = 'visible' AND searchable THEN 'upsert_node' ELSE 'delete_node' END AS operation,
  CAST(('0x' || substr(sha256('fact' || chr(0) || fact_id), 1, 15)) AS BIGINT) AS node_key FROM facts""", ("facts",))
def mirror_operations(m):
    live = (F.col("visibility_status") == "visible") & F.col("searchable")
    return m.facts.select("fact_id", F.when(live, "upsert_node").otherwise("delete_node").alias("operation"), upserts.node_key(F.lit("fact"), F.col("fact_id")).alias("node_key"))


@query(
    """SELECT event_id, '{"session":' || session_id || ',"node":' || node_id || ',"type":"' || access_type || '"}' AS breakdown FROM access_events""", ("access_events",))
def access_log(m):
    record = F.struct(F.col("session_id").alias("session"), F.col("node_id").alias("node"), F.col("access_type").alias("type"))
    return m.access_events.select("event_id", F.to_json(record).alias("breakdown"))


@query(
    """WITH refs AS (SELECT DISTINCT sha256(text) AS cache_key FROM conversations WHERE role = 'user'), c AS (SELECT DISTINCT sha256(text) AS cache_key FROM conversations)
SELECT cache_key, cache_key IN (SELECT cache_key FROM refs) AS kept FROM c""")
def embedding_cache_gc(m):
    cache = m.conversations.select(F.sha2("text", 256).alias("cache_key")).distinct()
    refs = m.conversations.filter("role = 'user'").select(F.sha2("text", 256).alias("cache_key"))
    return upserts.mark_orphans(cache, refs)


@query(
    """WITH e AS (SELECT session_id, episode_id, role, at_s FROM episodes WHERE visibility_status = 'visible' AND searchable AND role <> 'system'),
f AS (SELECT session_id, sha256(string_agg(episode_id || ':' || role, ',' ORDER BY at_s, episode_id)) AS fp FROM e GROUP BY 1)
SELECT session_id FROM f WHERE fp NOT IN (SELECT fp FROM f WHERE session_id % 2 = 0)""", ("episodes",))
def extraction_idempotency(m):
    from ..operators import gates

    requests = gates.build_requests(m.episodes)
    runs = requests.filter("session_id % 2 = 0").select("fingerprint", F.lit("success").alias("status"))
    return gates.unseen(requests, runs).select("session_id")


@query(
    """WITH w AS (SELECT node_id AS k, event_id, least(greatest(retrieval_score / 100, 0.1), 0.9) AS w FROM access_events),
r AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM w)
SELECT k, count(*) AS n, round(sum(CASE WHEN 3.0 - prev < 0.1 THEN 0.0 ELSE least(w, 3.0 - prev) END), 6) AS spent FROM r GROUP BY 1""", ("access_events",))
def rewrite_budget(m):
    rows = m.access_events.select(F.col("node_id").alias("k"), "event_id", (F.col("retrieval_score") / 100).alias("w"))
    lists = rows.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "w"))), lambda x: x["w"]).alias("ws"))
    spent = F.aggregate(Q.spend_weights(F.col("ws")), F.lit(0.0), lambda s, x: s + x)
    return lists.select("k", F.size("ws").cast("bigint").alias("n"), F.round(spent, 6).alias("spent"))
