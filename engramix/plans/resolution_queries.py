"""Queries over caches, entity candidates, analysers' answers, and the chains of activation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, graph, resolution, validation
from ..sources.scratch import stored
from .ranking_queries import ADJACENCY, MULT, SEEDS, seeds
from .registry import query


@query(
    f"""WITH {ADJACENCY}, {SEEDS}, sh AS (SELECT source, target, link_type, 0.7 * greatest(weight, 0.0) * {MULT} / power(greatest(degree, 1), 0.5) AS share FROM adj JOIN deg ON node = target WHERE greatest(weight, 0.0) * {MULT} > 0),
k0 AS (SELECT DISTINCT fact_id % 5 AS query_id, 'fact:' || fact_id AS node, 0 AS hop, 'fact:' || fact_id AS nodes, '' AS link_types FROM seeds),
m1 AS (SELECT query_id, source, target AS node, link_type, share AS energy, nodes FROM k0 JOIN sh ON source = node WHERE share >= 0.01),
b1 AS (SELECT * FROM m1 WHERE (query_id, node) NOT IN (SELECT (query_id, node) FROM k0) QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY round(energy, 9) DESC, source, link_type) = 1),
k1 AS (SELECT query_id, node, 1 AS hop, nodes || '>' || node AS nodes, link_type AS link_types FROM b1),
f1 AS (SELECT query_id, node, max(energy) AS e FROM m1 GROUP BY 1, 2), kk AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1),
m2 AS (SELECT f1.query_id, source, target AS node, sh.link_type, e * share AS energy FROM f1 JOIN sh ON source = f1.node WHERE e * share >= 0.01),
b2 AS (SELECT * FROM m2 WHERE (query_id, node) NOT IN (SELECT (query_id, node) FROM kk) QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY round(energy, 9) DESC, source, link_type) = 1),
k2 AS (SELECT b2.query_id, b2.node, 2 AS hop, kk.nodes || '>' || b2.node AS nodes, concat_ws(',', nullif(kk.link_types, ''), b2.link_type) AS link_types FROM b2 JOIN kk ON kk.query_id = b2.query_id AND kk.node = b2.source)
SELECT query_id, node, hop, nodes, link_types FROM (SELECT * FROM kk UNION ALL SELECT * FROM k2)""", ("facts", "links"))
def activation_path_chains(m):
    """The chain of nodes and links by which energy first reaches each node, over two hops."""
    start = seeds(m).select((F.col("fact_id") % 5).alias("query_id"), graph.node_key("fact", "fact_id").alias("node"), F.lit(1.0).alias("energy"))
    found = graph.activation_chains(start, m.links)
    return found.select("query_id", "node", "hop", F.array_join("nodes", ">").alias("nodes"), F.array_join("link_types", ",").alias("link_types"))


REQUESTS = """rq AS (SELECT event_id AS request_id, ts AS asked_at, event_type AS mode, CAST(user_id % 7 AS BIGINT) AS persona_id, query_text, event_type <> 'error' AND event_id % 9 <> 4 AS ok
  FROM {events} JOIN {queries} ON query_id = user_id % 40)"""
CACHED = """ca AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS version, event_type AS mode, CAST(user_id % 7 AS BIGINT) AS persona_id, query_text
  FROM {events} JOIN {queries} ON query_id = user_id % 40 WHERE event_type IN ('click', 'view') AND user_id % 5 < 2)"""


@query(
    f"""WITH {REQUESTS.format(events='events', queries='queries')}, {CACHED.format(events='events', queries='queries')},
f AS (SELECT mode, persona_id, query_text, min((asked_at, request_id)) AS first FROM rq WHERE ok GROUP BY ALL),
j AS (SELECT rq.*, first, EXISTS (SELECT 1 FROM ca WHERE version = 'v2' AND ca.mode = rq.mode AND ca.persona_id = rq.persona_id AND ca.query_text = rq.query_text) AS held,
  EXISTS (SELECT 1 FROM ca WHERE ca.mode = rq.mode AND ca.persona_id = rq.persona_id AND ca.query_text = rq.query_text) AS other FROM rq LEFT JOIN f USING (mode, persona_id, query_text)),
o AS (SELECT *, CASE WHEN held OR coalesce((asked_at, request_id) > first, FALSE) THEN 'hit' WHEN ok THEN 'computed' ELSE 'fallback' END AS outcome FROM j)
SELECT request_id, sha256(concat_ws(chr(31), 'v2', mode, CAST(persona_id AS VARCHAR), query_text)) AS key, outcome,
  CASE WHEN outcome = 'hit' THEN CASE WHEN held THEN 'cached' ELSE 'same_batch' END WHEN other THEN 'stale' ELSE 'new' END AS reason FROM o""", ("queries",))
def semantic_cache_outcomes(m):
    """What a batch of analysis requests finds in the cache of the current version."""
    requests = m.spark.sql(f"WITH {REQUESTS} SELECT * FROM rq", events=m.events, queries=m.queries)
    held = m.spark.sql(f"WITH {CACHED} SELECT * FROM ca", events=m.events, queries=m.queries)
    parts = ("mode", "persona_id", "query_text")
    keyed = lambda df, version: df.withColumns({"key": cache.cache_key(version, *parts), "base_key": cache.cache_key("", *parts)})
    return cache.outcomes(keyed(requests, "v2"), keyed(held, F.col("version")))


CANDIDATES = """cn AS (SELECT o_orderkey AS request_id, o_custkey % 7 AS persona_id, o_custkey,
  CASE o_orderkey % 10 WHEN 0 THEN 'agent' WHEN 1 THEN CAST(o_custkey AS VARCHAR(20)) ELSE concat('cand_', CAST(o_orderkey AS VARCHAR(20))) END AS candidate_id,
  CASE o_orderkey % 4 WHEN 0 THEN concat(' Customer#', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), ' ') WHEN 1 THEN concat('client number ', CAST(o_custkey AS VARCHAR(20)))
    WHEN 2 THEN lower(o_orderpriority) ELSE concat('clerk of ', o_orderstatus) END AS canonical_name,
  CASE WHEN o_orderkey % 10 = 2 THEN o_custkey END AS known_entity_id, CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'maybe_existing' ELSE CASE WHEN o_orderkey % 11 = 0 THEN 'ambiguous' ELSE 'maybe_existing' END END AS merge_hint
FROM {orders})"""
TWINS = "SELECT entity_id, alias FROM {aliases} UNION ALL SELECT c_custkey, concat('client number ', CAST(c_custkey + 7 AS VARCHAR(20))) FROM {customer} WHERE c_custkey % 4 = 0"


@query(
    f"""WITH {CANDIDATES.format(orders='orders')}, al AS ({TWINS.format(aliases='entity_aliases', customer='customer')}),
op AS (SELECT entity_id, persona_id, canonical_name FROM entities WHERE visibility_status = 'visible' AND searchable),
nm AS (SELECT persona_id, name, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM (SELECT persona_id, canonical_name AS name, entity_id FROM op UNION ALL SELECT persona_id, alias, entity_id FROM al JOIN op USING (entity_id)) GROUP BY 1, 2),
j AS (SELECT cn.*, trim(cn.canonical_name) AS nam, candidate_id = CAST(o_custkey AS VARCHAR) AND o_custkey % 2 = 0 AS given, op.entity_id IS NOT NULL AS is_open, coalesce(n, 0) AS n, id
  FROM cn LEFT JOIN op ON op.entity_id = known_entity_id AND op.persona_id = cn.persona_id LEFT JOIN nm ON nm.persona_id = cn.persona_id AND nm.name = trim(cn.canonical_name)),
o AS (SELECT *, CASE WHEN candidate_id = 'agent' THEN 'refused' WHEN given THEN 'resolved' WHEN known_entity_id IS NOT NULL THEN CASE WHEN is_open THEN 'resolved' ELSE 'refused' END
  WHEN merge_hint = 'ambiguous' THEN 'ambiguous' WHEN merge_hint = 'maybe_existing' AND n = 1 THEN 'resolved' WHEN merge_hint = 'maybe_existing' AND n > 1 THEN 'ambiguous' ELSE 'created' END AS outcome FROM j)
SELECT request_id, candidate_id, outcome, CASE outcome WHEN 'created' THEN 'ent_' || substr(sha256(persona_id || ':' || nam), 1, 16)
  WHEN 'resolved' THEN CASE WHEN given THEN candidate_id ELSE CAST(coalesce(known_entity_id, id) AS VARCHAR) END END AS entity FROM o""", ("entities", "entity_aliases"))
def entity_resolution(m):
    """Extracted entity candidates against the persona's entities; some aliases belong to two of them."""
    found = m.spark.sql(f"WITH {CANDIDATES.replace('VARCHAR(20)', 'STRING')} SELECT * FROM cn", orders=m.orders)
    aliases = m.spark.sql(TWINS.replace("VARCHAR(20)", "STRING"), aliases=m.entity_aliases, customer=m.customer)
    known = found.filter("o_custkey % 2 = 0").select("request_id", F.col("o_custkey").alias("entity_id"))
    return resolution.resolve(found.drop("o_custkey"), known, m.entities, aliases)


#: Answers made from the log of events: a fact each, with the faults that the event's number gives it.
ANSWERS = """an AS (SELECT event_id, CAST(event_id AS VARCHAR(20)) AS request_id, CASE event_id % 17 WHEN 0 THEN 'v0' ELSE 'v1' END AS version, CASE event_id % 19 WHEN 0 THEN 'other' ELSE CAST(event_id AS VARCHAR(20)) END AS answered,
  CASE event_id % 6 WHEN 0 THEN 'lives_in' WHEN 1 THEN 'likes' WHEN 2 THEN 'promised_to' WHEN 3 THEN 'has_pet' WHEN 4 THEN 'made_up' ELSE 'works_at' END AS predicate,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('ent_', CAST(user_id AS VARCHAR(20))) END AS subject, CASE WHEN event_id % 4 < 2 THEN concat('ent_', CAST(user_id + 1 AS VARCHAR(20))) ELSE '' END AS object_entity,
  CASE WHEN event_id % 4 > 0 THEN event_type ELSE '' END AS object_literal, CAST(event_id % 13 AS DOUBLE) / 10 AS confidence, event_id % 7 AS episode, event_id % 3 AS n_cited,
  CASE event_id % 23 WHEN 0 THEN 'secret' ELSE 'normal' END AS sensitivity, event_id % 29 = 0 AS broken FROM {events})"""


@query(
    f"""WITH {ANSWERS.format(events='events')}, k AS (SELECT an.*, object_kind, CASE WHEN broken THEN 'malformed_json' WHEN version <> 'v1' THEN 'protocol_version_mismatch' WHEN answered <> request_id THEN 'request_id_mismatch' END AS refused
  FROM an LEFT JOIN predicate_schemas USING (predicate)),
r AS (SELECT request_id, unnest([0, 1]) AS place, k.* EXCLUDE (request_id) FROM k WHERE refused IS NULL)
SELECT request_id, 'c1' AS candidate_id, concat_ws(',', CASE WHEN place = 1 THEN 'duplicate_candidate_id' END, CASE WHEN subject = '' THEN 'missing_subject' END, CASE WHEN object_kind IS NULL THEN 'unknown_predicate' END,
  CASE WHEN object_entity = '' AND object_literal = '' THEN 'missing_object' END, CASE WHEN object_entity <> '' AND object_literal <> '' THEN 'two_objects' END,
  CASE WHEN object_kind = 'entity' AND object_entity = '' AND object_literal <> '' THEN 'object_must_be_entity' END, CASE WHEN object_kind = 'literal' AND object_literal = '' AND object_entity <> '' THEN 'object_must_be_literal' END,
  CASE WHEN confidence > 1 THEN 'confidence_out_of_range' END, CASE WHEN confidence < 0.2 THEN 'confidence_too_low' END, CASE WHEN n_cited = 0 THEN 'missing_evidence' END,
  CASE WHEN n_cited > 0 AND episode > 4 THEN 'evidence_not_in_request' END, CASE WHEN sensitivity = 'secret' THEN 'unknown_sensitivity' END) AS reasons FROM r
UNION ALL SELECT request_id, NULL, refused FROM k WHERE refused IS NOT NULL""", ("predicate_schemas",))
def response_validation(m):
    """Answers as JSON, each with the same candidate twice, through the envelope and all gates."""
    rows = m.spark.sql(f"WITH {ANSWERS.replace('VARCHAR(20)', 'STRING')} SELECT * FROM an", events=m.events)
    fact = F.struct(
        F.lit("c1").alias("candidate_id"), "subject", "predicate", "object_entity", "object_literal", "confidence",
        F.slice(F.array(F.col("episode").cast("string"), F.lit("0")), F.lit(1), F.col("n_cited").cast("int")).alias("evidence"), "sensitivity",
    )
    body = F.to_json(F.struct(F.col("version").alias("protocol_version"), F.col("answered").alias("request_id"), F.array(fact, fact).alias("facts")))
    answers = stored(rows.select("request_id", F.when(F.col("broken"), F.substring(body, 1, 9)).otherwise(body).alias("body")))
    shown = rows.select("request_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("episode_id"))
    return validation.candidates(answers, m.predicate_schemas, shown).select("request_id", "candidate_id", F.array_join("reasons", ",").alias("reasons"))
