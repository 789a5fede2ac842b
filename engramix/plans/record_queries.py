"""Queries over the rows that writes leave behind, mirror payloads, inspection defaults, policies and text tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import analysis, search
from ..operators import authority as A
from ..operators import mutations as M
from ..operators import records as R
from ..sources import sinks
from .authority_queries import EVIDENCE
from .ranking_queries import OPEN, SEEDS, seeds
from .registry import query
from .state_queries import KEY, REASON, SLOT, TARGETS, targets
from .text_queries import FRAGMENTS, QUESTIONS

RAW = """SELECT fact_id, predicate, CASE WHEN fact_id % 4 = 1 THEN '' WHEN fact_id % 4 = 2 THEN NULL ELSE fact_type END AS fact_type, confidence, importance,
  CASE WHEN fact_id % 3 = 0 THEN '' ELSE sensitivity_level END AS sensitivity_level, pinned FROM facts"""


@query(
    f"""WITH c AS ({RAW}) SELECT fact_id, coalesce(nullif(fact_type, ''), default_fact_type, 'stable_preference') AS fact_type, CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END AS confidence,
  CASE WHEN importance = 0 THEN CAST(default_importance AS DOUBLE) ELSE importance END AS importance, CASE WHEN sensitivity_level <> '' THEN sensitivity_level WHEN sensitive_by_default THEN 'sensitive' ELSE 'normal' END AS sensitivity_level,
  'valid' AS validity_status, 'visible' AS visibility_status, 'active' AS lifecycle_status, CASE WHEN pinned THEN 'user' END AS pin_actor, CASE WHEN pinned THEN 'manual pin' END AS pin_reason
FROM c JOIN predicate_schemas USING (predicate)""", ("facts", "predicate_schemas"))
def fact_defaults(m):
    k = F.col("fact_id")
    raw = m.facts.select(
        "fact_id", "predicate", F.when(k % 4 == 1, "").when(k % 4 != 2, F.col("fact_type")).alias("fact_type"), "confidence", "importance", F.when(k % 3 == 0, "").otherwise(F.col("sensitivity_level")).alias("sensitivity_level"), "pinned")
    return R.build_facts(raw, m.predicate_schemas)


@query(
    """WITH a AS (SELECT node_id AS fact_id, count(*) AS n, max(least(retrieval_score / 100, 1.0)) AS i FROM access_events WHERE access_type = 'reinforced' GROUP BY 1)
SELECT f.fact_id, reinforcement_count + coalesce(n, 0) AS reinforcement_count, CASE WHEN i IS NULL OR importance > i THEN importance ELSE i END AS importance FROM facts f LEFT JOIN a ON a.fact_id = f.fact_id""", ("facts", "access_events"))
def reinforcement(m):
    again = m.access_events.filter("access_type = 'reinforced'").select(F.col("node_id").alias("fact_id"), F.least(F.col("retrieval_score") / 100, F.lit(1.0)).alias("importance"))
    return R.reinforce(m.facts, again).select("fact_id", "reinforcement_count", "importance")


@query(
    """WITH h AS (SELECT DISTINCT f.persona_id, 'fact' AS from_type, from_id, link_type, to_type, to_id FROM links JOIN facts f ON f.fact_id = from_id),
n AS (SELECT persona_id, fact_id, subject_entity_id AS e FROM facts UNION SELECT persona_id, fact_id, object_entity_id FROM facts WHERE object_entity_id IS NOT NULL)
SELECT persona_id, 'fact' AS from_type, fact_id AS from_id, 'ABOUT_ENTITY' AS link_type, 'entity' AS to_type, e AS to_id FROM n
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.persona_id = n.persona_id AND h.from_id = n.fact_id AND h.link_type = 'ABOUT_ENTITY' AND h.to_type = 'entity' AND h.to_id = n.e)""", ("facts", "links"))
def about_entity_links(m):
    have = m.links.join(m.facts.select(F.col("fact_id").alias("from_id"), "persona_id"), "from_id").withColumn("from_type", F.lit("fact"))
    return R.missing_links(have, R.about_links(m.facts))


REPLACED = f"""k AS (SELECT *, {KEY} AS k FROM facts WHERE predicate IN ('lives_in', 'works_at')), st AS (SELECT *, coalesce(lag(k) OVER ({SLOT} ORDER BY valid_from, fact_id) <> k, true) AS starts FROM k),
rp AS (SELECT fact_id, lead(fact_id) OVER ({SLOT} ORDER BY valid_from, fact_id) AS superseded_by FROM st WHERE starts), re AS (SELECT * FROM rp WHERE superseded_by IS NOT NULL)"""


def replaced(m):
    return M.supersede(m.facts.filter(F.col("predicate").isin("lives_in", "works_at")))


@query(f"WITH {REPLACED} SELECT superseded_by AS from_id, 'SUPERSEDES' AS link_type, fact_id AS to_id, 'consolidation' AS created_by FROM re", ("facts",))
def supersedes_links(m):
    return R.superseding_links(replaced(m))


@query(
    f"""WITH {REPLACED} SELECT 'fact' AS node_type, CAST(id AS VARCHAR) AS node_id, 'upsert_node' AS operation, CAST(5 AS BIGINT) AS priority, 'pending' AS status FROM (SELECT fact_id AS id FROM re UNION SELECT superseded_by FROM re)
UNION ALL SELECT 'memory_link', superseded_by || ':SUPERSEDES:' || fact_id, 'upsert_edge', 5, 'pending' FROM re""", ("facts",))
def index_sync_enqueue(m):
    pairs = replaced(m)
    nodes = pairs.select("fact_id").unionAll(pairs.select(F.col("superseded_by").alias("fact_id")))
    return R.sync_rows(nodes, R.superseding_links(pairs))


@query(
    f"""WITH t AS (SELECT fact_id FROM facts WHERE {TARGETS})
SELECT DISTINCT 'memory_link' AS node_type, link_id AS node_id, 'delete_edge' AS operation FROM links WHERE from_id IN (SELECT fact_id FROM t) OR (to_type = 'fact' AND to_id IN (SELECT fact_id FROM t))
UNION ALL SELECT 'fact', node_id, 'delete_node' FROM memory_index_map WHERE node_type = 'fact' AND index_status = 'indexed' AND node_id IN (SELECT fact_id FROM t)""", ("facts", "links", "memory_index_map"))
def mirror_delete_rows(m):
    return R.delete_rows(m.links, m.memory_index_map, targets(m))


@query(
    """SELECT link_id, link_type, a.mirror_id AS from_mirror_id, b.mirror_id AS to_mirror_id FROM links l
LEFT JOIN memory_index_map a ON a.node_type = 'fact' AND a.node_id = l.from_id AND a.index_status = 'indexed' LEFT JOIN memory_index_map b ON b.node_type = l.to_type AND b.node_id = l.to_id AND b.index_status = 'indexed'""",
    ("links", "memory_index_map"))
def edge_index_ids(m):
    return R.edge_payloads(m.links, m.memory_index_map).select("link_id", "link_type", "from_mirror_id", "to_mirror_id")


@query(
    f"""WITH {EVIDENCE}, j AS (SELECT f.*, s.canonical_name AS sn, o.canonical_name AS ob, content_summary || CASE WHEN contains(lower(content_summary), predicate) THEN '' ELSE ' ' || predicate END AS t1 FROM facts f LEFT JOIN entities s ON s.entity_id = f.subject_entity_id
  LEFT JOIN entities o ON o.entity_id = f.object_entity_id LEFT JOIN ev USING (fact_id) WHERE f.visibility_status = 'visible' AND f.searchable AND (coalesce(n_links, 0) = 0 OR coalesce(n_episodes, 0) > 0)),
w AS (SELECT *, t1 || CASE WHEN sn IS NULL OR contains(lower(t1), lower(sn)) THEN '' ELSE ' ' || sn END AS t2 FROM j)
SELECT fact_id, t2 || CASE WHEN ob IS NULL OR contains(lower(t2), lower(ob)) THEN '' ELSE ' ' || ob END AS searchable_text, fact_type, importance, validity_status, lifecycle_status, pinned FROM w""",
    ("facts", "entities", "links", "episodes"))
def mirror_fact_payloads(m):
    rows = R.fact_payloads(m.facts, m.entities, m.links, m.episodes)
    return rows.select("fact_id", "searchable_text", "fact_type", "importance", "validity_status", "lifecycle_status", "pinned")


@query(
    f"""SELECT e.entity_id, e.canonical_name, e.entity_type, coalesce(string_agg(DISTINCT alias, ',' ORDER BY alias), '') AS aliases FROM entities e LEFT JOIN entity_aliases a ON a.entity_id = e.entity_id
WHERE {OPEN} GROUP BY 1, 2, 3""", ("entities", "entity_aliases"))
def mirror_entity_payloads(m):
    return R.entity_payloads(m.entities, m.entity_aliases).select("entity_id", "canonical_name", "entity_type", "aliases")


@query("SELECT episode_id, persona_id, session_id, occurred_at, 'redacted' AS redaction_level, sha256(content) AS content_hash_before FROM episodes WHERE role = 'assistant'", ("episodes",))
def episode_tombstones(m):
    return R.tombstones(m.episodes, m.episodes.filter("role = 'assistant'"))


@query(
    """SELECT queue_id, CASE WHEN status <> 'processing' THEN status WHEN queue_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN status = 'processing' AND queue_id % 3 = 0 THEN attempts + 1 ELSE attempts END AS attempts FROM queue""", ("queue",))
def queue_finish(m):
    outcomes = m.queue.filter("status = 'processing'").select("queue_id", (F.col("queue_id") % 3 != 0).alias("ok"))
    return R.finish(m.queue, outcomes).select("queue_id", "status", "attempts")


@query(
    f"""WITH ok AS (SELECT * FROM facts WHERE {REASON} IS NULL), g AS (SELECT persona_id, subject_entity_id FROM ok GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT persona_id || ':' || subject_entity_id AS narrative_id, 'DERIVED_FROM' AS link_type, fact_id, 'consolidated' AS lifecycle_status FROM ok JOIN g USING (persona_id, subject_entity_id)""", ("facts",))
def compression_links(m):
    return R.derived_rows(m.facts.filter(M.compression_reason().isNull()), M.compress(m.facts))


@query(
    f"""WITH RECURSIVE o AS (SELECT session_id % 20 AS key, event_id AS seq, CAST(floor(epoch(created_at)) AS BIGINT) AS at_s, access_type IN ('filtered', 'suppressed') AS failed FROM access_events),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_s, seq) AS i FROM o),
b AS (SELECT key, i, seq, true AS allowed, [failed] AS recent, CAST(NULL AS BIGINT) AS until FROM n WHERE i = 1
  UNION ALL SELECT n.key, n.i, n.seq, until IS NULL OR n.at_s >= until,
    CASE WHEN until IS NOT NULL AND n.at_s < until THEN recent WHEN until IS NOT NULL THEN [] WHEN list_count(list_filter(list_append(recent, n.failed)[-20:], lambda x: x)) >= 3 THEN [] ELSE list_append(recent, n.failed)[-20:] END,
    CASE WHEN until IS NOT NULL AND n.at_s < until THEN until WHEN until IS NOT NULL THEN CASE WHEN n.failed THEN n.at_s + 600 END WHEN list_count(list_filter(list_append(recent, n.failed)[-20:], lambda x: x)) >= 3 THEN n.at_s + 600 END
  FROM b JOIN n ON n.key = b.key AND n.i = b.i + 1)
SELECT key, seq, allowed FROM b""", ("access_events",))
def circuit_breaker(m):
    """Calls of twenty callers; a breaker stays open for ten minutes."""
    at = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 1_000_000).cast("bigint")
    rows = m.access_events.select((F.col("session_id") % 20).alias("key"), at.alias("at_s"), F.col("event_id").alias("seq"), F.col("access_type").isin("filtered", "suppressed").alias("failed"))
    return R.breaker(rows, open_s=600)


@query(
    f"""WITH ls AS (SELECT l.from_id, bool_or(e.visibility_status = 'visible' AND e.searchable) AS seen FROM links l LEFT JOIN episodes e ON e.episode_id = l.to_id WHERE l.link_type = 'EVIDENCED_BY' GROUP BY 1)
SELECT fact_id FROM facts LEFT JOIN ls ON from_id = fact_id WHERE {OPEN} AND validity_status IN ('valid', 'uncertain') AND lifecycle_status NOT IN ('archived', 'deep_archived') AND sensitivity_level <> 'highly_sensitive'
AND (coalesce(seen, false) OR (pinned AND from_id IS NULL))""", ("facts", "links", "episodes"))
def inspect_default_authority(m):
    """What an inspection shows by default to a reader of sensitive facts: the episode's state counts, the link's does not."""
    rank = S.lookup(F.col("sensitivity_level"), S.SENSITIVITY_RANKS, 0)
    own = F.col("validity_status").isin("valid", "uncertain") & ~F.col("lifecycle_status").isin("archived", "deep_archived") & (rank <= 1)
    rows = A.with_evidence(m.facts.filter(OPEN).filter(own), A.evidence(m.links, m.episodes, 2))
    return rows.filter((F.col("n_episodes") > 0) | (F.col("pinned") & (F.col("n_links") == 0))).select("fact_id")


@query(
    """WITH x AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'sensitive' WHEN 2 THEN 'highly_sensitive' WHEN 3 THEN 'odd' END AS level, o_orderkey AS id FROM orders)
SELECT id, CAST(CASE level WHEN 'normal' THEN 0 WHEN 'sensitive' THEN 1 WHEN 'highly_sensitive' THEN 2 ELSE 0 END AS BIGINT) AS open_rank, CAST(CASE level WHEN 'normal' THEN 0 WHEN 'sensitive' THEN 1 WHEN 'highly_sensitive' THEN 2 ELSE 3 END AS BIGINT) AS strict_rank FROM x""")
def sensitivity_rank_variants(m):
    """Unknown levels rank lowest in one variant and above all permissions in the other."""
    k = F.col("o_orderkey") % 5
    level = F.when(k == 0, "normal").when(k == 1, "sensitive").when(k == 2, "highly_sensitive").when(k == 3, "odd")
    rank = lambda default: S.lookup(F.col("level"), S.SENSITIVITY_RANKS, default).cast("bigint")
    return m.orders.select(F.col("o_orderkey").alias("id"), level.alias("level")).select("id", rank(0).alias("open_rank"), rank(3).alias("strict_rank"))


@query(
    f"""WITH x AS ({QUESTIONS}), n AS (SELECT query_id, trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) AS t FROM x), p AS (SELECT query_id, query_id % 5 = 0 AS asked, {analysis.time_mode_sql('t')} AS mode, {analysis.need_sql('t')} AS need FROM n)
SELECT query_id, asked OR mode = 'historical' OR need = 'state_transition' AS allow_historical FROM p""", ("queries",))
def effective_policy(m):
    """History is shown where the policy allows it, or the question asks for the past or for a change."""
    prefixes = m.spark.createDataFrame(list(enumerate(analysis.SAMPLE_PREFIXES)), "k int, p string")
    asked = m.queries.join(F.broadcast(prefixes)).select((100 * F.col("query_id") + F.col("k")).alias("query_id"), T.normalize(F.concat("p", F.lit(" "), "query_text")).alias("t"))
    past = (analysis.time_mode(F.col("t")) == "historical") | (analysis.evidence_need(F.col("t")) == "state_transition")
    return asked.select("query_id", ((F.col("query_id") % 5 == 0) | past).alias("allow_historical"))


@query(
    f"""SELECT fact_id FROM facts JOIN mirror_persona_state USING (persona_id) WHERE state = 'ready' AND {OPEN}""", ("facts", "mirror_persona_state"))
def mirror_state_gate(m):
    """Facts of personas whose mirror is ready."""
    return m.facts.filter(OPEN).join(F.broadcast(m.mirror_persona_state.filter("state = 'ready'").select("persona_id")), "persona_id", "left_semi").select("fact_id")


CITED_BY = f"SELECT from_id AS fact_id, to_id AS episode_id FROM links WHERE link_type = 'EVIDENCED_BY' AND {OPEN}"


@query(
    f"""WITH {SEEDS}, c AS ({CITED_BY}), e AS (SELECT episode_id FROM episodes WHERE {OPEN} AND sensitivity_level = 'normal'), s AS (SELECT DISTINCT fact_id FROM c WHERE fact_id IN (SELECT fact_id FROM seeds) AND episode_id IN (SELECT episode_id FROM e))
SELECT query_id, fact_id, CAST(0.18 AS DOUBLE) AS bonus, rank_position FROM (SELECT fact_id % 5 AS query_id, fact_id, row_number() OVER (PARTITION BY fact_id % 5 ORDER BY fact_id) AS rank_position FROM s) WHERE rank_position <= 24""",
    ("facts", "links", "episodes"))
def provenance_completion(m):
    """Of each question's scored facts the first 24, by id, whose sources may be shown."""
    eligible = m.episodes.filter(A.visible_at(0)).select(F.col("episode_id").alias("to_id"))
    cited = m.links.filter(OPEN).filter("link_type = 'EVIDENCED_BY'").join(eligible, "to_id", "left_semi").select(F.col("from_id").alias("fact_id")).distinct()
    shown = seeds(m).join(cited, "fact_id", "left_semi").select((F.col("fact_id") % 5).alias("query_id"), "fact_id", F.lit(0.18).alias("bonus"))
    return search.top_k(shown, 24, [F.asc("fact_id")], "query_id").select("query_id", "fact_id", "bonus", "rank_position")


@query(
    f"""WITH q AS (SELECT query_id, trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) AS t FROM ({FRAGMENTS})), d AS (SELECT node_id, trim(regexp_replace(lower(search_text), '\\s+', ' ', 'g')) AS t FROM search_documents)
SELECT query_id, node_id, CAST(1.0 AS DOUBLE) AS score, rank_position FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS rank_position FROM q, d WHERE contains(d.t, q.t)) WHERE rank_position <= 16""",
    ("search_documents",))
def fake_dense_search(m):
    """The stand-in for a vector search: documents that hold the whole normalised query, by key, all with score 1."""
    piece = F.substring(F.regexp_extract(F.lower("text"), "[a-z]{7,}", 0), 2, 5)
    asked = m.benchmark.select(F.col("item_id").alias("query_id"), T.normalize(F.when(F.col("item_id") % 3 == 0, piece).otherwise(F.col("text"))).alias("q"))
    docs = m.search_documents.select("node_id", T.normalize(F.col("search_text")).alias("low"))
    hits = search.against_blocks(docs, asked, lambda met: met.select("node_id", F.explode(F.filter("qs", lambda q: F.contains(F.col("low"), q["q"]))["query_id"]).alias("query_id")))
    return search.top_k(hits.select("query_id", "node_id", F.lit(1.0).alias("score")), 16, [F.asc("node_id")], "query_id")


@query(
    """WITH c AS (SELECT from_id AS fact_id, list_sort(list_distinct(list(to_id))) AS all_ids, list_sort(list_distinct(list(to_id) FILTER (WHERE link_type = 'EVIDENCED_BY'))) AS cited FROM links GROUP BY 1)
SELECT fact_id, all_ids = coalesce(cited, []) AS same FROM c""", ("links",))
def same_sources(m):
    """Whether a fact's links lead to the episodes that it cites and nowhere else."""
    ids = lambda c: F.array_sort(F.collect_set(c))
    per = m.links.groupBy(F.col("from_id").alias("fact_id")).agg(ids("to_id").alias("a"), ids(F.when(F.col("link_type") == "EVIDENCED_BY", F.col("to_id"))).alias("b"))
    return per.select("fact_id", T.same_set(F.col("a"), F.col("b")).alias("same"))


@query(
    r"""WITH x AS (SELECT query_id, concat(repeat('记忆', CAST(query_id % 40 AS INTEGER)), CASE WHEN query_id % 4 = 0 THEN '' ELSE query_text END) AS t FROM queries),
n AS (SELECT query_id, len(regexp_extract_all(t, '\p{Han}')) AS han, len(regexp_extract_all(t, '[A-Za-z]')) AS latin FROM x)
SELECT query_id, han > 0 AND han >= greatest(1, latin // 3) AS cjk_heavy, latin > 0 AS has_ascii_letter FROM n""", ("queries",))
def script_tests(m):
    k = F.col("query_id")
    t = F.concat(F.repeat(F.lit("记忆"), (k % 40).cast("int")), F.when(k % 4 == 0, "").otherwise(F.col("query_text")))
    return m.queries.select("query_id", T.cjk_heavy(t).alias("cjk_heavy"), T.has_ascii_letter(t).alias("has_ascii_letter"))


@query("""SELECT '{"fact_id":' || fact_id || ',"predicate":"' || predicate || '","pinned":' || pinned || CASE WHEN object_literal IS NULL THEN '' ELSE ',"object_literal":"' || object_literal || '"' END || '}' AS value FROM facts""", ("facts",))
def json_lines(m):
    return sinks.json_rows(m.facts.select("fact_id", "predicate", "pinned", "object_literal"))


@query("SELECT concat_ws(chr(9), fact_id, predicate, coalesce(object_literal, '')) AS value FROM facts", ("facts",))
def text_lines(m):
    return sinks.text_rows(m.facts.select("fact_id", "predicate", "object_literal"))
