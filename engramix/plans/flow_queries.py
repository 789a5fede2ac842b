"""Queries over whole flows: question scores, probes, merges, rebuilds, extraction and corpus metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as Q
from ..operators import authority as A
from ..operators import gates, graph, search
from ..operators import mutations as M
from .authority_queries import EVIDENCE
from .context_queries import ASKED, NOTE, noted
from .ranking_queries import DENSE, OPEN, dense_hits
from .registry import query
from .state_queries import decisions_sql
from .text_queries import BM25


FITTED = f"""d AS (SELECT *, {Q.time_mode_sql('t')} AS tm, {Q.domain_sql('t')} AS dm, len(list_distinct(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS nt FROM ab),
ft AS (SELECT query_id, least(1.0, greatest(0.0, 0.20 + 0.18 * (ability <> 'direct_fact')::INT + 0.14 * (CASE WHEN (ability = 'direct_fact') = (need = 'exact_observation') THEN 1 ELSE 0 END) + 0.10 * (tm <> 'current')::INT
  + 0.09 * (dm <> 'relationship')::INT + 0.08 * (need <> 'exact_observation')::INT + 0.08 * least(1.0, nt / 8.0) - 0.15 * (signals = 'exact_fact')::INT - 0.06 * contains(signals, 'sensitivity')::INT)) AS fit FROM d)"""


@query(
    f"WITH {ASKED}, {NOTE}, {FITTED} SELECT query_id, round(fit, 8) AS rule_fit, round(least(1.0, greatest(0.0, 0.6 * fit + 0.4 * 0.5)), 8) AS expected FROM ft", ("queries",))
def question_scores(m):
    t = F.col("t")
    yes = lambda c: c.cast("int").cast("double")
    parts = {
        "intent": yes(F.col("ability") != "direct_fact"),
        "consistency": yes((F.col("ability") == "direct_fact") == (F.col("need") == "exact_observation")),
        "time": yes(Q.time_mode(t) != "current"),
        "domain": yes(Q.domain(t) != "relationship"),
        "need": yes(F.col("need") != "exact_observation"),
        "specificity": F.least(F.lit(1.0), F.size(T.fields(t)) / 8.0),
        "default": yes(F.array_contains("signals", "exact_fact")),
        "sensitivity": yes(F.array_contains("signals", "sensitivity")),
    }
    rows = noted(m).select("query_id", Q.rule_fit(parts).alias("fit"))
    return rows.select("query_id", F.round("fit", 8).alias("rule_fit"), F.round(Q.expected_confidence(F.col("fit"), F.lit(0.5), F.lit(0.0)), 8).alias("expected"))


PROBED = f"""f AS (SELECT * FROM facts WHERE {OPEN}), p AS (SELECT persona_id, max(importance) FILTER (WHERE pinned) AS tp, count(*) FILTER (WHERE pinned) AS np,
  max(importance) FILTER (WHERE importance >= 0.7) AS tr, count(*) FILTER (WHERE importance >= 0.7) AS nr, max(importance) FILTER (WHERE predicate = 'likes') AS tl, count(*) FILTER (WHERE predicate = 'likes') AS nl FROM f GROUP BY 1),
c AS (SELECT persona_id, CASE WHEN np > 0 THEN 0.35 + 0.25 * tp ELSE 0.0 END AS pinned, CASE WHEN nr > 0 THEN 0.25 + 0.25 * tr ELSE 0.0 END AS recent,
  CASE WHEN nl > 0 THEN CASE WHEN tl > 0 THEN 0.7 + 0.2 * tl ELSE 0.2 + least(0.15, 0.05 * nl) END ELSE 0.0 END AS predicate FROM p),
pr AS (SELECT persona_id, round(pinned, 8) AS pinned, round(recent, 8) AS recent, round(predicate, 8) AS predicate, round(1 - (1 - pinned) * (1 - recent) * (1 - predicate), 8) AS readiness FROM c)"""


@query(f"WITH {PROBED} SELECT * FROM pr", ("facts",))
def anchor_probes(m):
    rows = m.facts.filter(OPEN)
    wanted = {"pinned": F.col("pinned"), "recent": F.col("importance") >= 0.7, "predicate": F.col("predicate") == "likes"}
    per = rows.groupBy("persona_id").agg(*[x for k, c in wanted.items() for x in (F.max(F.when(c, F.col("importance"))).alias(f"top_{k}"), F.count_if(c).alias(f"n_{k}"))])
    per = per.select("persona_id", *[Q.probe_confidence(k, F.col(f"top_{k}"), F.col(f"n_{k}")).alias(k) for k in wanted])
    return per.select("persona_id", *[F.round(k, 8).alias(k) for k in wanted], F.round(Q.noisy_or(F.array(*wanted)), 8).alias("readiness"))


@query(
    f"""WITH {DENSE}, r AS (SELECT query_id, vec_id, variant = 'raw' AS raw, rank_position, score, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY CASE variant WHEN 'raw' THEN 0 ELSE 1 END, rank_position, score DESC, variant) AS k,
  count(*) OVER (PARTITION BY query_id, vec_id) AS n FROM hits)
SELECT query_id, vec_id, raw, rank_position, n AS n_hits FROM r WHERE k = 1""")
def mirror_candidate_merge(m):
    hits = dense_hits(m).withColumn("late", F.when(F.col("variant") == "raw", 0).otherwise(1))
    best = F.min(F.struct("late", "rank_position")).alias("b")
    return hits.groupBy("query_id", "vec_id").agg(best, F.count(F.lit(1)).alias("n_hits")).select("query_id", "vec_id", (F.col("b.late") == 0).alias("raw"), F.col("b.rank_position").alias("rank_position"), "n_hits")


@query(
    f"""WITH {ASKED}, {NOTE}, s AS (SELECT query_id, ability, CASE WHEN query_id % 4 = 0 THEN NULL WHEN query_id % 4 = 1 THEN 'planning' ELSE 'provenance' END AS sem, (query_id % 10) / 10.0 AS rc, (query_id % 13) / 12.0 AS sc, query_id % 3 <> 0 AS ev FROM ab)
SELECT query_id, CASE WHEN sem IS NOT NULL AND ev AND round(sc, 9) >= 0.7 AND round(sc - rc, 9) >= 0.08 THEN sem ELSE ability END AS ability FROM s""", ("queries",))
def semantic_merge(m):
    k = F.col("query_id")
    semantic = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "planning").otherwise("provenance")
    merged = Q.merge_field(F.col("ability"), semantic, (k % 10) / 10.0, F.round((k % 13) / 12.0, 9), k % 3 != 0)
    return noted(m).select("query_id", merged.alias("ability"))


@query(
    f"""WITH {BM25}, tp AS (SELECT query_id, node_id, score FROM bm WHERE rank_position <= 3), l AS (SELECT from_id, to_id, max(abs(weight)) AS w FROM links WHERE link_type IN ('SUPPORTS', 'EXPLAINS') AND to_type = 'fact' AND {OPEN} GROUP BY 1, 2),
c AS (SELECT query_id, to_id AS fact_id, round(max(score * w), 6) AS priority FROM tp JOIN l ON from_id = node_id GROUP BY 1, 2)
SELECT query_id, fact_id, priority, rank_position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, fact_id) AS rank_position FROM c) WHERE rank_position <= 12""",
    ("search_documents", "queries", "links"))
def narrative_completion(m):
    found = search.bm25(m.search_documents, m.queries, 3)
    typed = graph.open_links(m.links).filter(F.col("link_type").isin("SUPPORTS", "EXPLAINS") & (F.col("to_type") == "fact"))
    strongest = typed.groupBy(F.col("from_id").alias("node_id"), F.col("to_id").alias("fact_id")).agg(F.max(F.abs("weight")).alias("w"))
    rows = found.join(strongest, "node_id").groupBy("query_id", "fact_id").agg(F.round(F.max(F.col("score") * F.col("w")), 6).alias("priority"))
    return search.top_k(rows, 12, [F.desc("priority"), F.asc("fact_id")], "query_id")


@query(
    """WITH n AS (SELECT episode_id + 50 AS episode_id, session_id, at_s + 30 AS at_s FROM episodes WHERE role = 'user'),
a AS (SELECT episode_id, session_id, at_s FROM episodes UNION ALL SELECT * FROM n WHERE episode_id NOT IN (SELECT episode_id FROM episodes))
SELECT episode_id, session_id, lag(episode_id) OVER w AS prev_episode_id, lead(episode_id) OVER w AS next_episode_id FROM a WINDOW w AS (PARTITION BY session_id ORDER BY at_s, episode_id)""", ("episodes",))
def episode_append(m):
    fresh = m.episodes.filter("role = 'user'").select((F.col("episode_id") + 50).alias("episode_id"), "session_id", (F.col("at_s") + 30).alias("at_s"))
    return M.append_episodes(m.episodes, fresh)


@query(
    f"""WITH {EVIDENCE}, e AS (SELECT fact_id, lifecycle_status, visibility_status = 'visible' AND searchable AND (coalesce(n_links, 0) = 0 OR coalesce(n_episodes, 0) > 0) AS ok FROM facts LEFT JOIN ev USING (fact_id))
SELECT fact_id, CASE WHEN ok THEN 'upsert' ELSE 'delete' END AS action, CASE WHEN ok THEN CASE lifecycle_status WHEN 'dormant' THEN 'warm' WHEN 'archived' THEN 'cold' WHEN 'deep_archived' THEN 'deep_cold' ELSE 'hot' END END AS tier FROM e""",
    ("facts", "links", "episodes"))
def search_rebuild(m):
    return M.rebuild_search(m.facts, A.evidence(m.links, m.episodes, 0))


@query(
    """WITH q AS (SELECT *, queue_id % 700 AS node_id FROM queue WHERE status IN ('done', 'failed')), l AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC, queue_id DESC) AS k FROM q)
SELECT node_id, CASE WHEN status = 'failed' THEN CASE WHEN operation LIKE 'delete%' THEN 'stale_delete_failed' ELSE 'failed' END WHEN operation LIKE 'delete%' THEN 'deleted' WHEN operation = 'rebuild_persona' THEN 'stale' ELSE 'indexed' END AS index_status
FROM l WHERE k = 1""", ("queue",))
def mirror_index_status(m):
    return M.index_status(m.queue.withColumn("node_id", F.col("queue_id") % 700))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def strict_json(m):
    """A JSON column read with a fixed schema; a malformed row fails the query."""
    parsed = F.from_json("props", "k bigint", {"mode": "FAILFAST"})
    return m.events.select("event_id", parsed["k"].alias("k"))


@query(
    """WITH e AS (SELECT episode_id, lower(content) AS c FROM episodes WHERE role = 'user' AND visibility_status = 'visible' AND searchable)
SELECT episode_id, CASE WHEN contains(c, 'like') THEN 'likes' WHEN contains(c, 'live') THEN 'lives_in' WHEN contains(c, 'promise') THEN 'promised_to' ELSE 'is_busy_with' END AS predicate, left(c, 160) AS summary FROM e""", ("episodes",))
def extraction_mock(m):
    return gates.mock_extract(m.episodes).select("episode_id", "predicate", "summary")


@query(
    """WITH k AS (SELECT f.*, CASE WHEN object_entity_id IS NOT NULL THEN 'entity:' || object_entity_id ELSE 'literal:' || coalesce(trim(regexp_replace(lower(object_literal), '\\s+', ' ', 'g')), '') END AS ok, conflict_policy FROM facts f LEFT JOIN predicate_schemas USING (predicate)),
a AS (SELECT * FROM k WHERE conflict_policy IS NOT NULL AND confidence >= 0.2 AND ok <> 'literal:' AND conflict_policy NOT IN ('llm_check', 'merge') AND sensitivity_level <> 'highly_sensitive' AND subject_entity_id IN (SELECT entity_id FROM entities)),
p AS (SELECT a.*, ok AS object_key FROM a JOIN predicate_schemas s USING (predicate) WHERE (object_kind <> 'entity' OR object_entity_id IS NOT NULL) AND (object_kind <> 'literal' OR object_literal IS NOT NULL)),
held AS (SELECT * FROM p WHERE false), """ + decisions_sql("p", "held") + """
SELECT action, count(*) AS n FROM acted GROUP BY 1 UNION ALL SELECT 'reject', count(*) FROM a WHERE fact_id NOT IN (SELECT fact_id FROM p) HAVING count(*) > 0""", ("facts", "predicate_schemas", "entities"))
def extraction_dry_run(m):
    """What applying the accepted facts would do, by action."""
    accepted = gates.validate_facts(m.facts, m.predicate_schemas, m.entities).filter("decision = 'accepted'").select(*m.facts.columns)
    return M.consolidate(accepted, m.predicate_schemas).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH x AS (SELECT access_type AS profile, node_id % 3 = 0 AS gold, retrieval_score > 50 AS chosen FROM access_events),
c AS (SELECT profile, count(*) FILTER (WHERE gold AND chosen) AS tp, count(*) FILTER (WHERE NOT gold AND chosen) AS fp, count(*) FILTER (WHERE gold AND NOT chosen) AS fn FROM x GROUP BY 1)
SELECT profile, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall, CASE WHEN fp > 0 THEN 1 ELSE 0 END AS forbidden_rate FROM c""",
    ("access_events",))
def corpus_metrics(m):
    from ..operators.metrics import confusion

    rows = m.access_events.select(F.col("access_type").alias("profile"), (F.col("node_id") % 3 == 0).alias("gold"), (F.col("retrieval_score") > 50).alias("chosen"))
    return confusion(rows, "profile")


