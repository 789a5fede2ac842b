"""Queries over lookups, listings, policies, completions and audit."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import completion as K
from ..operators import graph, recall, search
from ..operators import mutations as M
from .authority_queries import AUTHORIZED, FACT_TABLES, authorized
from .ranking_queries import CITED, OPEN, SEEDS, seeds
from .registry import query
from .retrieval_queries import SHOWN, SUPERSEDED
from .selection_sql import insert_sql
from .state_queries import NOW_COLUMN, TARGETS, now, targets
from .text_queries import BM25


@query("SELECT fact_id, predicate, content_summary FROM facts WHERE fact_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')", ("facts",))
def batched_lookup(m):
    """Facts by a table of ids: one semi-join, however long the list."""
    ids = m.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("fact_id"))
    return m.facts.join(ids, "fact_id", "left_semi").select("fact_id", "predicate", "content_summary")


@query(
    """WITH w AS (SELECT *, at_s - min(at_s) OVER (PARTITION BY session_id) AS since FROM episodes)
SELECT episode_id, session_id, rank_position FROM (SELECT episode_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY at_s, episode_id) AS rank_position FROM w
WHERE visibility_status = 'visible' AND searchable AND since BETWEEN 60 AND 900) WHERE rank_position <= 5""", ("episodes",))
def session_window_scan(m):
    """Of every session the first five open episodes from its second minute to its fifteenth."""
    started = m.episodes.groupBy("session_id").agg(F.min("at_s").alias("started_s"))
    rows = m.episodes.filter(OPEN).join(started, "session_id").filter((F.col("at_s") - F.col("started_s")).between(60, 900))
    return search.top_k(rows, 5, [F.asc("at_s"), F.asc("episode_id")], "session_id").select("episode_id", "session_id", "rank_position")


@query(
    """SELECT e.entity_id, canonical_name, count(f.fact_id) AS n_facts, string_agg(DISTINCT f.predicate, ',' ORDER BY f.predicate) AS predicates
FROM entities e JOIN facts f ON f.subject_entity_id = e.entity_id WHERE e.visibility_status = 'visible' AND e.searchable GROUP BY 1, 2""", ("facts", "entities"))
def known_entities(m):
    known = m.entities.filter(OPEN).select("entity_id", "canonical_name")
    per = m.facts.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_facts"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"))
    return known.join(per, "entity_id")


@query(
    """SELECT episode_id, CASE visibility_status WHEN 'redacted' THEN '[redacted]' WHEN 'hidden' THEN '[hidden]' ELSE content END AS content FROM episodes""", ("episodes",))
def node_projection(m):
    v = F.col("visibility_status")
    return m.episodes.select("episode_id", F.when(v == "redacted", "[redacted]").when(v == "hidden", "[hidden]").otherwise(F.col("content")).alias("content"))


@query(
    """SELECT query_id, coalesce(nullif(n, 0), 8) AS memory_count, coalesce(nullif(t, 0), 1200) AS token_budget, n = 0 AND t = 0 AS full_text, h OR n > 6 AS allow_historical
FROM (SELECT query_id, query_id % 10 AS n, query_id % 4 * 300 AS t, query_id % 5 = 0 AS h FROM queries)""", ("queries",))
def policy_normalization(m):
    k = F.col("query_id")
    n, t = k % 10, (k % 4) * 300
    default = lambda c, d: F.when(c == 0, F.lit(d)).otherwise(c)
    return m.queries.select(
        "query_id", default(n, 8).cast("bigint").alias("memory_count"), default(t, 1200).cast("bigint").alias("token_budget"), ((n == 0) & (t == 0)).alias("full_text"), ((k % 5 == 0) | (n > 6)).alias("allow_historical"))


@query(
    """SELECT 'hidden' AS included, count(*) AS n FROM facts WHERE visibility_status IN ('visible', 'hidden') UNION ALL SELECT 'forgotten', count(*) FROM facts WHERE visibility_status IN ('visible', 'forgotten')
UNION ALL SELECT 'all', count(*) FROM facts""", ("facts",))
def include_status_counts(m):
    wanted = {"hidden": ["visible", "hidden"], "forgotten": ["visible", "forgotten"], "all": ["visible", "hidden", "forgotten", "purged"]}
    counts = m.facts.agg(*[F.count_if(F.col("visibility_status").isin(v)).alias(k) for k, v in wanted.items()])
    return counts.unpivot([], list(wanted), "included", "n")


COMPLETED = f"""{SEEDS}, {CITED}, t AS (SELECT from_id AS a, to_id AS b, link_type FROM links WHERE {OPEN} AND to_type = 'fact'),
pl AS (SELECT DISTINCT fact_id, session_id, at_s FROM cited JOIN episodes USING (episode_id)),
ae AS (SELECT DISTINCT from_id AS fact_id, to_id AS entity_id FROM links WHERE link_type = 'ABOUT_ENTITY' AND {OPEN} AND to_id IN (SELECT entity_id FROM entities WHERE {OPEN} AND sensitivity_level = 'normal')),
fo AS (SELECT a AS seed_id, b AS fact_id, 'historical' AS rule, 0.18 AS bonus FROM t WHERE link_type = 'SUPERSEDES'
  UNION ALL SELECT a, b, 'causal', 0.36 FROM t WHERE link_type IN ('CAUSED_BY', 'EXPLAINS') UNION ALL SELECT b, a, 'causal', 0.36 FROM t WHERE link_type IN ('CAUSED_BY', 'EXPLAINS')
  UNION ALL SELECT x.fact_id, y.fact_id, 'event_bundle', 0.18 FROM cited x JOIN cited y USING (episode_id) WHERE x.fact_id IN (SELECT fact_id FROM seeds)
  UNION ALL SELECT x.fact_id, y.fact_id, 'event_bundle', 0.18 FROM pl x JOIN pl y ON x.session_id = y.session_id AND abs(x.at_s - y.at_s) <= 7200 WHERE x.fact_id IN (SELECT fact_id FROM seeds)
  UNION ALL SELECT x.fact_id, y.fact_id, 'event_bundle', 0.18 FROM ae x JOIN ae y USING (entity_id) WHERE x.fact_id IN (SELECT fact_id FROM seeds)),
be AS (SELECT seed_id, fact_id, max((bonus, rule)) AS b FROM fo WHERE seed_id <> fact_id AND seed_id IN (SELECT fact_id FROM seeds) GROUP BY 1, 2),
d AS (SELECT seed_id, fact_id, b[2] AS rule, CAST(b[1] AS DOUBLE) AS bonus, row_number() OVER (PARTITION BY seed_id ORDER BY b[1] DESC, fact_id) AS place FROM be),
k AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY bonus DESC, fact_id) AS rank_position FROM d WHERE place <= 24 AND fact_id IN (SELECT fact_id FROM auth))"""


@query(f"WITH {AUTHORIZED}, {COMPLETED} SELECT seed_id, fact_id, rule, bonus, rank_position FROM k WHERE rank_position <= 12", FACT_TABLES)
def linked_completion(m):
    return K.complete(m.links, m.episodes, m.entities, seeds(m), authorized(m))


@query(
    f"""WITH RECURSIVE {SHOWN}, {SUPERSEDED}, mk AS (SELECT persona_id AS query_id, fact_id, FALSE AS historical, row_number() OVER (PARTITION BY persona_id ORDER BY importance DESC, fact_id) AS rank_position
  FROM shown WHERE NOT past QUALIFY rank_position <= 8),
os AS (SELECT query_id, source_id, sp.fact_id, row_number() OVER (PARTITION BY query_id ORDER BY source_id, abs(weight) DESC, link_id, sp.fact_id) AS n
  FROM mk JOIN sp ON source_id = mk.fact_id JOIN shown f ON f.fact_id = sp.fact_id AND f.persona_id = query_id),
{insert_sql('mk', 'os')} SELECT query_id, fact_id, rank_position FROM done""", FACT_TABLES)
def supersedes_insertion(m):
    """Each persona's eight most important facts, with the allowed facts of the persona that they replaced."""
    shown = recall.shown_facts(m.facts, m.entities, m.links, m.episodes).select("fact_id", F.col("persona_id").alias("query_id"), "importance", "past")
    top = search.top_k(shown.filter("NOT past"), 8, [F.desc("importance"), F.asc("fact_id")], "query_id").select("query_id", "fact_id", "rank_position", F.lit(False).alias("historical"))
    out = top.select("query_id", F.col("fact_id").alias("source_id")).join(K.superseded(m.links), "source_id")
    return K.insert_superseded(top, out.join(shown.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_semi"))


@query(
    rf"""WITH {BM25}, q2 AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query_text), '[0-9a-z_]+')) AS qt FROM queries), d2 AS (SELECT node_id, list_distinct(regexp_extract_all(lower(search_text), '[0-9a-z_]+')) AS dt FROM search_documents)
SELECT query_id, node_id, round(len(list_intersect(qt, dt)) / CAST(len(qt) AS DOUBLE) + node_id % 3 / 10.0, 6) AS score FROM bm JOIN q2 USING (query_id) JOIN d2 USING (node_id) WHERE rank_position <= 10""",
    ("search_documents", "queries"))
def deterministic_rerank(m):
    ranked = search.bm25(m.search_documents, m.queries, 10)
    q = m.queries.select("query_id", T.word_tokens(F.col("query_text")).alias("qt"))
    d = m.search_documents.join(ranked.select("node_id").distinct(), "node_id", "left_semi").select("node_id", T.word_tokens(F.col("search_text")).alias("dt"))
    score = K.overlap_rerank(F.col("qt"), F.col("dt"), (F.col("node_id") % 3) / 10.0)
    return ranked.join(q, "query_id").join(d, "node_id").select("query_id", "node_id", score.alias("score"))


@query(
    f"""WITH {BM25}, tp AS (SELECT query_id, max(score) FILTER (WHERE rank_position = 1) AS top, max(score) FILTER (WHERE rank_position = 2) AS second FROM bm WHERE rank_position <= 2 GROUP BY 1)
SELECT query_id, query_id % 2 = 0 AND top / 100 >= 0.45 AND (top - coalesce(second, 0)) / 100 >= 0.15 AS skips FROM tp""", ("search_documents", "queries"))
def selective_rerank_gate(m):
    first = lambda r: F.max(F.when(F.col("rank_position") == r, F.col("score")))
    per = search.bm25(m.search_documents, m.queries, 2).groupBy("query_id").agg(first(1).alias("top"), F.coalesce(first(2), F.lit(0.0)).alias("second"))
    gate = K.skips_rerank(F.col("query_id") % 2 == 0, F.col("top") / 100, (F.col("top") - F.col("second")) / 100, F.lit(True))
    return per.select("query_id", gate.alias("skips"))


@query(
    """WITH d AS (SELECT fact_id, CASE WHEN confidence < 0.2 THEN 'rejected' WHEN sensitivity_level = 'highly_sensitive' THEN 'needs_review' ELSE 'accepted' END AS decision FROM facts)
SELECT decision, count(*) AS n FROM d GROUP BY 1""", ("facts",))
def gate_summary(m):
    from ..operators import gates

    decision = F.when(F.col("confidence") < 0.2, "rejected").when(F.col("sensitivity_level") == "highly_sensitive", "needs_review").otherwise("accepted")
    return gates.summarize(m.facts.select("fact_id", decision.alias("decision")))


@query(
    f"""WITH e AS (SELECT CASE WHEN pinned OR fact_type IN ('core_identity', 'commitment') THEN lifecycle_status ELSE 'archived' END AS after, persona_id FROM facts
  WHERE valid_to IS NOT NULL AND valid_to <= TIMESTAMP '{NOW_COLUMN}' AND validity_status <> 'invalidated' AND visibility_status = 'visible')
SELECT persona_id, count(*) AS n_expired, count(*) FILTER (WHERE after = 'archived') AS n_archived FROM e GROUP BY 1""", ("facts",))
def retention_counts(m):
    done = M.expire(m.facts, now())
    return done.groupBy("persona_id").agg(F.count(F.lit(1)).alias("n_expired"), F.count_if(F.col("lifecycle_status") == "archived").alias("n_archived"))


@query(
    """WITH s AS (SELECT event_id, session_id, CASE WHEN access_type = 'retrieved' THEN 1 ELSE 0 END AS used FROM access_events)
SELECT event_id, coalesce(sum(used) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 0) <= 8 AS within_budget FROM s""", ("access_events",))
def semantic_call_budget(m):
    used = F.when(F.col("access_type") == "retrieved", 1).otherwise(0)
    last = W.partitionBy("session_id").orderBy("event_id").rowsBetween(-999, 0)
    return m.access_events.select("event_id", (F.sum(used).over(last) <= 8).alias("within_budget"))


@query(
    f"""WITH t AS (SELECT fact_id FROM facts WHERE {TARGETS}), l AS (SELECT link_type, count(*) AS n_links FROM links WHERE from_id IN (SELECT fact_id FROM t) OR (to_type = 'fact' AND to_id IN (SELECT fact_id FROM t)) GROUP BY 1)
SELECT link_type, n_links, (SELECT count(*) FROM t) AS n_facts FROM l""", ("facts", "links"))
def deletion_cascade_summary(m):
    hit = targets(m)
    a = m.links.join(hit.select(F.col("fact_id").alias("from_id")), "from_id", "left_semi")
    b = m.links.filter("to_type = 'fact'").join(hit.select(F.col("fact_id").alias("to_id")), "to_id", "left_semi").join(hit.select(F.col("fact_id").alias("from_id")), "from_id", "left_anti")
    per = a.select("link_type").unionAll(b.select("link_type")).groupBy("link_type").agg(F.count(F.lit(1)).alias("n_links"))
    # One row, from a global aggregate.
    return per.join(F.broadcast(hit.agg(F.count(F.lit(1)).alias("n_facts"))))


@query(
    f"""WITH r AS (SELECT 'fact' AS node_type, fact_id AS node_id, lifecycle_status AS state FROM facts WHERE {OPEN} UNION ALL SELECT 'entity', entity_id, 'active' FROM entities WHERE {OPEN}
  UNION ALL SELECT 'episode', episode_id, 'active' FROM episodes WHERE {OPEN})
SELECT node_type, state, count(*) AS n, count(DISTINCT node_id) AS n_ids FROM r GROUP BY 1, 2""", FACT_TABLES)
def mirror_rebuild_nodes(m):
    part = lambda df, kind, key, state: df.filter(OPEN).select(F.lit(kind).alias("node_type"), F.col(key).alias("node_id"), state.alias("state"))
    nodes = part(m.facts, "fact", "fact_id", F.col("lifecycle_status")).unionAll(part(m.entities, "entity", "entity_id", F.lit("active"))).unionAll(part(m.episodes, "episode", "episode_id", F.lit("active")))
    return nodes.groupBy("node_type", "state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("n_ids"))


@query(
    """WITH s AS (SELECT conv_id AS session_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY 1)
SELECT session_id, first_turn * 60 AS started_s, CASE WHEN last_turn > first_turn THEN last_turn * 60 END AS ended_s, n_user FROM s""")
def session_upsert(m):
    per = m.conversations.groupBy(F.col("conv_id").alias("session_id")).agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count_if(F.col("role") == "user").alias("n_user"))
    return per.select("session_id", (F.col("a") * 60).alias("started_s"), F.when(F.col("b") > F.col("a"), F.col("b") * 60).alias("ended_s"), "n_user")


ADJACENT = f"""ends AS (SELECT 'fact:' || from_id AS a, to_type || ':' || to_id AS b, direction, link_type, weight FROM links),
adj AS (SELECT DISTINCT a AS source, b AS target FROM ends WHERE direction IN ('forward', 'bidirectional') UNION SELECT b, a FROM ends WHERE direction IN ('backward', 'bidirectional'))"""


@query(
    f"""WITH {SEEDS}, {ADJACENT}, s AS (SELECT 'fact:' || fact_id AS node FROM seeds)
SELECT target AS node, min(source) AS via FROM adj WHERE source IN (SELECT node FROM s) AND target NOT IN (SELECT node FROM s) GROUP BY 1""", ("facts", "links"))
def activation_paths(m):
    """How each node next to the seeds is reached first: of equal hops the smallest source."""
    start = seeds(m).select(graph.node_key("fact", "fact_id").alias("source"))
    steps = graph.adjacency(m.links).select("source", "target").join(start, "source", "left_semi")
    fresh = steps.join(start.select(F.col("source").alias("target")), "target", "left_anti")
    return fresh.groupBy(F.col("target").alias("node")).agg(F.min("source").alias("via"))


@query(
    f"""WITH {AUTHORIZED}, g AS (SELECT persona_id, round(importance, 4) AS score, fact_id, predicate, row_number() OVER (PARTITION BY persona_id ORDER BY importance DESC, fact_id) AS r FROM auth)
SELECT persona_id, round(max(score) FILTER (WHERE r = 1) - coalesce(max(score) FILTER (WHERE r = 2), 0), 4) AS top_margin, round(count(DISTINCT predicate) / 6.0, 6) AS diversity FROM g WHERE r <= 8 GROUP BY 1""", FACT_TABLES)
def rank_margin_and_diversity(m):
    top = search.top_k(authorized(m), 8, [F.desc("importance"), F.asc("fact_id")], "persona_id")
    at = lambda r: F.max(F.when(F.col("rank_position") == r, F.round("importance", 4)))
    return top.groupBy("persona_id").agg(F.round(at(1) - F.coalesce(at(2), F.lit(0.0)), 4).alias("top_margin"), F.round(F.countDistinct("predicate") / 6.0, 6).alias("diversity"))


@query(f"WITH p AS (SELECT persona_id, count(*) FILTER (WHERE status = 'failed') AS bad FROM queue GROUP BY 1) SELECT fact_id FROM facts WHERE persona_id IN (SELECT persona_id FROM p WHERE bad * 4 <= (SELECT sum(bad) FROM p)) AND {OPEN}", ("facts", "queue"))
def mirror_ready_facts(m):
    """Facts of personas whose mirror is in order: no persona with more than a quarter of all failures."""
    per = m.queue.groupBy("persona_id").agg(F.count_if(F.col("status") == "failed").alias("bad"))
    total = per.agg(F.sum("bad").alias("total"))
    ready = per.join(F.broadcast(total)).filter(F.col("bad") * 4 <= F.col("total")).select("persona_id")
    return m.facts.filter(OPEN).join(ready, "persona_id", "left_semi").select("fact_id")


@query(
    f"""SELECT fact_id, CASE WHEN validity_status = 'invalidated' THEN 'historical; do not treat as current fact' ELSE '' END AS guidance FROM facts WHERE {OPEN}""", ("facts",))
def usage_guidance(m):
    from ..functions.scalars import usage_guidance as guidance

    return m.facts.filter(OPEN).select("fact_id", guidance(F.col("validity_status")).alias("guidance"))
