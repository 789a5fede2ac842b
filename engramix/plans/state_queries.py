"""Queries over state transitions, extraction gates, queues and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import object_key
from ..operators import gates
from ..operators import mutations as M

from .registry import query

KEY = "CASE WHEN object_entity_id IS NOT NULL THEN 'entity:' || object_entity_id ELSE 'literal:' || coalesce(trim(regexp_replace(lower(object_literal), '\\s+', ' ', 'g')), '') END"
SLOT = "PARTITION BY persona_id, subject_entity_id, predicate"
NOW_COLUMN = "1998-06-01 00:00:00"
TARGETS = "(fact_type = 'transient_context' AND sensitivity_level = 'highly_sensitive')"


def now():
    return F.lit(NOW_COLUMN).cast("timestamp_ntz")


@query(f"SELECT episode_id, session_id, lag(episode_id) OVER w AS prev_episode_id, lead(episode_id) OVER w AS next_episode_id FROM episodes WINDOW w AS (PARTITION BY session_id ORDER BY at_s, episode_id)", ("episodes",))
def episode_chain(m):
    return M.chain(m.episodes)


@query(
    """SELECT session_id, min(at_s) AS started_s, max(at_s) AS ended_s, count(*) AS n_episodes FROM episodes WHERE visibility_status = 'visible' AND searchable AND role IN ('user', 'assistant')
GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2, 1 LIMIT 25""", ("episodes",))
def eligible_sessions(m):
    """The oldest sessions due for extraction: the limit is the batch's size."""
    rows = m.episodes.filter("visibility_status = 'visible' AND searchable AND role IN ('user', 'assistant')")
    per = rows.groupBy("session_id").agg(F.min("at_s").alias("started_s"), F.max("at_s").alias("ended_s"), F.count(F.lit(1)).alias("n_episodes"))
    return per.filter("n_episodes >= 2").orderBy("started_s", "session_id").limit(25)


def decisions_sql(passing: str, held: str) -> str:
    """CTEs up to ``acted`` (fact_id, action): each row of ``passing`` against those of ``held`` and the earlier rows of its slot, pair by pair."""
    same = "a.persona_id = b.persona_id AND a.subject_entity_id = b.subject_entity_id AND a.predicate = b.predicate"
    return f"""hk AS (SELECT a.fact_id, count(*) > 0 AS held_any, coalesce(bool_or(a.object_key = b.object_key), false) AS held_key FROM {passing} a JOIN {held} b ON {same} GROUP BY 1),
ps AS (SELECT p.*, coalesce(held_any, false) AS held_any, coalesce(held_key, false) AS held_key, CAST(epoch(valid_from) AS HUGEINT) * 10000000000 + p.fact_id AS nth FROM {passing} p LEFT JOIN hk ON hk.fact_id = p.fact_id),
pv AS (SELECT a.fact_id, arg_max(b.object_key, b.nth) AS last_key, arg_min(b.object_key, b.nth) AS first_key, bool_or(a.object_key = b.object_key) AS met, bool_or(NOT b.held_key) AS replaced FROM ps a JOIN ps b ON {same} AND b.nth < a.nth GROUP BY 1),
ag AS (SELECT ps.*, last_key IS NOT NULL OR held_any AS any_held, CASE WHEN conflict_policy = 'supersede' AND coalesce(replaced, false) THEN last_key = object_key WHEN conflict_policy = 'supersede' THEN held_key
  WHEN conflict_policy = 'merge' THEN held_key OR (NOT held_any AND coalesce(first_key = object_key, false)) ELSE held_key OR coalesce(met, false) END AS again FROM ps LEFT JOIN pv ON pv.fact_id = ps.fact_id),
acted AS (SELECT fact_id, CASE WHEN again THEN 'reinforce' WHEN NOT any_held THEN 'insert' WHEN conflict_policy = 'supersede' THEN 'supersede' WHEN conflict_policy = 'coexist' THEN 'coexist' WHEN conflict_policy = 'merge' THEN 'needs_review' ELSE 'insert' END AS action FROM ag)"""


HELD = "fact_id % 4 = 0"
SEEN = "SELECT entity_id FROM entities WHERE visibility_status = 'visible'"


@query(
    f"""WITH src AS (SELECT from_id AS fact_id, count(*) AS n, count(*) FILTER (WHERE to_id IN (SELECT episode_id FROM episodes WHERE visibility_status = 'visible')) AS ok FROM links WHERE link_type = 'EVIDENCED_BY' GROUP BY 1),
k AS (SELECT f.*, {KEY} AS object_key, conflict_policy, object_kind, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok FROM facts f LEFT JOIN predicate_schemas s ON s.predicate = f.predicate LEFT JOIN src ON src.fact_id = f.fact_id),
held AS (SELECT * FROM k WHERE {HELD} AND validity_status = 'valid' AND visibility_status = 'visible' AND searchable),
c AS (SELECT *, CASE WHEN conflict_policy IS NULL OR (object_kind = 'entity' AND object_entity_id IS NULL) OR (object_kind = 'literal' AND object_literal IS NULL) THEN 'reject'
  WHEN subject_entity_id NOT IN ({SEEN}) OR (object_entity_id IS NOT NULL AND object_entity_id NOT IN ({SEEN})) THEN 'reject' WHEN ok < n OR (n = 0 AND NOT pinned) THEN 'reject' WHEN conflict_policy = 'llm_check' THEN 'needs_review' END AS gate
  FROM k WHERE NOT ({HELD})),
p AS (SELECT * FROM c WHERE gate IS NULL), {decisions_sql('p', 'held')}
SELECT fact_id, gate AS action FROM c WHERE gate IS NOT NULL UNION ALL SELECT fact_id, action FROM acted""", ("facts", "predicate_schemas", "entities", "links", "episodes"))
def consolidation_actions(m):
    """Three quarters of the facts as candidates against the rest as held."""
    visible = m.episodes.filter("visibility_status = 'visible'").select(F.col("episode_id").alias("to_id"), F.lit(1).alias("seen")).distinct()
    cited = m.links.filter("link_type = 'EVIDENCED_BY'").join(visible, "to_id", "left")
    sources = cited.groupBy(F.col("from_id").alias("fact_id")).agg(F.count(F.lit(1)).alias("n_sources"), F.count("seen").alias("n_seen_sources"))
    return M.consolidate(m.facts.filter(f"NOT ({HELD})"), m.predicate_schemas, m.facts.filter(HELD), m.entities, sources).select("fact_id", "action")


@query(
    f"""WITH p AS (SELECT f.*, {KEY} AS object_key, conflict_policy FROM facts f JOIN predicate_schemas s ON s.predicate = f.predicate WHERE f.predicate IN ('lives_in', 'likes', 'has_pet') AND (f.predicate <> 'has_pet' OR object_entity_id IS NOT NULL)),
held AS (SELECT * FROM p WHERE false), {decisions_sql('p', 'held')}
SELECT fact_id, CASE WHEN action = 'reinforce' THEN 'discard_duplicate' ELSE action END AS action FROM acted""", ("facts", "predicate_schemas"))
def consolidation_discard(m):
    """All facts of three predicates as candidates for an empty store; duplicates are discarded."""
    return M.consolidate(m.facts.filter(F.col("predicate").isin("lives_in", "likes", "has_pet")), m.predicate_schemas, discard=True).select("fact_id", "action")


@query(
    f"""WITH k AS (SELECT *, {KEY} AS k FROM facts WHERE predicate IN ('lives_in', 'works_at')), s AS (SELECT *, coalesce(lag(k) OVER ({SLOT} ORDER BY valid_from, fact_id) <> k, true) AS starts FROM k),
r AS (SELECT fact_id, lead(fact_id) OVER w AS superseded_by, lead(valid_from) OVER w AS superseded_at FROM s WHERE starts WINDOW w AS ({SLOT} ORDER BY valid_from, fact_id))
SELECT * FROM r WHERE superseded_by IS NOT NULL""", ("facts",))
def supersede_invalidation(m):
    return M.supersede(m.facts.filter(F.col("predicate").isin("lives_in", "works_at")))


@query(
    """SELECT fact_id, f.predicate, CASE WHEN conflict_policy = 'expire_by_time' AND valid_to IS NULL THEN valid_from + default_tau_days * INTERVAL '1' DAY ELSE valid_to END AS valid_to
FROM facts f JOIN predicate_schemas USING (predicate)""", ("facts", "predicate_schemas"))
def expiry_policy(m):
    rows = m.facts.join(F.broadcast(m.predicate_schemas), "predicate")
    due = F.expr("valid_from + default_tau_days * INTERVAL '1' DAY")
    return rows.select("fact_id", "predicate", F.when((F.col("conflict_policy") == "expire_by_time") & F.col("valid_to").isNull(), due).otherwise(F.col("valid_to")).alias("valid_to"))


@query(
    f"""SELECT fact_id, 'invalidated' AS validity_status, CASE WHEN pinned OR fact_type IN ('core_identity', 'commitment') THEN lifecycle_status ELSE 'archived' END AS lifecycle_status
FROM facts WHERE valid_to IS NOT NULL AND valid_to <= TIMESTAMP '{NOW_COLUMN}' AND validity_status <> 'invalidated' AND visibility_status = 'visible'""", ("facts",))
def retention_expiry(m):
    return M.expire(m.facts, now()).select("fact_id", "validity_status", "lifecycle_status")


@query(
    f"""SELECT fact_id, 'deep_archived' AS lifecycle_status FROM facts WHERE lifecycle_status = 'archived' AND NOT pinned AND fact_type NOT IN ('core_identity', 'commitment')
AND coalesce(valid_to, valid_from, created_at) <= TIMESTAMP '{NOW_COLUMN}' - INTERVAL '365' DAY""", ("facts",))
def deep_archive(m):
    return M.deep_archive(m.facts, now(), 365).select("fact_id", "lifecycle_status")


def targets(m):
    return m.facts.filter(TARGETS).select("fact_id")


@query(f"SELECT fact_id, CASE WHEN {TARGETS} THEN 'hidden' ELSE visibility_status END AS visibility_status, searchable AND NOT {TARGETS} AS searchable, pinned AND NOT {TARGETS} AS pinned FROM facts", ("facts",))
def soft_forget(m):
    return M.soft_forget(m.facts, targets(m)).select("fact_id", "visibility_status", "searchable", "pinned")


@query(
    f"""SELECT fact_id, CASE WHEN {TARGETS} THEN 'forgotten' ELSE visibility_status END AS visibility_status, CASE WHEN {TARGETS} THEN '[forgotten]' ELSE content_summary END AS content_summary,
  CASE WHEN {TARGETS} AND object_literal IS NOT NULL THEN '[forgotten]' ELSE object_literal END AS object_literal FROM facts""", ("facts",))
def hard_forget(m):
    return M.hard_forget(m.facts, targets(m)).select("fact_id", "visibility_status", "content_summary", "object_literal")


@query(
    """WITH c AS (SELECT from_id AS fact_id, to_id AS episode_id FROM links WHERE link_type = 'EVIDENCED_BY'), t AS (SELECT episode_id FROM episodes WHERE role = 'assistant')
SELECT fact_id FROM facts WHERE fact_id IN (SELECT fact_id FROM c WHERE episode_id IN (SELECT episode_id FROM t))
AND fact_id NOT IN (SELECT fact_id FROM c WHERE episode_id IN (SELECT episode_id FROM episodes WHERE visibility_status = 'visible' AND searchable AND role <> 'assistant'))""", ("facts", "links", "episodes"))
def redact_cascade(m):
    return M.redact_sources(m.episodes, m.links, m.facts, m.episodes.filter("role = 'assistant'").select("episode_id"))[1]


@query(
    f"""WITH t AS (SELECT fact_id FROM facts WHERE {TARGETS})
SELECT link_id, CASE WHEN visibility_status = 'visible' AND (from_id IN (SELECT fact_id FROM t) OR (to_type = 'fact' AND to_id IN (SELECT fact_id FROM t))) THEN 'purged' ELSE visibility_status END AS visibility_status FROM links""", ("facts", "links"))
def purge_cascade(m):
    return M.purge(m.facts, m.links, targets(m))[1].select("link_id", "visibility_status")


PURGED = "t AS (SELECT episode_id FROM episodes WHERE role = 'assistant' AND visibility_status = 'visible')"


def purged(m):
    return M.purge_episodes(m.episodes, m.links, m.episodes.filter("role = 'assistant' AND visibility_status = 'visible'").select("episode_id"))


@query(
    f"""WITH {PURGED}
SELECT episode_id, CASE WHEN episode_id IN (SELECT * FROM t) THEN '[redacted]' ELSE content END AS content, CASE WHEN episode_id IN (SELECT * FROM t) THEN 'purged' ELSE visibility_status END AS visibility_status,
  searchable AND episode_id NOT IN (SELECT * FROM t) AS searchable FROM episodes""", ("episodes",))
def purge_episodes(m):
    return purged(m)[0].select("episode_id", "content", "visibility_status", "searchable")


@query(
    f"""WITH {PURGED}, h AS (SELECT *, to_type = 'episode' AND to_id IN (SELECT * FROM t) AS hit FROM links)
SELECT link_id, CASE WHEN hit AND visibility_status = 'visible' THEN 'purged' ELSE visibility_status END AS visibility_status, searchable AND NOT hit AS searchable FROM h""", ("episodes", "links"))
def purge_episode_links(m):
    return purged(m)[1].select("link_id", "visibility_status", "searchable")


@query(
    f"""WITH {PURGED}, c AS (SELECT from_id AS fact_id, to_id AS episode_id FROM links WHERE link_type = 'EVIDENCED_BY'),
o AS (SELECT episode_id FROM episodes WHERE visibility_status = 'visible' AND searchable AND episode_id NOT IN (SELECT * FROM t))
SELECT DISTINCT fact_id FROM c WHERE episode_id IN (SELECT * FROM t) AND fact_id NOT IN (SELECT fact_id FROM c WHERE episode_id IN (SELECT * FROM o))""", ("episodes", "links"))
def purge_episode_facts(m):
    return purged(m)[2]


@query(
    f"""WITH t AS (SELECT fact_id FROM facts WHERE {TARGETS})
SELECT link_id, CASE WHEN NOT (from_id IN (SELECT * FROM t) OR (to_type = 'fact' AND to_id IN (SELECT * FROM t))) THEN concat('because of ', to_id) END AS reasoning FROM links""", ("facts", "links"))
def forgotten_reasoning(m):
    reasoned = m.links.withColumn("reasoning", F.concat(F.lit("because of "), F.col("to_id").cast("string")))
    return M.scrub_reasoning(reasoned, targets(m)).select("link_id", "reasoning")


REASON = """CASE WHEN visibility_status <> 'visible' THEN 'not_visible' WHEN validity_status = 'invalidated' THEN 'invalidated' WHEN pinned THEN 'pinned'
  WHEN fact_type IN ('core_identity', 'commitment') THEN 'protected_type' WHEN lifecycle_status IN ('consolidated', 'archived', 'deep_archived') THEN 'lifecycle' WHEN sensitivity_level = 'highly_sensitive' THEN 'sensitive' END"""


@query(f"SELECT fact_id, {REASON} AS reason FROM facts", ("facts",))
def compression_eligibility(m):
    return m.facts.select("fact_id", M.compression_reason().alias("reason"))


@query(f"SELECT persona_id, subject_entity_id, count(*) AS n_sources, round(avg(importance), 6) AS importance FROM facts WHERE {REASON} IS NULL GROUP BY 1, 2 HAVING count(*) >= 2", ("facts",))
def compression_apply(m):
    return M.compress(m.facts)


@query("SELECT queue_id, priority, rank_position FROM (SELECT queue_id, priority, row_number() OVER (ORDER BY priority, created_at, queue_id) AS rank_position FROM queue WHERE status IN ('pending', 'failed')) WHERE rank_position <= 100", ("queue",))
def queue_claim_topk(m):
    from ..operators.search import top_k

    claimed = M.claim(m.queue, 100)
    return top_k(claimed, 100, [F.asc("priority"), F.asc("created_at"), F.asc("queue_id")], []).select("queue_id", "priority", "rank_position")


@query(
    """SELECT queue_id, CASE WHEN status = 'processing' AND created_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '15' MINUTE THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'processing' AND created_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '15' MINUTE THEN attempts + 1 ELSE attempts END AS attempts FROM queue""", ("queue",))
def queue_lease_expiry(m):
    return M.expire_leases(m.queue, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("queue_id", "status", "attempts")


LEASED = """lq AS (SELECT * REPLACE (CASE WHEN status = 'processing' AND created_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '15' MINUTE THEN attempts + 1 ELSE attempts END AS attempts,
  CASE WHEN status = 'processing' AND created_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '15' MINUTE THEN 'failed' ELSE status END AS status) FROM queue)"""


@query(
    f"""WITH {LEASED}, o AS (SELECT queue_id, row_number() OVER (ORDER BY priority, created_at, queue_id) AS r FROM lq WHERE status IN ('pending', 'failed'))
SELECT lq.queue_id, CASE WHEN r <= 100 THEN 'processing' ELSE status END AS status, attempts, r IS NOT NULL AND r <= 100 AS leased FROM lq LEFT JOIN o USING (queue_id)""", ("queue",))
def queue_claim_lease(m):
    """The queue after a worker took a hundred rows."""
    rows = M.claimed(m.queue, 100, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return rows.select("queue_id", "status", "attempts", F.col("leased_at").isNotNull().alias("leased"))


@query(
    f"""WITH {LEASED}, j AS (SELECT *, CASE WHEN persona_id IN (SELECT persona_id FROM lq WHERE status = 'processing') THEN 'refused' WHEN status IN ('pending', 'failed') THEN 'superseded' ELSE 'kept' END AS rebuild FROM lq)
SELECT persona_id, rebuild, CASE WHEN rebuild = 'superseded' THEN 'done' ELSE status END AS status, count(*) AS n FROM j GROUP BY 1, 2, 3""", ("queue",))
def queue_rebuild(m):
    """What a rebuild of every persona does to the rows that wait."""
    rows = M.superseded_by_rebuild(m.queue, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy("persona_id", "rebuild", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT persona_id, operation, count(*) FILTER (WHERE status = 'done') AS n_done, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) AS n FROM queue GROUP BY 1, 2", ("queue",))
def queue_summary(m):
    s = F.col("status")
    return m.queue.groupBy("persona_id", "operation").agg(F.count_if(s == "done").alias("n_done"), F.count_if(s == "failed").alias("n_failed"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH k AS (SELECT f.*, {KEY} AS k, conflict_policy FROM facts f LEFT JOIN predicate_schemas USING (predicate)),
g AS (SELECT fact_id, CASE WHEN conflict_policy IS NULL THEN 'rejected:unknown_predicate' WHEN subject_entity_id IS NULL OR subject_entity_id NOT IN (SELECT entity_id FROM entities) THEN 'rejected:unknown_subject'
  WHEN confidence < 0.2 THEN 'rejected:low_confidence' WHEN k = 'literal:' THEN 'rejected:empty_object' WHEN conflict_policy IN ('llm_check', 'merge') THEN 'needs_review:policy'
  WHEN sensitivity_level = 'highly_sensitive' THEN 'needs_review:sensitive' ELSE 'accepted' END AS d FROM k)
SELECT fact_id, d AS decision FROM g""", ("facts", "predicate_schemas", "entities"))
def extraction_gates(m):
    return gates.validate_facts(m.facts, m.predicate_schemas, m.entities).select("fact_id", "decision")


@query(
    """WITH e AS (SELECT session_id, episode_id, role, content, at_s FROM episodes WHERE visibility_status = 'visible' AND searchable AND role <> 'system')
SELECT session_id, count(*) AS n_episodes, sha256(string_agg(episode_id || ':' || role, ',' ORDER BY at_s, episode_id)) AS fingerprint FROM e GROUP BY 1""", ("episodes",))
def extraction_request(m):
    return gates.build_requests(m.episodes).select("session_id", "n_episodes", "fingerprint")


@query(
    """WITH e AS (SELECT episode_id, lower(content) AS c, role, length(content) AS n FROM episodes)
SELECT episode_id, CASE WHEN contains(c, 'remember') OR contains(c, 'never') OR contains(c, 'forget') THEN 'must_keep' WHEN role = 'system' THEN 'drop' WHEN n < 20 THEN 'drop' ELSE 'keep' END AS route FROM e""", ("episodes",))
def extraction_prefilter(m):
    return gates.prefilter(m.episodes).select("episode_id", "route")


@query(
    """SELECT node_id, session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY retrieval_score DESC NULLS LAST, event_id) AS k FROM access_events) WHERE k = 1""", ("access_events",))
def best_access_per_node(m):
    best = F.max(F.struct("retrieval_score", (-F.col("event_id")).alias("e"), "session_id")).alias("b")
    return m.access_events.groupBy("node_id").agg(best).select("node_id", F.col("b.session_id").alias("session_id"), (-F.col("b.e")).alias("event_id"))


@query(
    f"""SELECT fact_id, {KEY} AS object_key, valid_from <= TIMESTAMP '{NOW_COLUMN}' AND TIMESTAMP '{NOW_COLUMN}' < coalesce(valid_to, TIMESTAMP '9999-01-01 00:00:00') AS holds FROM facts""", ("facts",))
def as_of_facts(m):
    at = now()
    end = F.coalesce("valid_to", F.lit("9999-01-01 00:00:00").cast("timestamp_ntz"))
    return m.facts.select("fact_id", object_key(F.col("object_entity_id"), F.col("object_literal")).alias("object_key"), ((F.col("valid_from") <= at) & (at < end)).alias("holds"))


