"""Retrieval of facts for a batch of questions, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as Q
from ..operators import context, fusion
from ..operators import recall as retrieval
from ..operators.authority import visible_at
from ..sources.scratch import stored
from .authority_queries import AUTHORIZED, FACT_TABLES, RANK
from .ranking_queries import CITED, MULT, NOW, OPEN
from .registry import query
from .selection_sql import insert_sql, mmr_sql
from .text_queries import FIELDS, TOKENS


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SPACED = r"' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' '"
#: The facts that may be shown to a question that allows history; ``past`` ones to no other.
SHOWN = (
    AUTHORIZED.replace("AND f.validity_status <> 'invalidated' AND f.lifecycle_status NOT IN ('archived', 'deep_archived')", "AND f.lifecycle_status <> 'deep_archived'")
    + """, shown AS (SELECT *, validity_status = 'invalidated' OR lifecycle_status = 'archived' AS past, lower(concat_ws(' ', predicate, fact_type, content_summary, object_literal)) AS low FROM auth)"""
)
NOTED = f"""qn AS (SELECT *, trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) AS t, list_distinct({FIELDS.format('query_text')}) AS ts FROM questions),
qb AS (SELECT *, {Q.ability_sql('t')} AS ability, {Q.need_sql('t')} AS need, ',' || {Q.signals_sql('t')} || ',' AS s, NOT {Q.DELETING.sql('t')} AS anchored FROM qn),
qa AS (SELECT *, anchored AND ability IN {_in(Q.PINNED_ABILITIES)} AS g_pinned, anchored AND ability IN {_in(Q.RECENT_ABILITIES)} AS g_recent,
  anchored AND ((ability IN ('relationship_arc', 'dynamic_state') AND need IN ('state_transition', 'relationship_timeline')) OR ability IN {_in(Q.NARRATIVE_ABILITIES)}) AS g_narrative,
  ability = 'direct_fact' OR contains(s, ',past_event_direct_fact,') AS protects, ability = 'premise_check' AND need = 'premise_counterexample' AS premise,
  contains(s, ',past_event_direct_fact,') OR contains(s, ',event_bundle,') AS bundled, ability = 'causal_explain' OR contains(s, ',causal,') OR contains(s, ',causal_chain,') AS causal,
  need = 'provenance_source' OR contains(s, ',provenance_source,') OR contains(s, ',provenance,') AS sourced, contains(s, ',reflection_summary,') AS reflective,
  allow_historical AND NOT (ability = 'premise_check' AND need = 'premise_counterexample') AND (need = 'state_transition' OR contains(s, ',state_transition,')) AS transition FROM qb)"""
UNIT = "list_transform({0}, lambda x: CAST(x AS DOUBLE))"
HITS = f"""{SHOWN}, {NOTED}, op AS (SELECT * FROM qa WHERE anchored),
qv AS (SELECT query_id, persona_id, {UNIT.format('embedding')} AS q FROM op JOIN fact_vectors ON fact_id = query_id),
fv AS (SELECT f.fact_id, f.persona_id, {UNIT.format('embedding')} AS v FROM fact_vectors JOIN facts f USING (fact_id)),
mc AS (SELECT query_id, fact_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM qv JOIN fv USING (persona_id)),
mr AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS r FROM mc WHERE score > 0 QUALIFY r <= 40),
tq AS (SELECT DISTINCT query_id, persona_id, allow_historical, unnest({TOKENS.format('query_text')}) AS term FROM op),
td AS (SELECT fact_id, persona_id, past, {TOKENS.format('content_summary')} AS ws FROM shown), tt AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM td),
tp AS (SELECT term, fact_id, persona_id, past, dl, count(*) AS tf FROM (SELECT fact_id, persona_id, past, len(ws) AS dl, unnest(ws) AS term FROM td) GROUP BY ALL), tf AS (SELECT term, count(*) AS df FROM tp GROUP BY 1),
tw AS (SELECT query_id, fact_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
  FROM tq JOIN tp ON tp.term = tq.term AND tp.persona_id = tq.persona_id AND (NOT past OR allow_historical) JOIN tf ON tf.term = tq.term, tt GROUP BY 1, 2),
ee AS (SELECT entity_id, canonical_name FROM entities WHERE {OPEN} AND sensitivity_level = 'normal'),
en AS (SELECT entity_id, canonical_name AS name, 'entity_exact' AS source FROM ee UNION ALL SELECT entity_id, alias, 'alias_match' FROM entity_aliases JOIN ee USING (entity_id)),
em AS (SELECT DISTINCT query_id, persona_id, allow_historical, entity_id, source FROM op, en WHERE contains({SPACED.format('query_text')}, {SPACED.format('name')})),
ab AS (SELECT DISTINCT query_id, source, fact_id, importance, created_at FROM em JOIN shown f ON f.persona_id = em.persona_id AND (subject_entity_id = entity_id OR object_entity_id = entity_id) WHERE NOT past OR allow_historical),
lv AS (SELECT f.*, h FROM shown f, (VALUES (FALSE), (TRUE)) AS v(h) WHERE NOT past OR h),
pk AS (SELECT persona_id, h, fact_id, row_number() OVER (PARTITION BY persona_id, h ORDER BY importance DESC, created_at DESC, fact_id) AS r FROM lv WHERE pinned AND fact_type IN {_in(retrieval.CORE_TYPES)}),
ri AS (SELECT persona_id, h, fact_id, row_number() OVER (PARTITION BY persona_id, h ORDER BY created_at DESC, importance DESC, fact_id) AS r FROM lv WHERE importance >= 0.7 AND lifecycle_status IN ('active', 'dormant', 'consolidated')),
nv AS (SELECT persona_id, h, node_type, node_id, lower(search_text) AS doc, row_number() OVER (PARTITION BY persona_id, h ORDER BY updated_s DESC, node_type, node_id) AS place
  FROM narratives, (VALUES (FALSE), (TRUE)) AS v(h) WHERE {OPEN} AND sensitivity_level = 'normal' AND lifecycle_status <> 'deep_archived' AND (lifecycle_status <> 'archived' OR h) QUALIFY place <= 30),
nm AS (SELECT query_id, node_type, node_id, place, round(CASE WHEN contains(doc, t) THEN 1.0 ELSE len(list_filter(ts, lambda x: contains(doc, x))) / CAST(len(ts) AS DOUBLE) END, 6) AS match
  FROM qa JOIN nv ON nv.persona_id = qa.persona_id AND h = allow_historical WHERE g_narrative),
nh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM nm WHERE match > 0),
hits AS (SELECT query_id, 'dense' AS source, 'fact' AS node_type, fact_id AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank_position
    FROM mr JOIN op USING (query_id) JOIN shown f USING (fact_id) WHERE f.persona_id = op.persona_id AND (NOT past OR allow_historical)
  UNION ALL SELECT query_id, 'fts', 'fact', fact_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) FROM tw
  UNION ALL SELECT query_id, source, 'fact', fact_id, row_number() OVER (PARTITION BY query_id, source ORDER BY importance DESC, created_at DESC, fact_id) FROM ab
  UNION ALL SELECT query_id, 'pinned_core', 'fact', fact_id, r FROM op JOIN pk ON pk.persona_id = op.persona_id AND h = allow_historical WHERE g_pinned AND r <= 30
  UNION ALL SELECT query_id, 'recent_important', 'fact', fact_id, r FROM op JOIN ri ON ri.persona_id = op.persona_id AND h = allow_historical WHERE g_recent AND r <= 30
  UNION ALL SELECT query_id, 'narrative_insight', node_type, node_id, r FROM nh),
ah AS (SELECT * FROM hits WHERE rank_position <= 40)"""
ANCHOR_TABLES = (*FACT_TABLES, "entity_aliases", "questions", "narratives", "narrative_links", "fact_vectors")


def mirror_hits(m, asked):
    """What the vector search of each question finds in its persona's facts; whether they may be shown is asked later."""
    known = m.fact_vectors.join(m.facts.select("fact_id", "persona_id"), "fact_id").select(F.col("fact_id").alias("vec_id"), F.col("persona_id").alias("space"), "embedding")
    vectors = asked.filter("anchored").select("query_id", F.col("persona_id").alias("space")).join(m.fact_vectors.withColumnRenamed("fact_id", "query_id"), "query_id")
    wanted = vectors.select("query_id", F.lit("raw").alias("variant"), F.lit(1.0).alias("weight"), "space", F.col("embedding").alias("q"))
    return fusion.dense_top_k(wanted, known, retrieval.MIRROR_HITS).select("query_id", F.col("vec_id").alias("fact_id"), "rank_position")


class Recall:
    """The steps of a retrieval over the model; what several later steps need is written once."""

    def __init__(self, m):
        self.m, self.now = m, F.lit(NOW).cast("timestamp_ntz")
        self.asked = stored(retrieval.noted(m.questions))
        self.facts = stored(retrieval.shown_facts(m.facts, m.entities, m.links, m.episodes))
        self.fatigue = m.access_events.filter("access_type = 'retrieved'").groupBy("session_id", F.col("node_id").alias("fact_id")).agg(F.count(F.lit(1)).alias("fatigue_count"))

    def hits(self):
        m = self.m
        return retrieval.anchor_hits(self.asked, self.facts, m.entities.filter(visible_at(0)), m.entity_aliases, m.narratives, mirror_hits(m, self.asked))

    def score(self, found):
        return retrieval.score(found, self.asked, self.facts, self.fatigue, self.now)

    def scored(self):
        m = self.m
        found = stored(retrieval.candidates(stored(self.hits()), m.links))
        first = stored(self.score(found.withColumns({"bonus": F.lit(0.0), "rule": F.lit(None).cast("string")})))
        added = retrieval.completions(self.asked, first, self.facts, m.links, m.episodes, m.entities, m.narratives, m.narrative_links)
        return stored(self.score(retrieval.completed(found, added)))

    def selected(self, scored, budget: int = 1200):
        picked = stored(retrieval.select(scored, retrieval.cited(self.m.links), budget=budget))
        return retrieval.with_superseded(picked, scored, self.asked, self.facts, self.m.links, self.fatigue, self.now)


@query(f"WITH {HITS} SELECT query_id, source, node_type, node_id, rank_position FROM ah", ANCHOR_TABLES)
def anchor_sources(m):
    """Six sources of anchors over what each question may be shown."""
    return Recall(m).hits().select("query_id", "source", "node_type", "node_id", "rank_position")


def scores_sql(name: str, rows: str) -> str:
    """All fifteen terms of the candidates ``rows`` (query_id, fact_id, anchor, graph, sources, bonus, rule)."""
    return f"""{name}_t AS (SELECT c.*, f.*, qa.* EXCLUDE (query_id, persona_id), coalesce(fatigue, 0) > 0 AS suppressed,
    round(CASE WHEN contains(lower(content_summary), t) THEN 1.0 ELSE len(list_filter(ts, lambda x: contains(lower(content_summary), x))) / CAST(len(ts) AS DOUBLE) END, 6) AS lexical,
    list_filter(ts, lambda x: length(x) >= 2 AND x NOT IN {_in(context.LOW_TERMS)} AND regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+')) AS slots
  FROM {rows} c JOIN qa ON qa.query_id = c.query_id JOIN shown f ON f.fact_id = c.fact_id AND f.persona_id = qa.persona_id AND (NOT past OR allow_historical)
  LEFT JOIN fg ON fg.session_id = qa.session_id AND fg.fact_id = c.fact_id),
{name}_s AS (SELECT *, CASE WHEN len(slots) = 0 THEN 0.0 ELSE len(list_filter(slots, lambda x: contains(low, x))) / CAST(len(slots) AS DOUBLE) END AS slot,
    premise AND {Q.words(*context.REPEATING).sql('low')} AND NOT {Q.words(*context.POSITIVE_MARKERS, *context.TAKING_BACK).sql('low')} AS restates,
    lower(concat_ws(' ', content_summary, predicate)) AS hub_text FROM {name}_t),
{name} AS (SELECT *, round((0.55 * anchor + 0.25 * graph + 0.20 * importance
    + 0.10 * (CASE WHEN date_diff('second', created_at, TIMESTAMP '{NOW}') <= 0 THEN 1.0 ELSE 1 / (1 + date_diff('second', created_at, TIMESTAMP '{NOW}') / 86400.0 / 30) END)
    + 0.10 * (CASE fact_type WHEN 'core_identity' THEN 1.0 WHEN 'stable_preference' THEN 0.8 WHEN 'relational_state' THEN 0.8 WHEN 'commitment' THEN 0.7 ELSE 0.5 END)
    + 0.10 * (0.45 * (CASE WHEN confidence > 0 THEN confidence ELSE 0.5 END) + 0.25 * least(1.0, ln(1 + n_allowed) / ln(4)) + 0.20 * (CASE WHEN n_allowed > 0 THEN 1.0 WHEN pinned THEN 0.5 ELSE 0.0 END) + 0.10 * least(1.0, ln(1 + reinforcement_count) / ln(4)))
    + (CASE WHEN pinned THEN 0.05 ELSE 0.0 END) + 0.12 * lexical + (CASE WHEN protects THEN 0.16 * slot ELSE 0.0 END)
    + (CASE WHEN NOT reflective THEN 0.0 WHEN {Q.words(*context.REFLECTION_MARKERS).sql('low')} THEN 0.30 WHEN list_contains(sources, 'narrative_insight') THEN 0.20 ELSE 0.0 END)
    + bonus + (CASE WHEN premise AND {Q.words(*context.CONTRADICTING).sql('low')} THEN 0.20 ELSE 0.0 END)
    + (CASE WHEN ability IN ('relationship_arc', 'dynamic_state') AND need IN ('state_transition', 'relationship_timeline') AND (fact_type = 'relational_state' OR {Q.words(*context.OUTCOMES).sql('low')}) THEN 0.22 ELSE 0.0 END)
    - (CASE WHEN protects AND NOT reflective AND coalesce(rule, '') <> 'event_bundle' AND slot < 0.5 AND lexical < 0.75
        AND (fact_type IN ('relational_state', 'core_identity') OR {Q.words(*context.HUB_MARKERS).sql('hub_text')} OR list_contains(sources, 'recent_important')) THEN 0.45 ELSE 0.0 END)
    - (CASE WHEN restates THEN 1.0 ELSE 0.0 END) - (CASE WHEN suppressed THEN 0.6 ELSE 0.0 END))
    * (CASE lifecycle_status WHEN 'consolidated' THEN 0.92 WHEN 'dormant' THEN 0.82 WHEN 'archived' THEN 0.55 ELSE 1.0 END), 6) AS score FROM {name}_s)"""


SCORED = f"""{HITS}, fu AS (SELECT query_id, node_type, node_id, sum(CASE source WHEN 'entity_exact' THEN 2.0 WHEN 'pinned_core' THEN 1.8 WHEN 'alias_match' THEN 1.6 WHEN 'recent_important' THEN 1.2 WHEN 'narrative_insight' THEN 1.1 ELSE 1.0 END / (60 + rank_position)) AS s FROM ah GROUP BY 1, 2, 3),
fr AS (SELECT *, s / max(s) OVER (PARTITION BY query_id) * CASE node_type WHEN 'narrative' THEN 0.9 WHEN 'insight' THEN 1.1 ELSE 1.0 END AS energy, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, node_type, node_id) AS place FROM fu),
fa AS (SELECT query_id, node_type, node_id, round(energy, 6) AS anchor FROM fr WHERE place <= 80),
ln AS (SELECT 'fact:' || from_id AS a, to_type || ':' || to_id AS b, direction, link_type, weight FROM links WHERE {OPEN}),
ad AS (SELECT a AS source, b AS target, link_type, weight FROM ln WHERE direction IN ('forward', 'bidirectional') UNION ALL SELECT b, a, link_type, weight FROM ln WHERE direction IN ('backward', 'bidirectional')),
dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ln UNION ALL SELECT b FROM ln) GROUP BY 1),
sh AS (SELECT source, target, 0.7 * greatest(weight, 0.0) * {MULT} / power(greatest(degree, 1), 0.5) AS share FROM ad JOIN dg ON node = target WHERE greatest(weight, 0.0) * {MULT} > 0),
g0 AS (SELECT query_id, node_type || ':' || node_id AS node, anchor AS energy FROM fa WHERE anchor > 0),
g1 AS (SELECT query_id, target AS node, energy * share AS energy FROM g0 JOIN sh ON source = node WHERE energy * share >= 0.01),
g2 AS (SELECT query_id, target AS node, e * share AS energy FROM (SELECT query_id, node, max(energy) AS e FROM g1 GROUP BY 1, 2) JOIN sh ON source = node WHERE e * share >= 0.01),
gt AS (SELECT query_id, node, round(least(1.0, sum(energy)), 6) AS energy FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY 1, 2 HAVING sum(energy) >= 0.01),
gr AS (SELECT query_id, CAST(substr(node, 6) AS BIGINT) AS fact_id, energy FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY energy DESC, node) AS r FROM gt) WHERE r <= 80 AND starts_with(node, 'fact:')),
so AS (SELECT query_id, node_id AS fact_id, list(DISTINCT source) AS sources FROM ah WHERE node_type = 'fact' GROUP BY 1, 2),
cd AS (SELECT query_id, fact_id, coalesce(anchor, 0.0) AS anchor, coalesce(energy, 0.0) AS graph, coalesce(sources, []) AS sources
  FROM (SELECT query_id, node_id AS fact_id, anchor FROM fa WHERE node_type = 'fact') FULL JOIN gr USING (query_id, fact_id) LEFT JOIN so USING (query_id, fact_id)),
fg AS (SELECT session_id, node_id AS fact_id, count(*) AS fatigue FROM access_events WHERE access_type = 'retrieved' GROUP BY 1, 2),
c1 AS (SELECT *, 0.0 AS bonus, CAST(NULL AS VARCHAR) AS rule FROM cd), {scores_sql('s1', 'c1')},
{CITED}, pl AS (SELECT DISTINCT fact_id, session_id, at_s FROM cited JOIN episodes USING (episode_id)),
ae AS (SELECT DISTINCT from_id AS fact_id, to_id AS entity_id FROM links WHERE link_type = 'ABOUT_ENTITY' AND {OPEN} AND to_id IN (SELECT entity_id FROM ee)),
lf AS (SELECT from_id AS a, to_id AS b, link_type FROM links WHERE {OPEN} AND to_type = 'fact'),
sd AS (SELECT query_id, fact_id AS seed, lexical, n_allowed, transition, bundled, causal, sourced FROM s1 WHERE NOT suppressed),
fo AS (SELECT query_id, seed, b AS fact_id, 'historical' AS rule, -1 AS place, CAST(0.0 AS DOUBLE) AS priority, CAST(0.18 AS DOUBLE) AS bonus FROM sd JOIN lf ON a = seed WHERE transition AND link_type = 'SUPERSEDES'
  UNION ALL SELECT query_id, seed, y.fact_id, 'event_bundle', -2, 0.0, 0.18 FROM sd JOIN cited x ON x.fact_id = seed JOIN cited y USING (episode_id) WHERE bundled
  UNION ALL SELECT query_id, seed, y.fact_id, 'event_bundle', -2, 0.0, 0.18 FROM sd JOIN pl x ON x.fact_id = seed JOIN pl y ON x.session_id = y.session_id AND abs(x.at_s - y.at_s) <= 7200 WHERE bundled
  UNION ALL SELECT query_id, seed, y.fact_id, 'event_bundle', -2, 0.0, 0.18 FROM sd JOIN ae x ON x.fact_id = seed JOIN ae y USING (entity_id) WHERE bundled
  UNION ALL SELECT query_id, seed, CASE WHEN a = seed THEN b ELSE a END, 'causal', -3, 0.0, 0.36 FROM sd JOIN lf ON a = seed OR b = seed WHERE causal AND link_type IN ('CAUSED_BY', 'EXPLAINS', 'TRIGGERED_BY')
  UNION ALL SELECT query_id, NULL, seed, 'provenance', -4, 0.0, 0.18 FROM sd WHERE sourced AND lexical > 0 AND n_allowed > 0
  UNION ALL SELECT query_id, NULL, fact_id, 'narrative', -5, round(match * abs(weight), 6), 0.18 FROM nh JOIN narrative_links l ON l.node_type = nh.node_type AND l.node_id = nh.node_id
    WHERE {OPEN} AND link_type IN {_in(retrieval.NARRATIVE_LINKS)} AND (outbound OR link_type IN {_in(retrieval.NARRATIVE_INBOUND)})),
fb AS (SELECT query_id, fact_id, bonus, priority, rule FROM fo WHERE seed IS NULL OR seed <> fact_id QUALIFY row_number() OVER (PARTITION BY query_id, fact_id ORDER BY bonus DESC, priority DESC, place DESC) = 1),
fd AS (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bonus DESC, priority DESC, rule, fact_id) <= 24),
fk AS (SELECT fd.query_id, fd.fact_id, bonus, rule FROM fd JOIN qa ON qa.query_id = fd.query_id JOIN shown f ON f.fact_id = fd.fact_id AND f.persona_id = qa.persona_id AND (NOT past OR allow_historical)
  QUALIFY row_number() OVER (PARTITION BY fd.query_id ORDER BY bonus DESC, priority DESC, rule, fd.fact_id) <= 12),
c2 AS (SELECT query_id, fact_id, coalesce(anchor, 0.0) AS anchor, coalesce(graph, 0.0) AS graph, coalesce(sources, []) AS sources, coalesce(bonus, 0.0) AS bonus, rule FROM cd FULL JOIN fk USING (query_id, fact_id)), {scores_sql('sc', 'c2')}"""


def scored(m):
    """The candidates that may be selected, with their terms."""
    return Recall(m).scored().filter("NOT suppressed AND score >= 0.2")


@query(f"WITH {SCORED} SELECT query_id, fact_id, round(slot, 6) AS slot_coverage, bonus, rule, suppressed, score FROM sc", (*ANCHOR_TABLES, "access_events"))
def retrieval_scores(m):
    """Fused anchors, what their energy reaches and what completions add, scored by all terms."""
    return Recall(m).scored().select("query_id", "fact_id", F.round("slot", 6).alias("slot_coverage"), "bonus", "rule", "suppressed", "score")


#: The replaced facts of each fact, as ``sp`` (source_id, fact_id, weight, link_id).
SUPERSEDED = f"sp AS (SELECT from_id AS source_id, to_id AS fact_id, weight, link_id FROM links WHERE {OPEN} AND link_type = 'SUPERSEDES' AND to_type = 'fact' AND from_id <> to_id)"
SELECTED = f"""{SCORED}, {mmr_sql("SELECT * FROM sc WHERE NOT suppressed AND score >= 0.2")}, {SUPERSEDED},
kn AS (SELECT query_id, fact_id, lexical > 0 OR slot > 0 OR coalesce(rule, '') = 'historical' OR graph > 0 OR len(list_filter(sources, lambda x: x NOT IN {_in(retrieval.BROAD_SOURCES)})) > 0 AS eligible,
  coalesce(rule, '') = 'historical' AS historical, suppressed FROM sc WHERE transition),
mk AS (SELECT p.*, coalesce(eligible, FALSE) AS eligible, coalesce(historical, FALSE) AS historical FROM picked p LEFT JOIN kn USING (query_id, fact_id)),
ot AS (SELECT mk.query_id, source_id, sp.fact_id, weight, link_id, kn.suppressed FROM mk JOIN sp ON source_id = mk.fact_id JOIN qa ON qa.query_id = mk.query_id
  JOIN shown f ON f.fact_id = sp.fact_id AND f.persona_id = qa.persona_id AND (NOT past OR allow_historical)
  LEFT JOIN kn ON kn.query_id = mk.query_id AND kn.fact_id = sp.fact_id LEFT JOIN fg ON fg.session_id = qa.session_id AND fg.fact_id = sp.fact_id WHERE mk.eligible AND coalesce(fatigue, 0) = 0),
os AS (SELECT query_id, source_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY source_id, abs(weight) DESC, link_id, fact_id) AS n FROM ot),
{insert_sql('mk', 'os')}"""
SELECTED_TABLES = (*ANCHOR_TABLES, "access_events")


@query(f"WITH RECURSIVE {SELECTED} SELECT query_id, fact_id, rank_position FROM done", SELECTED_TABLES)
def memory_retrieval(m):
    """Questions to ranked facts: anchors, fusion, energy, completions, score, greedy selection under budget, and the facts that the selected ones replaced."""
    steps = Recall(m)
    return steps.selected(steps.scored())


CONTEXT_BUDGET = 300
RELATIONS = _in(context.CAUSAL_RELATIONS + context.HISTORY_RELATIONS)
CONTEXT = f"""mi AS (SELECT d.query_id, d.fact_id, d.rank_position, qa.persona_id, allow_historical, ability, need, s, content_summary
  FROM done d JOIN qa ON qa.query_id = d.query_id JOIN shown f ON f.fact_id = d.fact_id AND f.persona_id = qa.persona_id),
ty AS (SELECT * FROM links WHERE {OPEN} AND to_type = 'fact' AND from_id <> to_id AND link_type IN {RELATIONS}),
tb AS (SELECT from_id AS fact_id, to_id AS other_id, link_type, weight, link_id, 'outbound' AS way FROM ty UNION ALL SELECT to_id, from_id, link_type, weight, link_id, 'inbound' FROM ty),
ne AS (SELECT mi.query_id, mi.fact_id, other_id, link_type, weight, link_id, way, CAST(length(f.content_summary) // 2 + 8 AS BIGINT) AS cost FROM mi JOIN tb ON tb.fact_id = mi.fact_id
  JOIN shown f ON f.fact_id = other_id AND f.persona_id = mi.persona_id AND (NOT past OR allow_historical)),
rf AS (SELECT fact_id, episode_id, row_number() OVER (PARTITION BY fact_id ORDER BY at_s, episode_id) AS r FROM (SELECT DISTINCT from_id AS fact_id, to_id AS episode_id FROM links WHERE link_type = 'EVIDENCED_BY' AND {OPEN})
  JOIN episodes USING (episode_id) WHERE {OPEN} AND sensitivity_level = 'normal' QUALIFY r <= 2),
rn AS (SELECT fact_id, count(*) AS n FROM rf GROUP BY 1),
bk AS (SELECT mi.*, coalesce(n, 0) AS n_sources, ability = 'direct_fact' OR need = 'exact_observation' OR contains(s, ',exact_fact,') OR contains(s, ',past_event_direct_fact,') AS direct,
  EXISTS (SELECT 1 FROM ne WHERE ne.query_id = mi.query_id AND ne.fact_id = mi.fact_id AND link_type = 'SUPERSEDES' AND way = 'inbound') AS replaced FROM mi LEFT JOIN rn USING (fact_id)),
bt AS (SELECT *, CASE WHEN ability IN ('supportive', 'boundary') OR contains(s, ',forget_delete,') THEN 'supportive_memory'
  WHEN need = 'provenance_source' OR contains(s, ',provenance_source,') OR contains(s, ',provenance,') THEN 'provenance_memory'
  WHEN replaced OR (NOT direct AND (need = 'state_transition' OR contains(s, ',state_transition,'))) THEN 'historical_transition_memory'
  WHEN contains(s, ',causal,') OR contains(s, ',causal_chain,') THEN 'relevant_causal_memory' WHEN need = 'premise_counterexample' OR contains(s, ',premise_counterexample,') THEN 'premise_check_memory'
  WHEN need = 'relationship_timeline' OR contains(s, ',relationship_arc,') THEN 'relationship_arc_memory' WHEN ability IN ('gotcha', 'workflow') THEN 'experience_context'
  WHEN NOT direct AND n_sources > 0 THEN 'provenance_memory' ELSE 'facts' END AS block FROM bk),
bp AS (SELECT *, min(rank_position) OVER (PARTITION BY query_id, block) AS block_place FROM bt),
re AS (SELECT ne.*, row_number() OVER (PARTITION BY ne.query_id, ne.fact_id ORDER BY abs(weight) DESC, link_id, way DESC, other_id) AS r FROM ne JOIN bp ON bp.query_id = ne.query_id AND bp.fact_id = ne.fact_id
  WHERE (block = 'relevant_causal_memory' AND link_type IN {_in(context.CAUSAL_RELATIONS)}) OR (block = 'historical_transition_memory' AND link_type IN {_in(context.HISTORY_RELATIONS)}) QUALIFY r <= 2),
pc AS (SELECT query_id, fact_id, 0 AS turn, row_number() OVER (PARTITION BY query_id, fact_id ORDER BY way <> 'outbound', other_id, link_type) AS i, cost, other_id AS id FROM re
  UNION ALL SELECT query_id, fact_id, 1, r, 6, episode_id FROM bp JOIN rf USING (fact_id)),
tl AS (SELECT query_id, sum(c) AS total FROM (SELECT query_id, CAST(length(content_summary) // 2 + 8 AS BIGINT) AS c FROM bp UNION ALL SELECT query_id, cost FROM pc) GROUP BY 1),
gv AS (SELECT pc.*, row_number() OVER (PARTITION BY query_id ORDER BY block_place DESC, rank_position DESC, turn, i DESC) AS n FROM pc JOIN bp USING (query_id, fact_id)),
gw AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(total AS BIGINT) AS has, CAST(NULL AS BIGINT) AS fact_id, 0 AS turn, CAST(NULL AS BIGINT) AS id, FALSE AS given FROM tl
  UNION ALL SELECT gw.query_id, gv.n, CASE WHEN has > {CONTEXT_BUDGET} THEN has - cost ELSE has END, gv.fact_id, gv.turn, gv.id, has > {CONTEXT_BUDGET} FROM gw JOIN gv ON gv.query_id = gw.query_id AND gv.n = gw.n + 1),
kp AS (SELECT gw.query_id, gw.fact_id, gw.turn, i, gw.id FROM gw JOIN gv ON gv.query_id = gw.query_id AND gv.n = gw.n WHERE NOT given),
ka AS (SELECT query_id, fact_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) FILTER (WHERE turn = 0), '') AS related, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) FILTER (WHERE turn = 1), '') AS refs FROM kp GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {SELECTED}, {CONTEXT} SELECT query_id, fact_id, rank_position, block, coalesce(related, '') AS related, coalesce(refs, '') AS refs FROM bp LEFT JOIN ka USING (query_id, fact_id)", SELECTED_TABLES)
def memory_context(m):
    """The retrieved facts as context blocks with references and relations, trimmed to a budget."""
    steps = Recall(m)
    picked = stored(steps.selected(steps.scored()))
    rows = context.trimmed(stored(context.items(picked, steps.asked, steps.facts, m.links, m.episodes)), CONTEXT_BUDGET)
    names = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("query_id", "fact_id", "rank_position", "block", names(F.col("related.other_id")).alias("related"), names(F.col("refs")).alias("refs"))
