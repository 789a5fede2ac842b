"""Queries over authority, evidence and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import authority as A
from .registry import query

NOW = "2024-06-01 00:00:00"
RANK = "CASE {0} WHEN 'normal' THEN 0 WHEN 'sensitive' THEN 1 WHEN 'highly_sensitive' THEN 2 ELSE 3 END"
EVIDENCE = f"""ev AS (SELECT l.from_id AS fact_id, count(*) AS n_links,
  count(*) FILTER (WHERE l.visibility_status = 'visible' AND l.searchable AND e.visibility_status = 'visible' AND e.searchable AND {RANK.format('e.sensitivity_level')} <= 0) AS n_allowed,
  count(*) FILTER (WHERE e.visibility_status = 'visible' AND e.searchable) AS n_episodes
  FROM links l LEFT JOIN episodes e ON l.to_id = e.episode_id WHERE l.link_type = 'EVIDENCED_BY' GROUP BY 1)"""
OK_ENTITY = f"ok AS (SELECT entity_id, visibility_status = 'visible' AND searchable AND {RANK.format('sensitivity_level')} <= 0 AS ok FROM entities)"
AUTHORIZED = f"""{EVIDENCE}, {OK_ENTITY}, auth AS (SELECT f.*, coalesce(n_links, 0) AS n_links, coalesce(n_allowed, 0) AS n_allowed, coalesce(n_episodes, 0) AS n_episodes
  FROM facts f LEFT JOIN ev USING (fact_id) LEFT JOIN ok s ON s.entity_id = f.subject_entity_id LEFT JOIN ok o ON o.entity_id = f.object_entity_id
  WHERE f.visibility_status = 'visible' AND f.searchable AND f.validity_status <> 'invalidated' AND f.lifecycle_status NOT IN ('archived', 'deep_archived')
  AND {RANK.format('f.sensitivity_level')} <= 0 AND (f.subject_entity_id IS NULL OR coalesce(s.ok, false)) AND (f.object_entity_id IS NULL OR coalesce(o.ok, false))
  AND (coalesce(n_allowed, 0) > 0 OR (coalesce(n_links, 0) = 0 AND f.pinned)))"""
FACT_TABLES = ("facts", "links", "episodes", "entities")


def authorized(m):
    return A.authority_filter(m.facts, m.entities, m.links, m.episodes)


@query(f"WITH {AUTHORIZED} SELECT fact_id, persona_id, n_links, n_allowed FROM auth", FACT_TABLES)
def authority_filter(m):
    return authorized(m).select("fact_id", "persona_id", "n_links", "n_allowed")


@query(
    f"""WITH r AS (SELECT fact_id, {RANK.format('sensitivity_level')} AS r FROM facts)
SELECT fact_id, CAST(r AS BIGINT) AS sensitivity_rank FROM r""", ("facts",))
def sensitivity_rank(m):
    return m.facts.select("fact_id", S.sensitivity_rank(F.col("sensitivity_level")).cast("bigint").alias("sensitivity_rank"))


@query(
    f"""WITH {OK_ENTITY} SELECT fact_id, (f.subject_entity_id IS NULL OR coalesce(s.ok, false)) AND (f.object_entity_id IS NULL OR coalesce(o.ok, false)) AS entities_ok
FROM facts f LEFT JOIN ok s ON s.entity_id = f.subject_entity_id LEFT JOIN ok o ON o.entity_id = f.object_entity_id""", ("facts", "entities"))
def entity_eligibility(m):
    return A.with_entities(m.facts, m.entities, 0).select("fact_id", "entities_ok")


@query(
    f"""WITH {EVIDENCE} SELECT fact_id, coalesce(n_links, 0) AS n_links, coalesce(n_allowed, 0) AS n_allowed,
  coalesce(n_allowed, 0) > 0 OR (coalesce(n_links, 0) = 0 AND pinned) AS allowed FROM facts LEFT JOIN ev USING (fact_id)""", ("facts", "links", "episodes"))
def provenance_eligibility(m):
    return A.with_evidence(m.facts, A.evidence(m.links, m.episodes, 0)).select("fact_id", "n_links", "n_allowed", A.provenance_allows().alias("allowed"))


@query(
    f"""WITH {EVIDENCE} SELECT fact_id, coalesce(n_links, 0) = 0 OR coalesce(n_episodes, 0) > 0 AS allowed FROM facts LEFT JOIN ev USING (fact_id)""",
    ("facts", "links", "episodes"))
def search_eligibility(m):
    return A.with_evidence(m.facts, A.evidence(m.links, m.episodes, 0)).select("fact_id", A.search_evidence_allows().alias("allowed"))


@query(
    f"""WITH {EVIDENCE}, s AS (SELECT fact_id, CASE WHEN confidence > 0 THEN confidence ELSE 0.5 END AS c, coalesce(n_allowed, 0) AS n, pinned, reinforcement_count AS r FROM facts LEFT JOIN ev USING (fact_id))
SELECT fact_id, round(0.45 * c + 0.25 * least(1.0, ln(1 + n) / ln(4)) + 0.20 * (CASE WHEN n > 0 THEN 1.0 WHEN pinned THEN 0.5 ELSE 0.0 END) + 0.10 * least(1.0, ln(1 + r) / ln(4)), 6) AS strength FROM s""",
    ("facts", "links", "episodes"))
def evidence_strength(m):
    rows = A.with_evidence(m.facts, A.evidence(m.links, m.episodes, 0))
    return rows.select("fact_id", F.round(S.evidence_strength(F.col("confidence"), F.col("n_allowed"), F.col("pinned"), F.col("reinforcement_count")), 6).alias("strength"))


@query(
    f"""WITH {EVIDENCE} SELECT fact_id, coalesce(n_links, 0) AS n_links,
  CASE WHEN visibility_status = 'forgotten' THEN '[forgotten]' WHEN visibility_status = 'purged' THEN '[purged]'
    WHEN coalesce(n_links, 0) > 0 AND coalesce(n_episodes, 0) = 0 THEN '[redacted]' ELSE content_summary END AS summary
FROM facts LEFT JOIN ev USING (fact_id) WHERE persona_id = 3 AND visibility_status IN ('visible', 'forgotten', 'purged') ORDER BY fact_id LIMIT 50 OFFSET 20""",
    ("facts", "links", "episodes"))
def fact_inspect(m):
    """A page of an inspection listing: the limit is the feature."""
    rows = A.with_evidence(m.facts.filter("persona_id = 3 AND visibility_status IN ('visible', 'forgotten', 'purged')"), A.evidence(m.links, m.episodes, 0))
    return rows.orderBy("fact_id").offset(20).limit(50).select("fact_id", "n_links", A.mask_summary().alias("summary"))


@query(
    f"""SELECT node_id, visibility_status = 'visible' AND searchable AND {RANK.format('sensitivity_level')} <= 1 AND lifecycle_status <> 'deep_archived' AS allowed,
  CASE lifecycle_status WHEN 'dormant' THEN 'warm' WHEN 'archived' THEN 'cold' WHEN 'deep_archived' THEN 'deep_cold' ELSE 'hot' END AS tier FROM search_documents""",
    ("search_documents",))
def search_document_authority(m):
    allowed = A.visible_at(1) & (F.col("lifecycle_status") != "deep_archived")
    return m.search_documents.select("node_id", allowed.alias("allowed"), S.search_tier(F.col("lifecycle_status")).alias("tier"))


#: The link types that the mirror holds.
MIRROR_LINKS = ["ABOUT_ENTITY", "CAUSED_BY", "CONTRIBUTED_TO", "EXPLAINS", "SUPPORTS", "CONTRADICTS", "INHIBITS", "SUPERSEDES", "DERIVED_FROM", "CO_OCCURS_WITH"]


@query(
    f"""WITH n AS (SELECT fact_id AS id FROM facts WHERE visibility_status = 'visible' AND searchable),
e AS (SELECT entity_id AS id FROM entities WHERE visibility_status = 'visible' AND searchable)
SELECT link_id, link_type FROM links l WHERE visibility_status = 'visible' AND searchable
  AND link_type IN ({', '.join(repr(k) for k in MIRROR_LINKS)})
  AND from_id IN (SELECT id FROM n) AND ((to_type = 'fact' AND to_id IN (SELECT id FROM n)) OR (to_type = 'entity' AND to_id IN (SELECT id FROM e)))""",
    ("facts", "entities", "links"))
def mirror_edges(m):
    seen = "visibility_status = 'visible' AND searchable"
    facts = m.facts.filter(seen).select(F.lit("fact").alias("to_type"), F.col("fact_id").alias("to_id"))
    nodes = facts.unionByName(m.entities.filter(seen).select(F.lit("entity").alias("to_type"), F.col("entity_id").alias("to_id")))
    edges = m.links.filter(seen).filter(F.col("link_type").isin(MIRROR_LINKS))
    return edges.join(nodes, ["to_type", "to_id"], "left_semi").join(facts.select(F.col("to_id").alias("from_id")), "from_id", "left_semi").select("link_id", "link_type")


@query(
    """SELECT 'facts.visibility' AS rule, count(*) AS n_violations FROM facts WHERE visibility_status NOT IN ('visible', 'hidden', 'forgotten', 'purged') OR visibility_status IS NULL
UNION ALL SELECT 'facts.importance', count(*) FROM facts WHERE importance NOT BETWEEN 0 AND 1 OR importance IS NULL
UNION ALL SELECT 'facts.id', count(*) FROM (SELECT fact_id FROM facts GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'links.from', count(*) FROM links WHERE from_id NOT IN (SELECT fact_id FROM facts)
UNION ALL SELECT 'links.episode', count(*) FROM links WHERE to_type = 'episode' AND to_id NOT IN (SELECT episode_id FROM episodes)""",
    ("facts", "links", "episodes"))
def constraint_violations(m):
    from ..sources import constraints as C

    return C.report(
        {
            "facts.visibility": C.not_in(m.facts, "visibility_status", ["visible", "hidden", "forgotten", "purged"]),
            "facts.importance": C.outside(m.facts, "importance", 0, 1),
            "facts.id": C.repeated(m.facts, ["fact_id"]),
            "links.from": C.dangling(m.links, "from_id", m.facts, "fact_id"),
            "links.episode": C.dangling(m.links.filter("to_type = 'episode'"), "to_id", m.episodes, "episode_id"),
        }
    )
