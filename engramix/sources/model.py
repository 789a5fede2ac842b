"""The memory model over the driver's tables.

Every model table is one deterministic SELECT over the parquet tables, written in
the common subset of Spark SQL and ANSI SQL, so that an oracle can build the
same rows. ``{name}`` stands for a source or another model table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PLACE_BASE = 1_000_000_000

#: The seeds of ``predicate_schemas`` are fixed values.
TABLES: dict[str, str] = {
    "episodes": """
SELECT conv_id * 100 + turn AS episode_id, conv_id % 7 AS persona_id, conv_id AS session_id, turn, role, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 3600 + turn * 60) * INTERVAL '1' SECOND AS occurred_at,
  conv_id * 3600 + turn * 60 AS at_s,
  CASE conv_id % 11 WHEN 0 THEN 'hidden' WHEN 1 THEN 'redacted' ELSE 'visible' END AS visibility_status,
  CASE turn % 9 WHEN 8 THEN 'highly_sensitive' WHEN 7 THEN 'sensitive' ELSE 'normal' END AS sensitivity_level,
  conv_id % 13 <> 5 AS searchable
FROM {conversations}""",
    "entities": f"""
SELECT c_custkey AS entity_id, c_custkey % 7 AS persona_id, c_name AS canonical_name, 'person' AS entity_type,
  CASE WHEN c_custkey % 12 = 0 THEN 'hidden' ELSE 'visible' END AS visibility_status,
  CASE WHEN c_custkey % 15 = 0 THEN 'highly_sensitive' ELSE 'normal' END AS sensitivity_level, c_custkey % 14 <> 0 AS searchable
FROM {{customer}}
UNION ALL
SELECT CAST({PLACE_BASE} + n_nationkey AS BIGINT), CAST(n_nationkey % 7 AS BIGINT), n_name, 'place',
  CASE WHEN n_nationkey % 12 = 5 THEN 'hidden' ELSE 'visible' END, CASE WHEN n_nationkey % 10 = 3 THEN 'sensitive' ELSE 'normal' END, n_nationkey % 11 <> 7
FROM {{nation}}""",
    "facts": f"""
SELECT o_orderkey AS fact_id, o_custkey % 7 AS persona_id, o_custkey AS subject_entity_id,
  CASE WHEN o_orderkey % 3 = 0 THEN {PLACE_BASE} + o_custkey % 25 END AS object_entity_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN lower(o_orderpriority) END AS object_literal,
  CASE o_orderkey % 6 WHEN 0 THEN 'lives_in' WHEN 1 THEN 'works_at' WHEN 2 THEN 'likes' WHEN 3 THEN 'has_pet' WHEN 4 THEN 'promised_to' ELSE 'is_busy_with' END AS predicate,
  concat('customer ', CAST(o_custkey % 50 AS VARCHAR(20)), ' noted ', lower(o_orderpriority), ' status ', o_orderstatus, ' group ', CAST(o_orderkey % 9 AS VARCHAR(20))) AS content_summary,
  CASE o_orderkey % 7 WHEN 0 THEN 'core_identity' WHEN 1 THEN 'stable_preference' WHEN 2 THEN 'relational_state' WHEN 3 THEN 'commitment'
    WHEN 4 THEN 'significant_event' WHEN 5 THEN 'transient_context' ELSE 'task_state' END AS fact_type,
  o_orderdate AS valid_from, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL '30' DAY END AS valid_to, o_orderdate AS created_at,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS importance, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS confidence,
  CASE o_orderkey % 13 WHEN 0 THEN 'highly_sensitive' WHEN 1 THEN 'sensitive' ELSE 'normal' END AS sensitivity_level,
  CASE o_orderkey % 8 WHEN 0 THEN 'invalidated' WHEN 1 THEN 'uncertain' ELSE 'valid' END AS validity_status,
  CASE o_orderkey % 17 WHEN 0 THEN 'hidden' WHEN 1 THEN 'forgotten' WHEN 2 THEN 'purged' ELSE 'visible' END AS visibility_status,
  CASE o_orderkey % 10 WHEN 0 THEN 'archived' WHEN 1 THEN 'deep_archived' WHEN 2 THEN 'dormant' WHEN 3 THEN 'consolidated' ELSE 'active' END AS lifecycle_status,
  o_orderkey % 9 = 0 AS pinned, o_orderkey % 19 <> 0 AS searchable, o_orderkey % 5 AS reinforcement_count, o_orderkey % 4 AS access_count
FROM {{orders}}""",
    "links": """
SELECT l_orderkey * 10 + l_linenumber AS link_id, l_orderkey AS from_id,
  CASE WHEN l_linenumber IN (1, 4) THEN 'EVIDENCED_BY' WHEN l_linenumber = 3 THEN 'ABOUT_ENTITY' WHEN l_returnflag = 'R' THEN 'CAUSED_BY'
    WHEN l_returnflag = 'A' THEN 'SUPPORTS' WHEN l_orderkey % 2 = 0 THEN 'SUPERSEDES' ELSE 'EXPLAINS' END AS link_type,
  CASE WHEN l_linenumber IN (1, 4) THEN 'episode' WHEN l_linenumber = 3 THEN 'entity' ELSE 'fact' END AS to_type,
  CASE WHEN l_linenumber IN (1, 4) THEN (l_partkey % 60) * 100 + l_suppkey % 6 WHEN l_linenumber = 3 THEN l_suppkey ELSE l_partkey END AS to_id,
  CASE WHEN l_linestatus = 'F' THEN 'forward' WHEN l_orderkey % 2 = 0 THEN 'bidirectional' ELSE 'backward' END AS direction,
  CAST(l_quantity AS DOUBLE) / 50 AS weight, CASE WHEN l_orderkey % 23 = 0 THEN 'hidden' ELSE 'visible' END AS visibility_status, l_orderkey % 29 <> 3 AS searchable
FROM {lineitem}""",
    "entity_aliases": f"""
SELECT c_custkey AS entity_id, concat('client number ', CAST(c_custkey AS VARCHAR(20))) AS alias FROM {{customer}} WHERE c_custkey % 3 <> 2
UNION ALL
SELECT CAST({PLACE_BASE} + n_nationkey AS BIGINT), concat('the far land of ', lower(n_name)) FROM {{nation}}""",
    "search_documents": """
SELECT doc_id AS node_id, text AS search_text,
  CASE doc_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'dormant' WHEN 2 THEN 'consolidated' WHEN 3 THEN 'archived' ELSE 'deep_archived' END AS lifecycle_status,
  CASE WHEN doc_id % 16 = 0 THEN 'hidden' ELSE 'visible' END AS visibility_status, CASE WHEN doc_id % 21 = 0 THEN 'highly_sensitive' ELSE 'normal' END AS sensitivity_level,
  doc_id % 18 <> 1 AS searchable, doc_id * 60 AS updated_s
FROM {documents}""",
    "queries": "SELECT item_id AS query_id, text AS query_text FROM {benchmark}",
    "questions": """
SELECT b.item_id AS query_id, CAST(b.item_id % 7 AS BIGINT) AS persona_id, CAST(b.item_id + 1 AS BIGINT) AS session_id, b.item_id % 2 = 0 AS allow_historical,
  concat(p.opening, ' ', b.text, ' what did customer ', CAST(b.item_id % 50 AS VARCHAR(20)), ' and Customer#', lpad(CAST(b.item_id + 1 AS VARCHAR(20)), 9, '0'),
    ' and client number ', CAST(b.item_id + 3 AS VARCHAR(20)), ' note about ', n.n_name, ' urgent status O') AS query_text
FROM {benchmark} b JOIN {nation} n ON n.n_nationkey = b.item_id % 25
JOIN (VALUES (0, '以前 不再 开始'), (1, 'why did it change, cause of'), (2, 'source of evidence'), (3, 'never true'), (4, 'profile of'), (5, '上次 跟谁 哪里'), (6, '从 A 变成 B'),
  (7, 'support for'), (8, 'latest status of'), (9, 'tell me'), (10, '反思 成长'), (11, 'forget this')) AS p(k, opening) ON p.k = b.item_id % 12""",
    "narratives": """
SELECT doc_id AS node_id, CASE doc_id % 3 WHEN 0 THEN 'insight' ELSE 'narrative' END AS node_type, doc_id % 7 AS persona_id, text AS search_text,
  CASE doc_id % 5 WHEN 3 THEN 'archived' WHEN 4 THEN 'deep_archived' ELSE 'active' END AS lifecycle_status,
  CASE WHEN doc_id % 16 = 0 THEN 'hidden' ELSE 'visible' END AS visibility_status, CASE WHEN doc_id % 21 = 0 THEN 'highly_sensitive' ELSE 'normal' END AS sensitivity_level,
  doc_id % 18 <> 1 AS searchable, doc_id * 60 AS updated_s
FROM {documents}""",
    "narrative_links": """
SELECT d.doc_id AS node_id, CASE d.doc_id % 3 WHEN 0 THEN 'insight' ELSE 'narrative' END AS node_type, l.l_orderkey AS fact_id, l.l_orderkey * 10 + l.l_linenumber AS link_id,
  CASE l.l_linenumber % 3 WHEN 0 THEN 'DERIVED_FROM' WHEN 1 THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS link_type, l.l_returnflag <> 'R' AS outbound,
  CAST(l.l_quantity AS DOUBLE) / 50 AS weight, CASE WHEN l.l_orderkey % 23 = 0 THEN 'hidden' ELSE 'visible' END AS visibility_status, l.l_orderkey % 29 <> 3 AS searchable
FROM {lineitem} l JOIN {documents} d ON d.doc_id = l.l_suppkey * 7 + l.l_linenumber""",
    "fact_vectors": "SELECT vec_id AS fact_id, embedding FROM {embeddings}",
    "access_events": """
SELECT event_id, user_id AS session_id, event_id % 997 AS node_id, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'retrieved' WHEN 'click' THEN 'prompt_injected' WHEN 'purchase' THEN 'reinforced' WHEN 'signup' THEN 'suppressed' ELSE 'filtered' END AS access_type,
  value AS retrieval_score
FROM {events}""",
    "queue": """
SELECT event_id AS queue_id, event_id % 7 AS persona_id, event_id % 11 AS priority, ts AS created_at, event_id % 6 AS attempts,
  CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
  CASE event_id % 5 WHEN 0 THEN 'upsert_node' WHEN 1 THEN 'delete_node' WHEN 2 THEN 'upsert_edge' WHEN 3 THEN 'delete_edge' ELSE 'rebuild_persona' END AS operation
FROM {events}""",
    "memory_index_map": f"""
SELECT 'fact' AS node_type, o_orderkey AS node_id, o_orderkey * 10 + 1 AS mirror_id, CASE o_orderkey % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'deleted' ELSE 'indexed' END AS index_status FROM {{orders}}
UNION ALL
SELECT 'entity', c_custkey, c_custkey * 10 + 2, CASE c_custkey % 4 WHEN 0 THEN 'failed' ELSE 'indexed' END FROM {{customer}}""",
    "mirror_persona_state": """
SELECT * FROM (VALUES (0, 'ready'), (1, 'rebuilding'), (2, 'ready'), (3, 'degraded'), (4, 'ready'), (5, 'ready')) AS p(persona_id, state)""",
    "predicate_schemas": """
SELECT * FROM (VALUES ('lives_in', 'core_identity', 'single', 'supersede', 3650, 'entity', 0.80, FALSE), ('works_at', 'core_identity', 'single', 'supersede', 1825, 'entity', 0.75, FALSE),
  ('prefers_name', 'core_identity', 'single', 'supersede', 3650, 'literal', 0.85, FALSE), ('likes', 'stable_preference', 'multi', 'coexist', 365, 'either', 0.55, FALSE),
  ('dislikes', 'stable_preference', 'multi', 'coexist', 365, 'either', 0.60, FALSE), ('has_pet', 'core_identity', 'multi', 'coexist', 1825, 'entity', 0.65, FALSE),
  ('is_busy_with', 'transient_context', 'temporal_multi', 'expire_by_time', 21, 'either', 0.50, FALSE), ('feels_about_agent', 'relational_state', 'single', 'llm_check', 180, 'literal', 0.65, FALSE),
  ('promised_to', 'commitment', 'temporal_multi', 'expire_by_time', 30, 'literal', 0.70, FALSE), ('is_considering', 'significant_event', 'temporal_multi', 'expire_by_time', 90, 'either', 0.65, FALSE),
  ('has_boundary', 'relational_state', 'multi', 'merge', 365, 'literal', 0.80, TRUE), ('prefers_communication_style', 'stable_preference', 'multi', 'merge', 365, 'literal', 0.65, FALSE),
  ('uses_coping_strategy', 'stable_preference', 'multi', 'coexist', 365, 'literal', 0.65, FALSE)) AS p(predicate, default_fact_type, cardinality, conflict_policy, default_tau_days, object_kind, default_importance, sensitive_by_default)""",
}


class Model:
    """Model and source tables of one folder, as attributes; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                inputs = {x: getattr(self, x) for x in re.findall(r"\{(\w+)\}", TABLES[name])}
                text = TABLES[name].replace("VARCHAR(20)", "STRING").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
                self._known[name] = self.spark.sql(text, **inputs)
            else:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]


def with_model(*names: str) -> str:
    """``WITH`` clause that builds model tables in ANSI SQL."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', TABLES[n])})" for n in names)
