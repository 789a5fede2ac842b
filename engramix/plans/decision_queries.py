"""Queries over decisions: retrieval modes with reasons, other readings, semantic routing, bonuses of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as Q
from ..operators import context as C
from ..operators import search
from .context_queries import ASKED, NOTE, noted
from .flow_queries import FITTED, PROBED, anchor_probes, question_scores
from .ranking_queries import OPEN
from .registry import query

#: A question's persona, what its words say, and its persona's probes.
WEIGHED = f"""{ASKED}, {NOTE}, {FITTED}, {PROBED}, cx AS (SELECT ab.*, contains(signals, 'exact_fact')::INT AS dp, contains(t, '那次')::INT AS am, contains(signals, 'sensitivity')::INT AS rk,
  least(1.0, (CASE WHEN signals = '' THEN 0 ELSE len(string_split(signals, ',')) END) / 4.0) AS cpx, round(fit, 8) AS fit, coalesce(readiness, 0.0) AS rd, coalesce(predicate, 0.0) AS pc
  FROM ab JOIN ft USING (query_id) LEFT JOIN pr ON persona_id = ab.query_id // 100 % 7)"""


def weighed(m):
    probes = anchor_probes(m).select("persona_id", "readiness", "predicate")
    rows = noted(m).join(question_scores(m).select("query_id", "rule_fit"), "query_id")
    rows = rows.withColumn("persona_id", F.expr("query_id div 100 % 7")).join(probes, "persona_id", "left")
    yes = lambda c: c.cast("int").cast("double")
    return rows.select(
        "query_id", "t", "ability", "need", "signals", F.col("rule_fit").alias("fit"), F.coalesce("readiness", F.lit(0.0)).alias("readiness"), F.coalesce("predicate", F.lit(0.0)).alias("predicate"),
        yes(F.array_contains("signals", "exact_fact")).alias("default_penalty"), yes(F.contains("t", F.lit("那次"))).alias("ambiguity"),
        yes(F.array_contains("signals", "sensitivity")).alias("risk"), F.least(F.lit(1.0), F.size("signals") / 4.0).alias("complexity"),
    )


@query(
    f"""WITH {WEIGHED}
SELECT query_id, CASE ability WHEN 'boundary' THEN 'target_resolver' WHEN 'causal_explain' THEN 'graph_contextual' WHEN 'relationship_arc' THEN 'graph_contextual' WHEN 'historical' THEN 'historical' WHEN 'dynamic_state' THEN 'historical'
    WHEN 'provenance' THEN 'provenance' WHEN 'premise_check' THEN 'premise_check' WHEN 'direct_fact' THEN CASE WHEN pc >= 0.6 THEN 'exact' ELSE 'hybrid' END ELSE 'hybrid' END AS retrieval_mode,
  concat_ws(',', CASE WHEN ability = 'boundary' THEN 'boundary_or_forget_intent' WHEN ability = 'causal_explain' THEN 'causal_intent' WHEN ability IN ('historical', 'provenance', 'premise_check', 'relationship_arc', 'direct_fact') THEN ability || '_intent' END,
    CASE WHEN rd < 0.45 THEN 'weak_anchor' ELSE 'anchor_ready' END, CASE WHEN dp = 1 THEN 'default_fallback' END, CASE WHEN am = 1 THEN 'ambiguous_reference' END, CASE WHEN rk = 1 THEN 'safety_risk' END) AS reasons FROM cx""",
    ("queries", "facts"))
def rule_decision(m):
    rows, none = weighed(m), F.lit(0)
    reasons = Q.rule_reasons(F.col("ability"), none, F.col("readiness"), F.col("default_penalty"), F.col("ambiguity"), F.col("risk"))
    return rows.select("query_id", Q.retrieval_mode(F.col("ability"), none, F.col("predicate")).alias("retrieval_mode"), F.array_join(reasons, ",").alias("reasons"))


@query(
    f"""WITH {ASKED}, {NOTE}, d AS (SELECT query_id, t, ability, {Q.domain_sql('t')} AS dm FROM ab), v AS (SELECT query_id FROM d WHERE ability = 'direct_fact' AND regexp_matches(t, '这件事|这个|那个|这次|那次|后来|之前'))
SELECT query_id, 'memory_ability' AS field, 'historical' AS value, 0.55::DOUBLE AS confidence, 'ambiguous_reference,temporal_marker' AS reasons FROM v
UNION ALL SELECT query_id, 'time_mode', 'historical', 0.5::DOUBLE, 'ambiguous_reference,temporal_marker' FROM v
UNION ALL SELECT query_id, 'memory_domain', 'work_experience', 0.5::DOUBLE, 'weak_work_domain_signal' FROM d WHERE dm = 'relationship' AND regexp_matches(t, '上班|工作') AND NOT regexp_matches(t, '关系|朋友|家人')""", ("queries",))
def rule_alternatives(m):
    t = F.col("t")
    rows = noted(m).select("query_id", F.inline(Q.alternatives(t, F.col("ability"), Q.domain(t))))
    return rows.withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""WITH {WEIGHED}, nd AS (SELECT *, round(least(1.0, greatest(0.0, 0.35 * (1 - fit) + 0.25 * (1 - rd) + 0.25 * cpx + 0.15 * am)), 8) AS need0 FROM cx),
w AS (SELECT *, CASE WHEN ability = 'causal_explain' AND rd < 0.5 THEN greatest(need0, 0.6) ELSE need0 END AS nw FROM nd),
r AS (SELECT *, CASE WHEN trim(t) = '' THEN 'empty_query' WHEN contains(signals, 'forget_delete') OR ability = 'boundary' THEN 'forget_or_delete_intent' WHEN rk = 1 THEN 'safety_policy_first'
  WHEN nw >= 0.58 THEN 'semantic_need_high' WHEN fit < 0.66 THEN 'rule_fit_low' WHEN rd < 0.45 AND cpx >= 0.5 THEN 'anchor_readiness_low' ELSE 'rule_and_anchor_sufficient' END AS why FROM w),
g AS (SELECT *, why IN ('semantic_need_high', 'rule_fit_low', 'anchor_readiness_low') AS goes FROM r)
SELECT query_id, CASE WHEN why = 'forget_or_delete_intent' THEN 'target_resolver' WHEN NOT goes THEN 'none' WHEN ability = 'causal_explain' AND rd <= 0.45 THEN 'semantic_decompose' WHEN cpx >= 0.8 THEN 'semantic_decompose'
    WHEN cpx >= 0.72 THEN 'semantic_full' ELSE 'semantic_light' END AS semantic_mode,
  CASE WHEN why = 'forget_or_delete_intent' THEN 'target_resolver' WHEN NOT goes THEN 'rule' WHEN ability = 'causal_explain' AND rd <= 0.45 THEN 'graph_contextual' ELSE 'semantic' END AS retrieval_mode,
  CASE WHEN goes AND ability = 'causal_explain' THEN 'causal_intent,' ELSE '' END || CASE WHEN goes AND rd <= 0.45 THEN 'weak_anchor,' ELSE '' END || why AS reasons FROM g""", ("queries", "facts"))
def semantic_decision(m):
    rows = weighed(m)
    need = F.round(Q.semantic_need(F.col("fit"), F.col("readiness"), F.col("complexity"), F.col("ambiguity"), F.col("ability") == "causal_explain"), 8)
    decided = Q.semantic_decision(F.col("t"), F.col("ability"), F.col("signals"), need, F.col("fit"), F.col("readiness"), F.col("complexity"), F.col("risk"), full=True)
    return rows.select("query_id", decided.alias("d")).select("query_id", "d.semantic_mode", "d.retrieval_mode", F.array_join("d.reasons", ",").alias("reasons"))


@query(
    f"""WITH {ASKED}, {NOTE}, fc AS (SELECT persona_id, fact_id, fact_type, lower(concat_ws(' ', predicate, fact_type, content_summary, object_literal)) AS low,
  row_number() OVER (PARTITION BY persona_id ORDER BY importance DESC, fact_id) AS r FROM facts WHERE {OPEN})
SELECT query_id, fact_id, CASE WHEN ability IN ('relationship_arc', 'dynamic_state') AND need IN ('state_transition', 'relationship_timeline')
  AND (fact_type = 'relational_state' OR regexp_matches(low, 'feels_with_agent|relational_state|companionship|less lonely')) THEN 0.22 ELSE 0.0 END::DOUBLE AS bonus
FROM ab JOIN fc ON persona_id = query_id // 100 % 7 WHERE r <= 30""", ("queries", "facts"))
def text_bonus(m):
    """Bonuses of a persona's 30 most important facts. The SQL lacks the words in Chinese: the tables' facts hold none."""
    low = F.lower(F.concat_ws(" ", "predicate", "fact_type", "content_summary", "object_literal"))
    facts = search.top_k(m.facts.filter(OPEN), 30, [F.desc("importance"), F.asc("fact_id")], "persona_id").select("persona_id", "fact_id", "fact_type", low.alias("low"))
    rows = noted(m).withColumn("persona_id", F.expr("query_id div 100 % 7")).join(facts, "persona_id")
    no = F.lit(False)
    return rows.select("query_id", "fact_id", C.text_bonus(F.col("ability"), F.col("need"), F.col("t"), F.col("low"), F.col("fact_type"), no, no).alias("bonus"))
