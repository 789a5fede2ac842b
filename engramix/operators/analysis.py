"""Query analysis: rule classifiers over a table of questions, anchors' gates, readiness and routing.

A rule is a small tree of word tests. It renders to a column over a lower-cased text
and to the same test in SQL, so the classifiers below are plain data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import clamp01
from ..functions.text import contains_any


@dataclass(frozen=True)
class Words:
    """One of the words occurs."""

    words: tuple[str, ...]

    def column(self, text: Column) -> Column:
        return contains_any(text, list(self.words))

    def sql(self, name: str) -> str:
        return "(" + " OR ".join(f"contains({name}, '{w}')" for w in self.words) + ")"


@dataclass(frozen=True)
class Both:
    parts: tuple

    def column(self, text: Column) -> Column:
        return reduce(lambda a, b: a & b, (p.column(text) for p in self.parts))

    def sql(self, name: str) -> str:
        return "(" + " AND ".join(p.sql(name) for p in self.parts) + ")"


@dataclass(frozen=True)
class Either:
    parts: tuple

    def column(self, text: Column) -> Column:
        return reduce(lambda a, b: a | b, (p.column(text) for p in self.parts))

    def sql(self, name: str) -> str:
        return "(" + " OR ".join(p.sql(name) for p in self.parts) + ")"


@dataclass(frozen=True)
class Without:
    part: object

    def column(self, text: Column) -> Column:
        return ~self.part.column(text)

    def sql(self, name: str) -> str:
        return f"(NOT {self.part.sql(name)})"


@dataclass(frozen=True)
class AtLeast:
    """At least ``n`` of the parts hold."""

    n: int
    parts: tuple

    def column(self, text: Column) -> Column:
        return reduce(lambda a, b: a + b, (p.column(text).cast("int") for p in self.parts)) >= self.n

    def sql(self, name: str) -> str:
        return "(" + " + ".join(f"CAST({p.sql(name)} AS INT)" for p in self.parts) + f" >= {self.n})"


def words(*w: str) -> Words:
    return Words(w)


# The words of each intent.
PAST_EVENT = words("上次", "那天", "五一", "有一次", "周末", "最近一次", "前几天")
OLD_STATE = words("一开始", "之前", "以前", "曾经", "从前", "原来", "过去", "从来不", "以前从来", "起初")
NEW_STATE = words("后来", "最近", "现在", "已经", "开始", "不再", "效果怎么样", "发生变化", "变成", "变为", "变得", "和好", "和解", "翻篇")
PROVENANCE = words(
    "什么时候告诉我的", "哪次告诉我的", "什么时候说过", "哪次说过", "从哪里知道", "哪里知道的", "来源", "证据", "谁告诉我的",
    "什么时候说的", "最早什么时候", "source", "evidence", "provenance",
)
REFLECTION = Either((words("反思", "成长", "最近进步"), Both((words("这两个月", "最近"), words("变化", "进步")))))
UNIVERSAL = words(
    "是不是完全", "是否完全", "完全没有", "没有任何", "从来没", "从来没有", "从来不", "一直都", "一直没有", "一直没", "一直不", "是否一直",
    "是不是一直", "所有", "每个", "任何", "什么都", "必须", "从头到尾", "总是", "每次", "永远", "always", "never", "every time",
)
CONDITIONAL = Both(
    (words("如果", "假如", "一旦", "if "), words("是否", "是不是", "会不会", "能不能", "可不可以", "还能", "还会不会", "can ", "will "))
)
CHALLENGE = words("有没有反例", "有反例", "反例", "有没有例外", "有例外", "例外", "推翻", "打脸", "还成立吗", "仍然成立吗", "counterexample", "disprove", "exception")
EVENT_SLOTS = AtLeast(2, (words("跟谁", "和谁", "谁"), words("多久", "多长时间", "排了多久"), words("哪里", "哪儿"), words("什么时候")))
EVENT_REASON = Both(
    (
        words("因为什么", "什么原因", "什么事情", "什么事", "什么由头", "什么名义", "what occasion", "what reason"),
        words("庆祝", "祝贺", "纪念", "请客", "请大家", "聚餐", "活动", "仪式", "安排", "celebrate", "celebration", "occasion", "treat"),
    )
)
DYNAMIC = words("最近状态", "当前状态", "最新状态", "进度", "进展", "变化", "有没有变", "latest status", "current status", "progress", "update", "changed")
RELATIONSHIP = words("关系变化", "关系轨迹", "关系时间线", "关系发展", "relationship arc", "relationship timeline")
HISTORY_WORDS = words("以前", "过去", "上次", "历史", "之前", "曾经", "从前", "prior", "previous", "last time", "historical", "history", "before")
SENSITIVE = words("隐私", "敏感", "不要提", "别提", "不要再提", "忘掉", "边界", "boundary", "private", "sensitive")
DELETING = words("忘掉", "删除", "删掉", "清除", "不要再提", "forget", "delete", "remove")
DEBUGGING = words("debug", "调试", "diagnostic", "diagnostics", "诊断")
BOUNDARY = words("忘掉", "删除", "删掉", "清除", "不要提", "别提", "不要再提", "边界", "不要提醒", "forget", "delete", "remove", "boundary")
SUPPORTIVE = words("支持", "安慰", "鼓励", "陪伴", "support", "supportive")
GOTCHA = words("坑", "踩坑", "失败", "报错", "错误", "故障", "gotcha", "pitfall", "failed", "failure", "error")
PROCEDURE = words("流程", "步骤", "怎么做", "操作步骤", "workflow", "procedure")
STATIC_STATE = words("身份", "偏好", "默认配置", "住址", "常驻状态", "profile", "preference", "default", "address", "stable setting")
PLANNING = words("计划", "规划", "planning")
VAGUE_TIME = words("这件事", "这个", "那个", "这次", "那次", "后来", "之前")
WORKING = Both((words("上班", "工作"), Without(words("关系", "朋友", "家人"))))

TRANSITION = Either((Both((words("不再"), words("开始"))), Both((words("从"), words("变成", "变为", "变得"))), Both((OLD_STATE, NEW_STATE))))
PREMISE = Either((UNIVERSAL, CONDITIONAL, CHALLENGE))
CAUSAL = Both((words("为什么", "原因", "导致", "怎么会", "为何", "why", "cause", "caused", "because"), Without(EVENT_REASON)))
HISTORICAL = Either((TRANSITION, PAST_EVENT, HISTORY_WORDS))

# Classes in order of precedence.
TIME_MODES = [("historical", HISTORICAL), ("bitemporal_check", UNIVERSAL)]
DOMAINS = [
    ("environment_experience", words("环境", "路径", "依赖", "python", "uv", "windows", "powershell", "权限", "toolchain", "runtime", "缓存", "cache")),
    ("work_experience", words("部署", "上线", "ci", "测试", "命令", "repo", "仓库", "构建", "编译", "工作流", "workflow", "任务", "pr", "commit", "branch")),
    ("user_profile", words("我是谁", "身份", "名字", "昵称", "偏好", "喜欢", "讨厌", "住在", "profile", "preference", "identity")),
]
ABILITIES = [
    ("provenance", PROVENANCE), ("relationship_arc", RELATIONSHIP), ("historical", TRANSITION), ("premise_check", PREMISE), ("direct_fact", PAST_EVENT),
    ("causal_explain", CAUSAL), ("boundary", BOUNDARY), ("supportive", SUPPORTIVE), ("historical", REFLECTION), ("gotcha", GOTCHA), ("workflow", PROCEDURE),
    ("dynamic_state", DYNAMIC), ("static_state", STATIC_STATE), ("planning", PLANNING),
]
NEEDS = [
    ("provenance_source", PROVENANCE), ("relationship_timeline", RELATIONSHIP), ("state_transition", TRANSITION), ("premise_counterexample", PREMISE),
    ("exact_observation", PAST_EVENT), ("gotcha_note", GOTCHA), ("procedure_note", PROCEDURE), ("state_transition", DYNAMIC),
]
EVENT_FACT = Both((PAST_EVENT, Without(TRANSITION), Without(PREMISE)))
SIGNALS = [
    ("past_event_direct_fact", EVENT_FACT), ("event_bundle", Both((EVENT_FACT, EVENT_SLOTS))), ("state_transition", TRANSITION), ("provenance_source", PROVENANCE),
    ("reflection_summary", REFLECTION), ("premise_counterexample", PREMISE), ("causal", CAUSAL), ("causal_chain", Both((CAUSAL, TRANSITION))), ("historical", HISTORICAL),
    ("provenance", PROVENANCE), ("premise_check", PREMISE), ("relationship_arc", RELATIONSHIP), ("sensitivity", SENSITIVE), ("forget_delete", DELETING), ("debug", DEBUGGING),
]
#: Abilities for which an anchor source is asked.
PINNED_ABILITIES = ["boundary", "supportive", "premise_check"]
RECENT_ABILITIES = ["causal_explain", "historical", "provenance", "planning", "premise_check", "gotcha", "workflow"]
NARRATIVE_ABILITIES = ["causal_explain", "supportive", "provenance", "planning", "premise_check"]

#: Openings that make sample questions of every class.
SAMPLE_PREFIXES = [
    "what happened before", "my python cache", "the workflow failed", "profile of", "why did it change, cause of", "hello", "是不是完全 never", "以前 不再 开始",
    "forget this boundary", "source of evidence", "上次 跟谁 什么时候", "default address of", "那次 工作", "latest status of", "a private matter of",
]


def _first(text: Column, classes: list, default: str) -> Column:
    return reduce(lambda acc, kv: acc.when(kv[1].column(text), F.lit(kv[0])), classes, F).otherwise(F.lit(default))


def _case_sql(name: str, classes: list, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {rule.sql(name)} THEN '{label}'" for label, rule in classes) + f" ELSE '{default}' END"


def time_mode(text: Column) -> Column:
    return _first(text, TIME_MODES, "current")


def domain(text: Column) -> Column:
    return _first(text, DOMAINS, "relationship")


def ability(text: Column) -> Column:
    return _first(text, ABILITIES, "direct_fact")


def evidence_need(text: Column) -> Column:
    return _first(text, NEEDS, "exact_observation")


def signals(text: Column) -> Column:
    """All signals of a question in order; exact_fact where it has none."""
    found = F.array_compact(F.array(*[F.when(rule.column(text), F.lit(name)) for name, rule in SIGNALS]))
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(F.lit("exact_fact"))).otherwise(found)


def time_mode_sql(name: str) -> str:
    return _case_sql(name, TIME_MODES, "current")


def domain_sql(name: str) -> str:
    return _case_sql(name, DOMAINS, "relationship")


def ability_sql(name: str) -> str:
    return _case_sql(name, ABILITIES, "direct_fact")


def need_sql(name: str) -> str:
    return _case_sql(name, NEEDS, "exact_observation")


def signals_sql(name: str) -> str:
    parts = ", ".join(f"CASE WHEN {rule.sql(name)} THEN '{label}' END" for label, rule in SIGNALS)
    return f"CASE WHEN trim({name}) = '' THEN '' ELSE coalesce(nullif(concat_ws(',', {parts}), ''), 'exact_fact') END"


def suppresses_anchors(text: Column) -> Column:
    """Questions about forgetting or deleting get no anchors."""
    return DELETING.column(text)


def anchor_gates(text: Column, ability_: Column, need: Column) -> dict[str, Column]:
    """Which anchor sources a question may use."""
    open_ = ~suppresses_anchors(text)
    arcs = ability_.isin("relationship_arc", "dynamic_state") & need.isin("state_transition", "relationship_timeline")
    return {
        "pinned_core": open_ & ability_.isin(PINNED_ABILITIES),
        "recent_important": open_ & ability_.isin(RECENT_ABILITIES),
        "narrative_insight": open_ & (arcs | ability_.isin(NARRATIVE_ABILITIES)),
    }


def protects_raw_floor(ability_: Column, signals_: Column) -> Column:
    return (ability_ == "direct_fact") | F.array_contains(signals_, "past_event_direct_fact")


def noisy_or(values: Column) -> Column:
    """1 - product of (1 - p) over an array."""
    return 1 - F.aggregate(values, F.lit(1.0), lambda a, p: a * (1 - clamp01(p)))


def anchor_readiness(confidences: Column, ambiguity: Column, margin: Column, hits: Column) -> Column:
    """Noisy-or of the probes' confidences, damped by ambiguous entities and close calls."""
    damped = noisy_or(confidences) * F.when(ambiguity > 0.6, 0.75).otherwise(1.0)
    return clamp01(damped * F.when((margin < 0.08) & (hits > 5), 0.85).otherwise(1.0))


def semantic_need(fit: Column, readiness: Column, complexity: Column, ambiguity: Column, causal: Column) -> Column:
    need = clamp01(0.35 * (1 - fit) + 0.25 * (1 - readiness) + 0.25 * complexity + 0.15 * ambiguity)
    return F.when(causal & (readiness < 0.50), F.greatest(need, F.lit(0.60))).otherwise(need)


def route(need: Column, fit: Column, readiness: Column, complexity: Column, safety: Column) -> Column:
    """Where a question goes: rules alone, or one of three depths of semantic analysis."""
    wanted = (need >= LEAST_NEED) | (fit < LEAST_FIT) | ((readiness < LEAST_READINESS) & (complexity >= LEAST_COMPLEXITY))
    return (
        F.when(safety >= HIGH_RISK, "rule")
        .when(~wanted, "rule")
        .when(complexity >= DECOMPOSE_COMPLEXITY, "semantic_decompose")
        .when(complexity >= FULL_COMPLEXITY, "semantic_full")
        .otherwise("semantic_light")
    )


# Retrieval modes and reasons by ability, thresholds of the reasons.
RETRIEVAL_MODES = {
    "boundary": "target_resolver", "causal_explain": "graph_contextual", "relationship_arc": "graph_contextual", "historical": "historical",
    "dynamic_state": "historical", "provenance": "provenance", "premise_check": "premise_check",
}
INTENT_REASONS = {
    "causal_explain": "causal_intent", "historical": "historical_intent", "provenance": "provenance_intent", "premise_check": "premise_check_intent",
    "relationship_arc": "relationship_arc_intent", "boundary": "boundary_or_forget_intent", "direct_fact": "direct_fact_intent",
}
LEAST_READINESS, LEAST_NEED, LEAST_FIT, LEAST_COMPLEXITY = 0.45, 0.58, 0.66, 0.50
FULL_COMPLEXITY, DECOMPOSE_COMPLEXITY, HIGH_RISK = 0.72, 0.80, 0.80


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def retrieval_mode(ability_: Column, n_mentions: Column, predicate_confidence: Column) -> Column:
    """How the rules alone would search: by ability; direct facts exactly where an entity or predicate is known."""
    known = (n_mentions > 0) | (predicate_confidence >= 0.60)
    return F.when((ability_ == "direct_fact") & known, "exact").otherwise(F.coalesce(_lookup(ability_, RETRIEVAL_MODES), F.lit("hybrid")))


def rule_reasons(ability_: Column, n_mentions: Column, readiness: Column, default_penalty: Column, ambiguity: Column, risk: Column) -> Column:
    """Reason codes of the rules' decision, in order."""
    return F.array_compact(
        F.array(
            _lookup(ability_, INTENT_REASONS),
            F.when(n_mentions > 0, "entity_resolved"),
            F.when(readiness < LEAST_READINESS, "weak_anchor").otherwise("anchor_ready"),
            F.when(default_penalty >= 0.60, "default_fallback"),
            F.when(ambiguity >= 0.50, "ambiguous_reference"),
            F.when(risk >= 0.50, "safety_risk"),
        )
    )


def alternatives(text: Column, ability_: Column, domain_: Column) -> Column:
    """array<struct<field, value, confidence, reasons>>: other readings of a question that its words allow."""

    def reading(field: str, value: str, confidence: float, *reasons: str) -> Column:
        return F.struct(
            F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, reasons)).alias("reasons")
        )

    vague = (ability_ == "direct_fact") & VAGUE_TIME.column(text)
    at_work = (domain_ == "relationship") & WORKING.column(text)
    return F.array_compact(
        F.array(
            F.when(vague, reading("memory_ability", "historical", 0.55, "ambiguous_reference", "temporal_marker")),
            F.when(vague, reading("time_mode", "historical", 0.50, "ambiguous_reference", "temporal_marker")),
            F.when(at_work, reading("memory_domain", "work_experience", 0.50, "weak_work_domain_signal")),
        )
    )


def semantic_decision(
    text: Column, ability_: Column, signals_: Column, need: Column, fit: Column, readiness: Column, complexity: Column, risk: Column, full: bool = False
) -> Column:
    """struct<semantic_mode, retrieval_mode, reasons>: whether a question goes on to semantic analysis, how deep and why.

    ``full`` allows the middle depth. Empty questions, questions about forgetting and
    sensitive ones never go on. Scores that are not in [0, 1] count as absent for need and risk.
    """
    unit = lambda c: ~F.isnan(c) & c.between(0, 1)
    cause = (
        F.when(unit(need) & (need >= LEAST_NEED), "semantic_need_high")
        .when(fit < LEAST_FIT, "rule_fit_low")
        .when((readiness < LEAST_READINESS) & (complexity >= LEAST_COMPLEXITY), "anchor_readiness_low")
    )
    weak = readiness <= LEAST_READINESS
    causal = ability_ == "causal_explain"
    depth = F.when((causal & weak) | (complexity >= DECOMPOSE_COMPLEXITY), "semantic_decompose")
    depth = (depth.when(complexity >= FULL_COMPLEXITY, "semantic_full") if full else depth).otherwise("semantic_light")

    def decision(mode, retrieval, reasons: Column) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(as_column(mode).alias("semantic_mode"), as_column(retrieval).alias("retrieval_mode"), reasons.alias("reasons"))

    codes = F.array_compact(F.array(F.when(causal, "causal_intent"), F.when(weak, "weak_anchor"), cause))
    return (
        F.when(F.trim(text) == "", decision("none", "rule", F.array(F.lit("empty_query"))))
        .when(F.array_contains(signals_, "forget_delete") | (ability_ == "boundary"), decision("target_resolver", "target_resolver", F.array(F.lit("forget_or_delete_intent"))))
        .when(F.array_contains(signals_, "sensitivity") | (unit(risk) & (risk >= HIGH_RISK)), decision("none", "rule", F.array(F.lit("safety_policy_first"))))
        .when(cause.isNotNull(), decision(depth, F.when(causal & weak, "graph_contextual").otherwise("semantic"), codes))
        .otherwise(decision("none", "rule", F.array(F.lit("rule_and_anchor_sufficient"))))
    )


def spend_weights(weights: Column, budget: float = 3.0, low: float = 0.1, high: float = 0.9) -> Column:
    """Generated weights, clamped, spent in order from a budget: each takes what is left at most.

    What is left is the budget less the sum of the weights before, so that it is rounded as a running sum is; taking weights
    off one by one may end on the other side of ``low``.
    """
    start = F.struct(F.lit(0.0).alias("before"), F.array().cast("array<double>").alias("out"))

    def spend(acc: Column, w: Column) -> Column:
        most, left = F.least(F.greatest(w, F.lit(low)), F.lit(high)), F.lit(float(budget)) - acc["before"]
        take = F.when(left < low, 0.0).otherwise(F.least(most, left))
        return F.struct((acc["before"] + most).alias("before"), F.concat(acc["out"], F.array(take)).alias("out"))

    return F.aggregate(weights, start, spend, lambda acc: acc["out"])


#: The weights of a rule analysis' parts.
FIT_GAINS = {"intent": 0.18, "consistency": 0.14, "entity": 0.13, "time": 0.10, "domain": 0.09, "need": 0.08, "specificity": 0.08}
FIT_LOSSES = {"default": 0.15, "ambiguity": 0.12, "conflict": 0.08, "sensitivity": 0.06}


def rule_fit(parts: dict[str, Column]) -> Column:
    """How well the rules understood a question, from parts in [0, 1]; missing parts count 0."""
    total = F.lit(0.20)
    for name, weight in FIT_GAINS.items():
        total = total + weight * parts.get(name, F.lit(0.0))
    for name, weight in FIT_LOSSES.items():
        total = total - weight * parts.get(name, F.lit(0.0))
    return clamp01(total)


def expected_confidence(fit: Column, readiness: Column, safety: Column) -> Column:
    return clamp01(0.60 * fit + 0.40 * readiness - 0.10 * safety)


def merge_field(rule: Column, semantic: Column, rule_confidence: Column, semantic_confidence: Column, has_evidence: Column) -> Column:
    """The semantic value of a field where it is sure enough and clearly surer than the rule's."""
    wins = semantic.isNotNull() & has_evidence & (semantic_confidence >= 0.70) & (semantic_confidence - rule_confidence >= 0.08)
    return F.when(wins, semantic).otherwise(rule)


def probe_confidence(kind: str, top: Column, n: Column) -> Column:
    """Confidence of an anchor probe from the best importance and the count of what it found."""
    found = {
        "predicate": F.when(top > 0, 0.70 + 0.20 * top).otherwise(0.20 + F.least(F.lit(0.15), 0.05 * n)),
        "recent": 0.25 + 0.25 * top,
        "pinned": 0.35 + 0.25 * top,
        "narrative": 0.20 + 0.25 * top,
    }[kind]
    return F.when(n > 0, clamp01(found)).otherwise(0.0)
