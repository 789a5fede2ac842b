"""From scored facts to a context: query-conditional adjustments, floors, blocks, sources and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..functions import text as T
from ..functions.text import contains_any
from .search import top_k

# Words that tell questions apart too little, markers of summaries and of change.
LOW_TERMS = [
    "什么", "什么事", "什么时候", "哪里", "哪次", "谁", "多久", "怎么", "为什么", "是否", "是不是", "有没有", "有无", "上次", "那天", "那次", "最近", "最近一次", "一次",
    "以前", "过去", "现在", "后来", "当前", "我", "你", "他", "她", "它", "我们", "他们", "the", "and", "or", "who", "what", "when", "where", "why", "how",
]
HUB_MARKERS = ["summary", "overall", "relationship", "pattern", "theme", "stable", "总结", "整体", "关系", "模式", "主题", "长期", "稳定", "通常", "经常", "倾向"]
REFLECTION_MARKERS = ["reflection", "growth", "progress", "self_reflection", "growth_summary", "反思", "复盘", "成长", "进步", "变化", "调整", "改善", "主动"]
POSITIVE_MARKERS = [
    "后来", "现在", "已经", "开始", "尝试", "做到", "做了", "做过", "变得", "改善", "好转", "恢复", "坚持", "主动", "成功", "可以", "能够",
    "counterexample", "exception", "now", "later", "started", "improved", "resolved", "able",
]
NEGATIONS = ["不会", "不能", "不再", "没有", "没", "不是", "不", "从来", "完全", "一点", "任何", "每个", "所有", "只有", "再也", "never", "no ", "not ", "nothing", "only ", "always "]
CONCEPT_GROUPS = [
    (["做饭", "做菜", "下厨", "厨房", "cooking", "cook"], ["做饭", "做菜", "下厨", "做了", "做过", "会做", "在家做"]),
    (["运动", "锻炼", "健身", "exercise", "workout"], ["运动", "锻炼", "健身", "开始运动", "坚持锻炼", "运动习惯"]),
    (["改变", "变化", "老样子", "change", "same"], ["改变", "变化", "改善", "调整", "进步", "翻篇"]),
    (["朋友", "关系", "矛盾", "吵架", "人际", "friend", "relationship", "conflict"], ["和解", "道歉", "互相理解", "关系修复", "支持", "一起"]),
    (["睡", "失眠", "睡眠", "sleep", "insomnia"], ["睡着", "睡眠改善", "睡得", "好转"]),
]


def slot_terms(query: Column) -> Column:
    """Terms of a question that tell facts apart; CJK pairs where no field does."""

    def telling(t: Column) -> Column:
        return (F.length(t) >= 2) & ~t.isin(LOW_TERMS) & t.rlike(r"^[\p{L}\p{N}\s]*[\p{L}\p{N}][\p{L}\p{N}\s]*$")

    good = F.filter(T.fields(query), telling)
    return F.when(F.size(good) > 0, good).otherwise(F.filter(T.cjk_bigrams(query), telling))


def slot_coverage(terms: Column, low_text: Column) -> Column:
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(low_text, t))) / F.size(terms))


def slot_boost(protects: Column, coverage: Column) -> Column:
    return F.when(protects, 0.16 * coverage).otherwise(0.0)


def hub_penalty(protects: Column, reflective: Column, bundled: Column, slot: Column, lexical: Column, fact_type: Column, low_text: Column, broad_source: Column) -> Column:
    """Broad summaries step back for direct questions that they don't answer in words."""
    broad = fact_type.isin("relational_state", "core_identity") | contains_any(low_text, HUB_MARKERS) | broad_source
    exempt = ~protects | reflective | bundled | (slot >= 0.50) | (lexical >= 0.75)
    return F.when(~exempt & broad, 0.45).otherwise(0.0)


def reflection_boost(reflective: Column, low_text: Column, from_narrative: Column) -> Column:
    return F.when(~reflective, 0.0).when(contains_any(low_text, REFLECTION_MARKERS), 0.30).when(from_narrative, 0.20).otherwise(0.0)


def premise_expansions(query: Column) -> Column:
    """Search terms that may contradict a negated question: positive markers, and the concept groups that it touches."""
    low = F.lower(F.trim(query))
    groups = [F.when(contains_any(low, triggers), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")) for triggers, more in CONCEPT_GROUPS]
    every = F.concat(F.array(*map(F.lit, POSITIVE_MARKERS)), *groups)
    return F.when(contains_any(low, NEGATIONS), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


# Words of facts that contradict a premise, that tell of good work, that tell how a relationship went; bonuses.
CONTRADICTING = ["不能吃辣", "不太能吃辣", "辛辣耐受度低", "不能暴露", "不能把", "禁止", "不要", "不得", "不允许", "不是所有", "反例", "例外"]
GOOD_WORK = ["side project", "开始做", "充实", "积极", "正面", "进展", "推进"]
OUTCOMES = ["feels_with_agent", "relational_state", "companionship", "less lonely", "不孤独", "没那么孤独", "陪伴"]
#: Words of questions that ask for the good sides of hard work.
STRAIN, GOOD_SIDES = ["焦虑", "负面", "消极"], ["积极", "正面", "变化"]
PREMISE_BONUS, GOOD_WORK_BONUS, OUTCOME_BONUS = 0.20, 0.25, 0.22
#: Expansions that too many facts hold to contradict anything.
WEAK_EXPANSIONS = [*POSITIVE_MARKERS, "下厨"]


def text_bonus(ability: Column, need: Column, low_question: Column, low_fact: Column, fact_type: Column, restates: Column, by_counterexample_search: Column) -> Column:
    """What the words of a fact add to its completion bonus.

    Premise checks favour facts that contradict the premise, more so if the question asks for
    good sides of hard work; questions about a relationship's course favour outcomes.
    ``restates``: the fact repeats the premise, and so contradicts it by a ban only.
    """
    hard_work = F.contains(low_question, F.lit("工作")) & contains_any(low_question, STRAIN) & contains_any(low_question, GOOD_SIDES)
    good_work = hard_work & contains_any(low_fact, GOOD_WORK)
    expanded = F.exists(premise_expansions(low_question), lambda e: ~e.isin(WEAK_EXPANSIONS) & F.contains(low_fact, e))
    contradicts = by_counterexample_search | contains_any(low_fact, CONTRADICTING) | (~restates & (expanded | good_work))
    premise = (ability == "premise_check") & (need == "premise_counterexample") & contradicts
    course = ability.isin("relationship_arc", "dynamic_state") & need.isin("state_transition", "relationship_timeline")
    outcome = (fact_type == "relational_state") | contains_any(low_fact, OUTCOMES)
    return (
        F.when(premise, PREMISE_BONUS + F.when(good_work, GOOD_WORK_BONUS).otherwise(0.0)).otherwise(0.0)
        + F.when(course & outcome, OUTCOME_BONUS).otherwise(0.0)
    )


# Words that take a premise back, and words that repeat one.
TAKING_BACK = ["不再", "不是所有", "反例", "例外", "恢复", "解决", "和解", "不能暴露", "不能把", "禁止", "不要", "不得", "不允许"]
REPEATING = ["不会", "不能", "没有", "没", "不是", "不", "从来", "完全", "一点", "任何", "每个", "所有", "只有", "never", "not ", "no "]


def restates_premise(ability: Column, need: Column, question: Column, low_fact: Column) -> Column:
    """A fact that repeats the premise which a question wants to see contradicted: it negates like it,
    takes nothing back, and touches the question's CJK pairs, if it has any."""
    pairs = T.cjk_bigrams(question)
    touches = (F.size(pairs) == 0) | F.exists(pairs, lambda p: F.contains(low_fact, p))
    negates = contains_any(low_fact, REPEATING) & ~contains_any(low_fact, [*POSITIVE_MARKERS, *TAKING_BACK])
    return (ability == "premise_check") & (need == "premise_counterexample") & (F.trim(low_fact) != "") & negates & touches


def raw_floor(candidates: DataFrame, n: int = 4, exact: int = 2) -> DataFrame:
    """``candidates``: query_id, fact_id, source, score, exact_need. The protected ones: up to n of raw_dense,
    filled up from raw_query, and the best exact matches where the question needs an observation."""
    by = W.partitionBy("query_id", "source").orderBy(F.desc("score"), F.asc("fact_id"))
    ranked = candidates.filter(F.col("source").isin("raw_dense", "raw_query", "raw_exact")).withColumn("r", F.row_number().over(by))
    dense = ranked.filter((F.col("source") == "raw_dense") & (F.col("r") <= n))
    have = dense.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    fill = ranked.filter(F.col("source") == "raw_query").join(have, "query_id", "left").filter(F.col("r") <= n - F.coalesce("have", F.lit(0))).drop("have")
    sharp = ranked.filter((F.col("source") == "raw_exact") & F.col("exact_need") & (F.col("r") <= exact))
    return dense.unionByName(fill).unionByName(sharp).select("query_id", "fact_id").distinct()


#: Generated texts that say nothing.
GENERIC = ["memory", "memories", "remembered context", "context", "semantic memory", "relationship expansion", "记忆", "相关记忆", "上下文"]


def dense_plan(generated: DataFrame, rewrites: int = 3, anchors: int = 2) -> DataFrame:
    """``generated``: query_id, kind (rewrite or anchor), place, text, weight, purpose, raw_text, forgets. The
    fate of each text: accepted, or why it is dropped, in the order of the rules.

    Later texts count only earlier accepted ones, so a running count over those that
    pass all other rules gives the caps.
    """
    text, raw = T.normalize(F.col("text")), T.normalize(F.col("raw_text"))
    similar = (text == raw) | (T.jaccard(T.word_tokens(text), T.word_tokens(raw)) >= 0.85)
    rewrite = F.col("kind") == "rewrite"
    forgets = F.col("forgets") & (~rewrite | (F.col("purpose") != "operation_target"))
    reason = F.when(F.coalesce(text, F.lit("")) == "", "empty").when(similar, "similar").when(forgets, "forget_delete").when(text.isin(GENERIC), "generic")
    order = [F.when(rewrite, 0).otherwise(1), "place"]
    rows = generated.withColumns({"normalized": text, "reason": reason})
    first = F.row_number().over(W.partitionBy("query_id", "normalized", F.col("reason").isNull()).orderBy(*order))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(first > 1, "duplicate")))
    place = F.row_number().over(W.partitionBy("query_id", "kind", F.col("reason").isNull()).orderBy("place"))
    cap = F.when(rewrite, rewrites).otherwise(anchors)
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(place > cap, "fanout_limit"), F.lit("accepted")))
    weight = F.when(rewrite, F.least(F.greatest("weight", F.lit(0.1)), F.lit(0.9))).otherwise(F.least(F.greatest("weight", F.lit(0.1)), F.lit(0.65)))
    return rows.select("query_id", "kind", "place", "reason", F.round(weight, 6).alias("weight"))


def source_refs(links: DataFrame, episodes: DataFrame, n: int = 2) -> DataFrame:
    """fact_id, refs (the first n visible sources by time), n_sources."""
    seen = episodes.filter("visibility_status = 'visible' AND searchable").select("episode_id", "at_s")
    cites = links.filter("link_type = 'EVIDENCED_BY' AND visibility_status = 'visible' AND searchable").select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("episode_id")).distinct()
    rows = cites.join(seen, "episode_id")
    counts = rows.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n_sources"))
    first = top_k(rows, n, [F.asc("at_s"), F.asc("episode_id")], "fact_id", "r").groupBy("fact_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "episode_id"))), lambda x: x["episode_id"].cast("string")), ",").alias("refs"))
    return first.join(counts, "fact_id")


def related_facts(links: DataFrame, types: list[str], n: int = 2) -> DataFrame:
    """fact_id, related_id, way: the n strongest links of each fact, in either direction."""
    typed = links.filter(F.col("link_type").isin(types) & (F.col("to_type") == "fact")).filter("visibility_status = 'visible' AND searchable")
    out = typed.select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("related_id"), "weight", "link_id", F.lit("out").alias("way"))
    into = typed.select(F.col("to_id").alias("fact_id"), F.col("from_id").alias("related_id"), "weight", "link_id", F.lit("in").alias("way"))
    both = out.unionByName(into).filter("fact_id <> related_id")
    return top_k(both, n, [F.desc(F.abs("weight")), F.asc("link_id"), F.asc("way"), F.asc("related_id")], "fact_id").select("fact_id", "related_id", "way", "rank_position")


def block_type(ability: Column, need: Column, signals: Column, superseding: Column, n_sources: Column) -> Column:
    """The context block of a selected fact; the first rule that applies."""
    has = lambda *s: F.arrays_overlap(signals, F.array(*map(F.lit, s)))
    direct = (ability == "direct_fact") | (need == "exact_observation") | has("exact_fact", "past_event_direct_fact")
    return (
        F.when(ability.isin("supportive", "boundary") | has("forget_delete"), "supportive_memory")
        .when((need == "provenance_source") | has("provenance_source", "provenance"), "provenance_memory")
        .when(superseding | (~direct & ((need == "state_transition") | has("state_transition"))), "historical_transition_memory")
        .when(has("causal", "causal_chain"), "relevant_causal_memory")
        .when((need == "premise_counterexample") | has("premise_counterexample"), "premise_check_memory")
        .when((need == "relationship_timeline") | has("relationship_arc"), "relationship_arc_memory")
        .when(ability.isin("gotcha", "workflow"), "experience_context")
        .when(~direct & (n_sources > 0), "provenance_memory")
        .otherwise("facts")
    )


def map_candidates(candidates: DataFrame, index_map: DataFrame, facts: DataFrame) -> DataFrame:
    """``candidates``: node_key, score; ``index_map``: node_key, node_type, node_id, index_status. Each candidate with the
    fact it means, or why it is dropped."""
    known = facts.select(F.col("fact_id").alias("node_id"), (F.col("visibility_status") == "visible").alias("allowed"))
    rows = candidates.join(index_map, "node_key", "left").join(known, "node_id", "left")
    reason = (
        F.when(F.col("score").isNull() | (F.col("score") <= 0), "invalid_candidate")
        .when(F.col("index_status").isNull(), "unmapped_node")
        .when(F.col("index_status") != "indexed", F.concat(F.lit("stale_mapping_status_"), "index_status"))
        .when(F.col("node_type") != "fact", "non_fact_candidate")
        .when(~F.coalesce("allowed", F.lit(False)), "dropped_by_authority_filter")
        .otherwise("kept")
    )
    return rows.select("node_key", reason.alias("drop_reason"))


#: Tokens of a source reference; references and relations of an item; links that a block's items relate by.
REF_TOKENS, MOST_REFS, MOST_RELATED = 6, 2, 2
CAUSAL_RELATIONS, HISTORY_RELATIONS = ["CAUSED_BY", "CONTRIBUTED_TO", "EXPLAINS", "SUPPORTS", "TRIGGERED_BY"], ["SUPERSEDES"]


def items(selected: DataFrame, questions: DataFrame, facts: DataFrame, links: DataFrame, episodes: DataFrame) -> DataFrame:
    """query_id, fact_id, rank_position, block, block_place, tokens, refs, related: the selected facts as items of context blocks.

    ``questions`` and ``facts`` as ``recall`` makes them. Only sources that may be shown and related facts that the question may be shown are named;
    a fact counts as replaced only if a fact that may be shown replaces it. Blocks stand in the order of their first items.
    """
    asked = questions.select("query_id", "persona_id", "allow_historical", "ability", "need", "signals")
    mine = selected.join(asked, "query_id").join(facts.select("fact_id", "content_summary", "persona_id"), ["fact_id", "persona_id"])
    shown = facts.select(F.col("fact_id").alias("other_id"), F.col("persona_id").alias("other_persona"), F.col("past").alias("other_past"), S.estimate_tokens(F.col("content_summary")).alias("cost"))
    may = (F.col("other_persona") == F.col("persona_id")) & (~F.col("other_past") | F.col("allow_historical"))
    typed = links.filter("visibility_status = 'visible' AND searchable AND to_type = 'fact' AND from_id <> to_id").filter(F.col("link_type").isin(CAUSAL_RELATIONS + HISTORY_RELATIONS))
    out = typed.select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("other_id"), "link_type", "weight", "link_id", F.lit("outbound").alias("way"))
    into = typed.select(F.col("to_id").alias("fact_id"), F.col("from_id").alias("other_id"), "link_type", "weight", "link_id", F.lit("inbound").alias("way"))
    near = mine.select("query_id", "fact_id", "persona_id", "allow_historical").join(out.unionByName(into), "fact_id").join(shown, "other_id").filter(may)
    replaced = near.filter("link_type = 'SUPERSEDES' AND way = 'inbound'").select("query_id", "fact_id", F.lit(True).alias("replaced")).distinct()

    seen = episodes.filter("visibility_status = 'visible' AND searchable AND sensitivity_level = 'normal'").select("episode_id", "at_s")
    cites = links.filter("link_type = 'EVIDENCED_BY' AND visibility_status = 'visible' AND searchable").select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("episode_id")).distinct()
    cites = cites.join(mine.select("fact_id").distinct(), "fact_id", "left_semi").join(seen, "episode_id")
    refs = top_k(cites, MOST_REFS, [F.asc("at_s"), F.asc("episode_id")], "fact_id", "r").groupBy("fact_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "episode_id"))), lambda x: x["episode_id"]).alias("refs"))

    rows = mine.join(replaced, ["query_id", "fact_id"], "left").join(refs, "fact_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<bigint>")))
    kind = block_type(F.col("ability"), F.col("need"), F.col("signals"), F.coalesce("replaced", F.lit(False)), F.size("refs"))
    rows = rows.withColumn("block", kind).withColumn("block_place", F.min("rank_position").over(W.partitionBy("query_id", "block")))
    fits = ((F.col("block") == "relevant_causal_memory") & F.col("link_type").isin(CAUSAL_RELATIONS)) | ((F.col("block") == "historical_transition_memory") & F.col("link_type").isin(HISTORY_RELATIONS))
    related = near.join(rows.select("query_id", "fact_id", "block"), ["query_id", "fact_id"]).filter(fits)
    related = top_k(related, MOST_RELATED, [F.desc(F.abs("weight")), F.asc("link_id"), F.desc("way"), F.asc("other_id")], ["query_id", "fact_id"], "r")
    entry = F.struct((F.col("way") != "outbound").alias("inbound"), "other_id", "link_type", "cost")
    related = related.groupBy("query_id", "fact_id").agg(F.sort_array(F.collect_list(entry)).alias("related"))
    rows = rows.join(related, ["query_id", "fact_id"], "left").withColumn("related", F.coalesce("related", F.array().cast(related.schema["related"].dataType)))
    return rows.select("query_id", "fact_id", "rank_position", "block", "block_place", S.estimate_tokens(F.col("content_summary")).alias("tokens"), "refs", "related")


def trimmed(rows: DataFrame, budget: int) -> DataFrame:
    """``items`` within a budget of tokens per question: from the last item of the last block on, an item first gives its related facts back, the last first,
    then its references, as long as the rest is over the budget. Summaries stay. What is given back before a piece is a running sum.
    """
    piece = lambda kind, cost: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(kind), F.lit(1))), lambda i: F.struct(F.lit(0 if kind == "related" else 1).alias("turn"), (-i).alias("from_end"), cost(i).alias("cost"))
    )
    pieces = F.concat(
        F.filter(piece("related", lambda i: F.get("related", i - 1)["cost"]), lambda x: -x["from_end"] <= F.size("related")),
        F.filter(piece("refs", lambda i: F.lit(REF_TOKENS).cast("bigint")), lambda x: -x["from_end"] <= F.size("refs")),
    )
    single = rows.select("query_id", "fact_id", "block_place", "rank_position", F.explode(pieces).alias("p")).select("query_id", "fact_id", "block_place", "rank_position", "p.*")
    spent = rows.select("query_id", F.col("tokens").alias("cost")).unionByName(single.select("query_id", "cost")).groupBy("query_id").agg(F.sum("cost").alias("total"))
    back = W.partitionBy("query_id").orderBy(F.desc("block_place"), F.desc("rank_position"), "turn", "from_end").rowsBetween(W.unboundedPreceding, -1)
    kept = single.withColumn("before", F.coalesce(F.sum("cost").over(back), F.lit(0))).join(spent, "query_id").filter(F.col("total") - F.col("before") <= budget)
    counts = kept.groupBy("query_id", "fact_id").agg(F.count_if(F.col("turn") == 0).cast("int").alias("n_related"), F.count_if(F.col("turn") == 1).cast("int").alias("n_refs"))
    out = rows.join(counts, ["query_id", "fact_id"], "left").fillna(0, ["n_related", "n_refs"])
    return out.withColumns({"related": F.slice("related", F.lit(1), F.col("n_related")), "refs": F.slice("refs", F.lit(1), F.col("n_refs"))}).drop("n_related", "n_refs")
