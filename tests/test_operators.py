"""Hand-made cases: truth tables, graphs and folds computed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from engramix.functions import scalars as S
from engramix.functions import text as T
from engramix.operators import analysis, completion, context, fusion, graph, metrics, mutations, scoring


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    got = one(spark, S.recency(at("2024-01-02 00:00:00"), now), S.recency(at(None), now), S.recency(at("2025-01-01 00:00:00"), now), S.estimate_tokens(F.lit("")), S.estimate_tokens(F.lit("abcde")), S.sensitivity_rank(F.lit("odd")))
    assert got == (0.5, 0.5, 1.0, 1, 10, 3)
    assert math.isclose(one(spark, S.evidence_strength(F.lit(0.0), F.lit(3), F.lit(False), F.lit(0)))[0], 0.45 * 0.5 + 0.25 + 0.2)
    assert one(spark, S.clamp01(F.lit(float("nan"))), S.clamp01(F.lit(2.0)), S.clamp01(F.lit(-1.0))) == (0.0, 1.0, 0.0)


def test_text(spark):
    lit = F.lit
    assert one(spark, T.cjk_bigrams(lit("我喜欢 abc かな")))[0] == ["我喜", "喜欢", "かな"]
    assert one(spark, T.word_tokens(lit("Ab_1 中文-x")))[0] == ["ab_1", "中", "文", "x"]
    assert one(spark, T.match_score(lit("red cat"), lit("a RED dog")), T.match_score(lit("red cat"), lit("my red cat")), T.match_score(lit(""), lit("x"))) == (0.5, 1.0, 0.0)
    assert one(spark, T.join_unique(F.array(lit("Likes tea"), lit("TEA"), lit(None), lit(" milk "))))[0] == "Likes tea milk"
    assert one(spark, T.object_key(lit(None).cast("long"), lit("  Green  Tea ")), T.object_key(lit(5), lit("x"))) == ("literal:green tea", "entity:5")


def test_activation(spark):
    """fact:1 -> fact:2 -> fact:3, by hand."""
    links = spark.createDataFrame(
        [(1, "CAUSED_BY", "fact", 2, "forward", 1.0), (2, "CAUSED_BY", "fact", 3, "forward", 1.0), (1, "EVIDENCED_BY", "episode", 9, "forward", 1.0)],
        "from_id long, link_type string, to_type string, to_id long, direction string, weight double",
    )
    seeds = spark.createDataFrame([(1, "fact:1", 1.0)], "query_id long, node string, energy double")
    got = {r.node: r.energy for r in graph.activate(seeds, links).collect()}
    first = 0.7 / math.sqrt(2)
    assert got == {"fact:1": 1.0, "fact:2": round(first, 6), "fact:3": round(first * 0.7, 6)}


def test_activation_of_repeated_and_tiny_seeds(spark):
    """Of a node's seeds the largest counts, and energies below 0.01 are not returned."""
    links = spark.createDataFrame([(1, "CAUSED_BY", "fact", 2, "forward", 1.0)], "from_id long, link_type string, to_type string, to_id long, direction string, weight double")
    seeds = spark.createDataFrame([(1, "fact:1", 0.4), (1, "fact:1", 0.3), (1, "fact:9", 0.001)], "query_id long, node string, energy double")
    assert {r.node: r.energy for r in graph.activate(seeds, links).collect()} == {"fact:1": 0.4, "fact:2": 0.28}


def test_rrf_caps_and_priors(spark):
    hits = [(1, "entity_exact", "fact", 1, 1), (1, "fts", "fact", 1, 2), (1, "fts", "insight", 2, 1), (1, "fts", "fact", 3, 41)]
    got = {r.node_id: (r.score, r.seed_energy) for r in fusion.fuse_anchors(spark.createDataFrame(hits, "query_id long, source string, node_type string, node_id long, rank_position int")).collect()}
    top = 2 / 61 + 1 / 62
    assert got == {1: (round(top, 6), 1.0), 2: (round(1 / 61, 6), round(1 / 61 / top * 1.1, 6))}


def candidates(spark, rows):
    base = dict(entity_ids=[1], predicate="p", episode_ids=[1], validity="valid", lifecycle="active")
    data = [(1, {"score": s, "fact_id": i, "tokens": t, "terms": terms, **base}) for i, s, t, terms in rows]
    kind = "struct<score:double,fact_id:bigint,tokens:bigint,terms:array<string>,entity_ids:array<bigint>,predicate:string,episode_ids:array<bigint>,validity:string,lifecycle:string>"
    return spark.createDataFrame(data, f"query_id long, c {kind}")


def test_mmr_drops_duplicates_and_skips_what_does_not_fit(spark):
    rows = candidates(spark, [(1, 0.9, 10, ["a", "b"]), (2, 0.89, 10, ["a", "b"]), (3, 0.5, 500, ["c"]), (4, 0.4, 10, ["d"])])
    got = [(r.fact_id, r.rank_position) for r in scoring.select_mmr(rows, 8, 100).orderBy("rank_position").collect()]
    assert got == [(1, 1), (4, 2)]
    assert [r.fact_id for r in scoring.select_mmr(rows, 1, 1000).collect()] == [1]
    assert scoring.select_mmr(rows.limit(0)).collect() == []


def fact_rows(spark, rows):
    return spark.createDataFrame(rows, "fact_id long, persona_id long, subject_entity_id long, predicate string, object_entity_id long, object_literal string, valid_from long, confidence double")


def test_consolidation(spark):
    schemas = spark.createDataFrame([("lives_in", "supersede"), ("likes", "coexist"), ("feels", "llm_check")], "predicate string, conflict_policy string")
    rows = [(1, 1, 1, "lives_in", None, "A", 1, 0.9), (2, 1, 1, "lives_in", None, "a ", 2, 0.9), (3, 1, 1, "lives_in", None, "B", 3, 0.9), (4, 1, 1, "lives_in", None, "A", 4, 0.9),
            (5, 1, 1, "likes", None, "tea", 1, 0.9), (6, 1, 1, "likes", None, "milk", 2, 0.9), (7, 1, 1, "likes", None, "tea", 3, 0.9), (8, 1, 1, "feels", None, "x", 1, 0.9), (9, 1, 1, "odd", None, "x", 1, 0.9), (10, 1, 1, "likes", None, "z", 9, 0.0)]
    got = {r.fact_id: r.action for r in mutations.consolidate(fact_rows(spark, rows), schemas).collect()}
    assert got == {1: "insert", 2: "reinforce", 3: "supersede", 4: "supersede", 5: "insert", 6: "coexist", 7: "reinforce", 8: "needs_review", 9: "reject", 10: "coexist"}
    # A refused candidate is never held: A, B (no object), A.
    odd = fact_rows(spark, [(1, 1, 1, "lives_in", None, "A", 1, 0.9), (2, 1, 1, "lives_in", None, " ", 2, 0.9), (3, 1, 1, "lives_in", None, "A", 3, 0.9)])
    assert {r.fact_id: r.action for r in mutations.consolidate(odd, schemas).collect()} == {1: "insert", 2: "reject", 3: "reinforce"}
    held = odd.limit(1).selectExpr("*", "'valid' AS validity_status", "'visible' AS visibility_status", "true AS searchable")
    assert {r.fact_id: r.action for r in mutations.consolidate(odd.filter("fact_id > 1"), schemas, held, discard=True).collect()} == {2: "reject", 3: "discard_duplicate"}
    gone = {r.fact_id: r.superseded_by for r in mutations.supersede(fact_rows(spark, rows[:4])).collect()}
    assert gone == {1: 3, 3: 4}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, node_id long, rank_position int")
    gold = spark.createDataFrame([(1, 11), (1, 12), (3, 1)], "query_id long, node_id long")
    got = {r.query_id: (r.recall_at_k, r.precision_at_k, r.reciprocal_rank, r.ndcg_at_k) for r in metrics.ranked_quality(ranked, gold, 8).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got == {1: (0.5, 0.5, 0.5, round(1 / math.log2(3) / ideal, 6)), 2: (1.0, 0.0, 0.0, 1.0), 3: (0.0, 0.0, 0.0, 0.0)}
    values = spark.createDataFrame([("a", v) for v in [1, 2, 2, 3, 10]] + [("b", None)], "g string, v long")
    assert [tuple(r) for r in metrics.nearest_rank(values, "g", "v", [50, 95]).collect()] == [("a", 2, 10)]


@pytest.mark.parametrize("text, want", [("what happened before", "historical"), ("hello", "current"), ("上次说的", "historical")])
def test_time_mode(spark, text, want):
    assert one(spark, analysis.time_mode(F.lit(text)))[0] == want


def test_readiness(spark):
    ready = analysis.anchor_readiness(F.array(F.lit(0.5), F.lit(0.5)), F.lit(0.7), F.lit(0.05), F.lit(6))
    assert math.isclose(one(spark, ready)[0], 0.75 * 0.75 * 0.85)


def test_dense_plan_counts_only_accepted_texts(spark):
    from engramix.operators import context as C

    rows = [(1, "rewrite", i, t, 2.0, "semantic_recall", "raw text here", False) for i, t in enumerate(["raw text here", "memory", "one", "ONE", "two", "three", "four", ""])]
    rows += [(1, "anchor", i, t, 2.0, "semantic_anchor", "raw text here", False) for i, t in enumerate(["one", "x", "y", "z"])]
    df = spark.createDataFrame(rows, "query_id int, kind string, place int, text string, weight double, purpose string, raw_text string, forgets boolean")
    got = {(r.kind, r.place): (r.reason, r.weight) for r in C.dense_plan(df).collect()}
    assert [got["rewrite", i][0] for i in range(8)] == ["similar", "generic", "accepted", "duplicate", "accepted", "accepted", "fanout_limit", "empty"]
    assert [got["anchor", i] for i in range(4)] == [("duplicate", 0.65), ("accepted", 0.65), ("accepted", 0.65), ("fanout_limit", 0.65)]


def test_raw_floor_fills_up(spark):
    from engramix.operators import context as C

    rows = [(1, i, "raw_dense", 1.0 - i / 10, True) for i in range(2)] + [(1, 10 + i, "raw_query", 0.5 - i / 10, True) for i in range(4)] + [(1, 20 + i, "raw_exact", 0.5 - i / 10, True) for i in range(3)]
    rows += [(2, 30 + i, "raw_exact", 0.5, False) for i in range(2)]
    df = spark.createDataFrame(rows, "query_id int, fact_id long, source string, score double, exact_need boolean")
    assert sorted((r.query_id, r.fact_id) for r in C.raw_floor(df).collect()) == [(1, 0), (1, 1), (1, 10), (1, 11), (1, 20), (1, 21)]


@pytest.mark.parametrize("text, ability, first", [
    ("从没有变成有", "historical", "state_transition"), ("what is the source", "provenance", "provenance_source"), ("forget it", "boundary", "forget_delete"),
    ("if it rains will it never", "premise_check", "premise_counterexample"), ("why so", "causal_explain", "causal"), ("上次 跟谁 什么时候", "direct_fact", "past_event_direct_fact"), ("tea", "direct_fact", "exact_fact")])
def test_abilities_and_signals(spark, text, ability, first):
    got = one(spark, analysis.ability(F.lit(text)), analysis.signals(F.lit(text)))
    assert got[0] == ability and got[1][0] == first


def test_spend_weights(spark):
    got = one(spark, analysis.spend_weights(F.array(*[F.lit(x) for x in (5.0, 0.9, 0.9, 0.9, 0.0)])))[0]
    assert [round(x, 6) for x in got] == [0.9, 0.9, 0.9, 0.3, 0.0]


def test_spent_weights_are_summed(spark):
    """3.0 - 2.9000000000000004 is below 0.1; taking the four weights off one by one leaves a little more than 0.1."""
    got = one(spark, analysis.spend_weights(F.array(*[F.lit(x) for x in (0.4, 0.9, 0.9, 0.7, 0.9)])))[0]
    assert got == [0.4, 0.9, 0.9, 0.7, 0.0]


def test_supersedes_insertion_keeps_the_length(spark):
    from engramix.operators import completion as K

    links = spark.createDataFrame([(1, "SUPERSEDES", "fact", 9, "visible", True, 1.0, 5), (2, "SUPERSEDES", "fact", 8, "hidden", True, 1.0, 6)],
                                  "from_id long, link_type string, to_type string, to_id long, visibility_status string, searchable boolean, weight double, link_id long")
    chosen = spark.createDataFrame([(1, i, i, False) for i in (1, 2, 3)], "query_id long, fact_id long, rank_position int, historical boolean")
    targets = chosen.select("query_id", F.col("fact_id").alias("source_id")).join(K.superseded(links), "source_id")
    assert [r.fact_id for r in K.insert_superseded(chosen, targets, 3).orderBy("rank_position").collect()] == [1, 9, 2]


def plain_mmr(rows, k, budget):
    """Greedy selection, one step after another."""

    def jac(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a and b else 0.0

    def sim(a, b):
        words = jac(a["terms"], b["terms"])
        s = (0.45 * words + 0.2 * jac(a["entity_ids"], b["entity_ids"]) + 0.15 * (a["predicate"] == b["predicate"]) + 0.1 * jac(a["episode_ids"], b["episode_ids"])) / 0.9
        same = a["validity"] == b["validity"] and a["lifecycle"] == b["lifecycle"]
        return s if words >= 0.8 and same else min(s, 0.8)

    rest, taken, used = list(rows), [], 0
    while rest and len(taken) < k:
        near = lambda c: max([sim(c, t) for t in taken], default=0.0)
        fit = [c for c in rest if near(c) <= 0.88 and used + c["tokens"] <= budget]
        if not fit:
            break
        best = max(fit, key=lambda c: (0.72 * c["score"] - 0.28 * near(c), c["score"], -c["fact_id"]))
        rest.remove(best)
        taken.append(best)
        used += best["tokens"]
    return [c["fact_id"] for c in taken]


def test_mmr_equals_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    data = []
    for q in range(6):
        for i in range(25):
            data.append((q, {
                "score": round(rng.random(), 4), "fact_id": 100 * q + i, "tokens": rng.randrange(8, 60), "terms": sorted(rng.sample("abcdefgh", rng.randrange(1, 5))),
                "entity_ids": [rng.randrange(3)], "predicate": rng.choice("pq"), "episode_ids": rng.sample(range(5), rng.randrange(3)), "validity": "valid", "lifecycle": rng.choice(["active", "dormant"])}))
    kind = "struct<score:double,fact_id:bigint,tokens:bigint,terms:array<string>,entity_ids:array<bigint>,predicate:string,episode_ids:array<bigint>,validity:string,lifecycle:string>"
    got = {}
    for r in scoring.select_mmr(spark.createDataFrame(data, f"query_id int, c {kind}"), 6, 150).orderBy("rank_position").collect():
        got.setdefault(r.query_id, []).append(r.fact_id)
    assert got == {q: plain_mmr([c for p, c in data if p == q], 6, 150) for q in range(6)}


def test_decisions(spark):
    schema = "t string, ability string, signals array<string>, need double, fit double, ready double, cx double, risk double"
    rows = [
        ("  ", "direct_fact", [], 0.9, 0.1, 0.1, 0.9, 0.0),
        ("a", "boundary", [], 0.9, 0.1, 0.1, 0.9, 0.0),
        ("a", "direct_fact", ["sensitivity"], 0.9, 0.1, 0.1, 0.9, 0.0),
        ("a", "direct_fact", [], 0.9, 0.1, 0.1, 0.9, 0.8),
        ("a", "causal_explain", [], 0.58, 0.9, 0.45, 0.1, 0.0),
        ("a", "direct_fact", [], 0.1, 0.65, 0.9, 0.75, 0.0),
        ("a", "direct_fact", [], float("nan"), 0.66, 0.44, 0.5, 1.5),
        ("a", "direct_fact", [], 0.57, 0.66, 0.45, 0.9, 0.79),
    ]
    c = F.col
    df = spark.createDataFrame(rows, schema).coalesce(1)
    for full, middle in ((False, "semantic_light"), (True, "semantic_full")):
        d = analysis.semantic_decision(c("t"), c("ability"), c("signals"), c("need"), c("fit"), c("ready"), c("cx"), c("risk"), full)
        got = [(r.d.semantic_mode, r.d.retrieval_mode, r.d.reasons) for r in df.select(d.alias("d")).collect()]
        assert got == [
            ("none", "rule", ["empty_query"]),
            ("target_resolver", "target_resolver", ["forget_or_delete_intent"]),
            ("none", "rule", ["safety_policy_first"]),
            ("none", "rule", ["safety_policy_first"]),
            ("semantic_decompose", "graph_contextual", ["causal_intent", "weak_anchor", "semantic_need_high"]),
            (middle, "semantic", ["rule_fit_low"]),
            ("semantic_light", "semantic", ["weak_anchor", "anchor_readiness_low"]),
            ("none", "rule", ["rule_and_anchor_sufficient"]),
        ]


def test_rule_decision(spark):
    c = F.col
    df = spark.createDataFrame([("direct_fact", 1, 0.0), ("direct_fact", 0, 0.6), ("direct_fact", 0, 0.5), ("planning", 3, 0.9), ("boundary", 0, 0.0)], "a string, n int, p double").coalesce(1)
    assert [r[0] for r in df.select(analysis.retrieval_mode(c("a"), c("n"), c("p"))).collect()] == ["exact", "exact", "hybrid", "hybrid", "target_resolver"]
    reasons = analysis.rule_reasons(c("a"), c("n"), c("p"), F.lit(0.6), F.lit(0.5), F.lit(0.49))
    assert [r[0] for r in df.select(reasons).collect()][3:] == [
        ["entity_resolved", "anchor_ready", "default_fallback", "ambiguous_reference"],
        ["boundary_or_forget_intent", "weak_anchor", "default_fallback", "ambiguous_reference"],
    ]
    texts = spark.createDataFrame([("默认配置 是什么",), ("stable setting",), ("那次 工作",), ("那次 工作 朋友",)], "t string").coalesce(1)
    assert [r[0] for r in texts.select(analysis.ability(c("t"))).collect()] == ["static_state", "static_state", "direct_fact", "direct_fact"]
    found = [[x.field for x in r[0]] for r in texts.select(analysis.alternatives(c("t"), analysis.ability(c("t")), analysis.domain(c("t")))).collect()]
    assert found == [[], [], ["memory_ability", "time_mode", "memory_domain"], ["memory_ability", "time_mode"]]


def test_text_bonus(spark):
    c = F.col
    rows = [
        ("premise_check", "premise_counterexample", "never 做饭", "他 在家做 菜", "x", False, 0.20),
        ("premise_check", "premise_counterexample", "never 做饭", "他 在家做 菜", "x", True, 0.0),
        ("premise_check", "premise_counterexample", "never 做饭", "只会 下厨", "x", False, 0.0),
        ("premise_check", "premise_counterexample", "anything", "不要 吃", "x", True, 0.20),
        ("premise_check", "premise_counterexample", "工作 焦虑 变化", "side project", "x", False, 0.45),
        ("dynamic_state", "state_transition", "q", "less lonely", "x", False, 0.22),
        ("dynamic_state", "state_transition", "q", "z", "relational_state", False, 0.22),
        ("dynamic_state", "exact_observation", "q", "less lonely", "x", False, 0.0),
    ]
    df = spark.createDataFrame(rows, "a string, n string, q string, f string, ft string, r boolean, want double")
    bonus = context.text_bonus(c("a"), c("n"), c("q"), c("f"), c("ft"), c("r"), F.lit(False))
    assert [r.want for r in df.coalesce(1).collect()] == [round(r[0], 6) for r in df.coalesce(1).select(bonus).collect()]


def test_purges(spark):
    episodes = spark.createDataFrame([(1, "a", "visible", True), (2, "b", "visible", True)], "episode_id long, content string, visibility_status string, searchable boolean")
    links = spark.createDataFrame(
        [(1, 10, "EVIDENCED_BY", "episode", 1, "visible", "r"), (2, 11, "EVIDENCED_BY", "episode", 1, "hidden", "r"), (3, 11, "EVIDENCED_BY", "episode", 2, "visible", "r"), (4, 12, "SUPPORTS", "fact", 1, "visible", "r")],
        "link_id long, from_id long, link_type string, to_type string, to_id long, visibility_status string, reasoning string",
    ).withColumn("searchable", F.lit(True))
    targets = spark.createDataFrame([(1,), (1,)], "episode_id long")
    after, cut, facts = mutations.purge_episodes(episodes, links, targets)
    assert sorted(map(tuple, after.collect())) == [(1, "[redacted]", "purged", False), (2, "b", "visible", True)]
    state = lambda df: {r.link_id: (r.visibility_status, r.reasoning, r.searchable) for r in df.collect()}
    assert state(cut) == {1: ("purged", None, False), 2: ("hidden", None, False), 3: ("visible", "r", True), 4: ("visible", "r", True)}
    assert [r.fact_id for r in facts.collect()] == [10]
    hit = spark.createDataFrame([(11,), (1,)], "fact_id long")
    assert {r.link_id: r.reasoning for r in mutations.scrub_reasoning(links, hit).collect()} == {1: "r", 2: None, 3: None, 4: None}


def test_completion_of_hot_keys(spark):
    """An episode, a session and an entity that every fact shares: the cut before the join loses none of the first."""
    n = 120
    to = "visible", True, "forward", 1.0
    rows = [(f, "EVIDENCED_BY", "episode", 1, *to) for f in range(n)] + [(f, "EVIDENCED_BY", "episode", 2 + f % 3, *to) for f in range(0, n, 2)] + [(f, "ABOUT_ENTITY", "entity", 5, *to) for f in range(n)]
    rows += [(7, "CAUSED_BY", "fact", f, *to) for f in range(100, 110)]
    links = spark.createDataFrame(rows, "from_id long, link_type string, to_type string, to_id long, visibility_status string, searchable boolean, direction string, weight double")
    episodes = spark.createDataFrame([(e, 9, 100 * e) for e in range(1, 5)], "episode_id long, session_id long, at_s long").withColumns({"visibility_status": F.lit("visible"), "searchable": F.lit(True)})
    entities = spark.createDataFrame([(5, "visible", True, "normal")], "entity_id long, visibility_status string, searchable boolean, sensitivity_level string")
    seeds = spark.createDataFrame([(0,), (7,), (60,)], "fact_id long")
    got = completion.complete(links, episodes, entities, seeds, spark.range(n).withColumnRenamed("id", "fact_id").filter("fact_id % 2 = 1"))
    found = {s: [r.fact_id for r in got.filter(F.col("seed_id") == s).orderBy("rank_position").collect()] for s in (0, 7, 60)}
    best = {s: [f for f in range(n) if f != s] for s in (0, 60)} | {7: [*range(100, 110), *(f for f in range(100) if f != 7)]}
    assert found == {s: [f for f in ids[:24] if f % 2][:12] for s, ids in best.items()}
    # Facts 0 to 24 of episode 1 but the seed; seeds 0 and 60 also meet the 20 multiples of 6 in episode 2.
    pairs = graph.shared_evidence(links, episodes, seeds, 24)
    met = {s: set(range(25)) | (set(range(0, n, 6)) if s in (0, 60) else set()) for s in (0, 7, 60)}
    assert sorted(map(tuple, pairs.collect())) == sorted((s, f) for s, fs in met.items() for f in fs if f != s)
