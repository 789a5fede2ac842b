"""Final scores of candidates, rerank boost, and the greedy selection under budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T

MMR_LAMBDA, DUPLICATE, LEAST_SCORE = 0.72, 0.88, 0.20
RERANK_WEIGHT = 0.08


def final_score(now: Column) -> Column:
    """Weighted sum of a candidate's signals, times its lifecycle.

    Columns: anchor, graph, lexical, completion, slot_boost, reflection, hub_penalty, premise_penalty,
    fatigue_count and the fact's own.
    """
    gains = (
        0.55 * F.col("anchor") + 0.25 * F.col("graph") + 0.20 * F.col("importance") + 0.10 * S.recency(F.col("created_at"), now)
        + 0.10 * S.fact_type_prior(F.col("fact_type")) + 0.10 * F.col("evidence_strength") + 0.05 * F.col("pinned").cast("double") + 0.12 * F.col("lexical")
        + F.col("slot_boost") + F.col("reflection") + F.col("completion")
    )
    losses = F.col("hub_penalty") + F.col("premise_penalty") + S.fatigue_penalty(F.col("fatigue_count")) + S.sensitivity_penalty(F.col("sensitivity_level"))
    return (gains - losses) * S.lifecycle_multiplier(F.col("lifecycle_status"))


def rerank_boost(score: Column, rerank: Column, lifecycle: Column, used: Column) -> Column:
    return score + F.when(used, RERANK_WEIGHT * S.clamp01(rerank) * S.lifecycle_multiplier(lifecycle)).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """Two candidates (structs with terms, entity_ids, predicate, episode_ids, validity, lifecycle)."""
    words = T.jaccard(a["terms"], b["terms"])
    weighted = (
        0.45 * words + 0.20 * T.jaccard(a["entity_ids"], b["entity_ids"]) + 0.15 * F.when(a["predicate"] == b["predicate"], 1.0).otherwise(0.0)
        + 0.10 * T.jaccard(a["episode_ids"], b["episode_ids"])
    ) / 0.90
    same_state = (a["validity"] == b["validity"]) & (a["lifecycle"] == b["lifecycle"])
    return F.when((words < 0.80) | ~same_state, F.least(weighted, F.lit(0.80))).otherwise(weighted)


def select_mmr(candidates: DataFrame, k: int = 8, budget: int = 1200) -> DataFrame:
    """query_id, fact_id, rank_position: greedy maximal-marginal-relevance selection.

    ``candidates``: query_id, c (struct: score, fact_id, tokens and what ``similarity`` needs), at most
    some eighty per query (the fused top). A fold inside the engine: each step takes the
    best of .72 score - .28 similarity, drops near-duplicates and what the budget can't hold.
    """
    pool = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list("c"), asc=False).alias("pool"))
    kind = pool.schema["pool"].dataType.simpleString()
    start = F.struct(F.col("pool").alias("rest"), F.array().cast(kind).alias("taken"), F.lit(0).cast("bigint").alias("used"))

    def step(acc: Column, _: Column) -> Column:
        near = lambda c: F.aggregate(acc["taken"], F.lit(0.0), lambda m, t: F.greatest(m, similarity(c, t)))
        rated = F.transform(
            acc["rest"],
            lambda c: F.struct((MMR_LAMBDA * c["score"] - (1 - MMR_LAMBDA) * near(c)).alias("v"), c["score"].alias("s"), (-c["fact_id"]).alias("k"), near(c).alias("near"), c.alias("c")),
        )
        open_ = F.filter(rated, lambda r: (r["near"] <= DUPLICATE) & (acc["used"] + r["c"]["tokens"] <= budget))

        def take(best: Column) -> Column:
            done = best.isNull() | (F.size(acc["taken"]) >= k)
            return F.when(done, F.struct(F.array().cast(kind).alias("rest"), acc["taken"].alias("taken"), acc["used"].alias("used"))).otherwise(
                F.struct(
                    F.filter(acc["rest"], lambda c: c["fact_id"] != best["c"]["fact_id"]).alias("rest"),
                    F.concat(acc["taken"], F.array(best["c"])).alias("taken"),
                    (acc["used"] + best["c"]["tokens"]).cast("bigint").alias("used"),
                )
            )

        return F.get(F.transform(F.array(F.array_max(open_)), take), F.lit(0))

    folded = pool.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda acc: acc["taken"]).alias("taken"))
    return folded.select("query_id", F.posexplode("taken").alias("p", "c")).select("query_id", F.col("c.fact_id").alias("fact_id"), (F.col("p") + 1).cast("bigint").alias("rank_position"))


def observed_confidence() -> Column:
    """Weighted sum of the eight observed ratios of a retrieval."""
    return S.clamp01(
        0.18 * F.col("anchor_coverage") + 0.15 * F.col("source_diversity") + 0.14 * F.col("top_rank_margin") + 0.14 * F.col("authority_pass_ratio")
        + 0.12 * F.col("temporal_consistency") + 0.12 * F.col("required_chain_coverage") + 0.08 * F.col("mmr_diversity") + 0.07 * F.col("sensitivity_safety")
    )


def corrective_action() -> Column:
    """What an observed retrieval calls for; the first rule that applies."""
    return (
        F.when((F.col("sensitivity_safety") <= 0) | (F.col("temporal_consistency") <= 0), "suppress_memory_injection")
        .when((F.col("authority_pass_ratio") < 0.70) & (F.col("authority_dropped") > 0), "sqlite_fallback")
        .when((F.col("anchor_coverage") < 0.40) & F.col("semantic_allowed"), "semantic_light")
        .when((F.col("required_chain_coverage") < 0.50) & F.col("chain_required"), "semantic_light")
        .when((F.col("source_diversity") < 0.50) & F.col("semantic_allowed"), "semantic_light")
        .when((F.col("mmr_diversity") < 0.70) & F.col("semantic_allowed"), "semantic_light")
        .otherwise("none")
    )
