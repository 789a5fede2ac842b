"""Retrieval quality: recall, precision, reciprocal rank, gain, percentiles, deltas between profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked_quality(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``ranked``: query_id, node_id, rank_position; ``gold``: query_id, node_id. One row per
    query of ``ranked`` or ``gold``: recall, precision, reciprocal rank and gain at k.

    An empty gold set has recall 1 and gain 1.
    """
    g = gold.select("query_id", "node_id").distinct()
    hits = ranked.filter(F.col("rank_position") <= k).join(g.withColumn("hit", F.lit(1)), ["query_id", "node_id"], "left")
    gain = F.col("hit") / F.log2(F.col("rank_position") + 1.0)
    per = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank_position"))).alias("first"), F.sum(gain).alias("dcg")
    )
    sizes = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    joined = per.join(sizes, "query_id", "full").select(
        "query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "found", "gold")], "first", F.coalesce("dcg", F.lit(0.0)).alias("dcg")
    )
    return joined.select(
        "query_id",
        F.round(F.when(F.col("gold") == 0, 1.0).otherwise(F.col("found") / F.col("gold")), 6).alias("recall_at_k"),
        F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.col("found") / F.col("n")), 6).alias("precision_at_k"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(F.col("gold") == 0, 1.0).otherwise(F.col("dcg") / F.greatest(ideal, F.lit(1e-12))), 6).alias("ndcg_at_k"),
    )


def nearest_rank(df: DataFrame, by: str, value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles (no interpolation) of each group.

    Equal values are counted together before the running sum, so a window holds a group's
    distinct values only.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    up = W.partitionBy(by).orderBy(value)
    placed = counted.withColumn("hi", F.sum("c").over(up)).withColumn("n", F.sum("c").over(W.partitionBy(by)))
    at = lambda p: F.min(F.when(F.col("hi") >= F.greatest(F.ceil(F.col("n") * p / F.lit(100.0)), F.lit(1)), F.col(value))).alias(f"p{p}")
    return placed.groupBy(by).agg(*[at(p) for p in percents])


def deltas(metrics: DataFrame, profile: str, value: str, base: str) -> DataFrame:
    """Each profile's value minus the base profile's; ``metrics``: name, profile, value."""
    b = metrics.filter(F.col(profile) == base).select("name", F.col(value).alias("base_value"))
    return metrics.filter(F.col(profile) != base).join(b, "name", "left").select("name", profile, F.round(F.col(value) - F.col("base_value"), 6).alias("delta"))


def ratio(a: Column, b: Column, default: float) -> Column:
    return F.when(b == 0, default).otherwise(a / b)


def confusion(rows: DataFrame, by: str) -> DataFrame:
    """``rows``: gold, chosen (booleans). Counts and ratios per group; the forbidden rate is 0 or 1."""
    tp, fp, fn = F.col("gold") & F.col("chosen"), ~F.col("gold") & F.col("chosen"), F.col("gold") & ~F.col("chosen")
    per = rows.groupBy(by).agg(F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn"))
    part = lambda other: F.round(ratio(F.col("tp"), F.col("tp") + F.col(other), 1.0), 6)
    return per.select("*", part("fp").alias("precision"), part("fn").alias("recall"), F.when(F.col("fp") > 0, 1).otherwise(0).alias("forbidden_rate"))
