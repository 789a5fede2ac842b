"""Rank fusion: anchors of many sources, and several dense queries of one question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import clamp01, lookup
from .dense import Cells
from .search import top_k

#: Fixed values of the engine's contract.
SOURCE_WEIGHTS = {
    "entity_exact": 2.0, "pinned_core": 1.8, "alias_match": 1.6, "recent_important": 1.2, "narrative_insight": 1.1,
    "fts": 1.0, "sparse": 1.0, "dense": 1.0,
}
TYPE_PRIORS = {"entity": 0.7, "fact": 1.0, "narrative": 0.9, "insight": 1.1, "episode": 0.4}
RANK_CONSTANT, PER_SOURCE, TOTAL = 60, 40, 80
DENSE_SUPPORT, DENSE_MOST = 0.18, 0.12


def fuse_anchors(hits: DataFrame) -> DataFrame:
    """``hits``: query_id, source, node_type, node_id, rank_position (after authority).

    Weighted reciprocal ranks, 40 hits of each source, summed per node; energies are
    scaled before the cut to 80 nodes of each query.
    """
    capped = hits.filter(F.col("rank_position") <= PER_SOURCE)
    weight = lookup(F.col("source"), SOURCE_WEIGHTS, 1.0)
    fused = capped.groupBy("query_id", "node_type", "node_id").agg(
        F.sum(weight / (RANK_CONSTANT + F.col("rank_position"))).alias("score"), F.count(F.lit(1)).alias("n_sources")
    )
    top = F.max("score").over(W.partitionBy("query_id"))
    scaled = fused.withColumn("seed_energy", F.col("score") / top * lookup(F.col("node_type"), TYPE_PRIORS, 1.0))
    return top_k(scaled, TOTAL, [F.desc(F.round("score", 9)), F.asc("node_type"), F.asc("node_id")], "query_id").select(
        "query_id", "node_type", "node_id", F.round("score", 6).alias("score"), F.round("seed_energy", 6).alias("seed_energy"), "n_sources", "rank_position"
    )


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``queries``: query_id, variant, weight, q (vector), and space, if ``vectors`` (vec_id, embedding) have one: query_id, variant, weight,
    vec_id, score, rank_position of the nearest vectors."""
    space = F.col("space") if "space" in queries.columns else F.lit(0).cast("bigint")
    asked = queries.select(F.struct("query_id", "variant", "weight").alias("key"), space.alias("space"), "q")
    found = Cells(vectors).top_k(asked, k)
    return found.select("key.query_id", "key.variant", "key.weight", "vec_id", "score", "rank_position")


def fuse_dense(hits: DataFrame) -> DataFrame:
    """Weighted best hit plus a bounded bonus for agreeing variants.

    primary = max(clamp(score) * weight); bonus = min(.12, .18 * rrf * (1 - primary)) for more than
    one hit, with the reciprocal ranks scaled by their largest possible sum.
    """
    primary = clamp01(F.col("score")) * F.col("weight")
    grouped = hits.groupBy("query_id", "vec_id").agg(
        F.max(primary).alias("primary"),
        F.count(F.lit(1)).alias("hits"),
        F.sum(F.col("weight") / (RANK_CONSTANT + F.col("rank_position"))).alias("rrf"),
    )
    weights = hits.select("query_id", "variant", "weight").distinct().groupBy("query_id").agg(F.sum("weight").alias("all_weights"))
    share = F.least(F.lit(1.0), F.col("rrf") / (F.col("all_weights") / (RANK_CONSTANT + 1)))
    bonus = F.when(F.col("hits") > 1, F.least(F.lit(DENSE_MOST), DENSE_SUPPORT * share * (1 - F.col("primary")))).otherwise(0.0)
    return grouped.join(weights, "query_id").select(
        "query_id", "vec_id", "hits", F.round("primary", 9).alias("primary_score"), F.round(F.least(F.lit(1.0), F.col("primary") + bonus), 9).alias("fused_score")
    )
