"""The cache of semantic analyses: what a batch of requests finds in it, what it computes and what falls back to the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(version: Column | str, *parts: str) -> Column:
    """A hash of everything that an analysis depends on, the analyser's version first; ids of requests are no part of it."""
    first = F.lit(version) if isinstance(version, str) else version
    return F.sha2(F.concat_ws("\x1f", first, *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def outcomes(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests``: request_id, asked_at, ok (whether the analyser would answer), key, base_key (without the version); ``cache``: key, base_key.

    outcome: hit (the cache or an earlier request of the batch has the answer), computed, or fallback (the analyser failed; failures are not
    cached, so the next request tries again); reason: whether nothing was known (new) or only another version's answer (stale). The first answer of a
    key is one aggregate, so a frequent key costs one row per task.
    """
    first = requests.filter("ok").groupBy("key").agg(F.min(F.struct("asked_at", "request_id")).alias("first"))
    held = cache.select("key", F.lit(True).alias("held")).distinct()
    other = cache.select("base_key", F.lit(True).alias("other")).distinct()
    rows = requests.join(first, "key", "left").join(held, "key", "left").join(other, "base_key", "left")
    mine = F.struct("asked_at", "request_id")
    outcome = F.when(F.col("held") | (mine > F.col("first")), "hit").when(F.col("ok"), "computed").otherwise("fallback")
    reason = F.when(F.col("outcome") == "hit", F.when(F.col("held"), "cached").otherwise("same_batch")).when(F.col("other"), "stale").otherwise("new")
    return rows.withColumn("outcome", outcome).withColumn("reason", reason).select("request_id", "key", "outcome", "reason")


def stored_keys(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache after the batch: keys that got an answer come in once; keys that it has stay as they are."""
    fresh = requests.filter("ok").select("key", "base_key").distinct().join(cache.select("key").distinct(), "key", "left_anti")
    return cache.select("key", "base_key").unionByName(fresh)
