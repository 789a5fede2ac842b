"""Extraction: requests per session, prefilter, and the gates that accepted facts must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, object_key

MUST_KEEP = ["remember", "never", "forget"]
LEAST_CONFIDENCE, LEAST_CHARACTERS = 0.2, 20


def build_requests(episodes: DataFrame) -> DataFrame:
    """One extraction request per session: its episodes in order, and a fingerprint for idempotent runs."""
    rows = episodes.filter("visibility_status = 'visible' AND searchable AND role <> 'system'")
    ordered = F.sort_array(F.collect_list(F.struct("at_s", "episode_id", "role", "content"))).alias("episodes")
    per = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_episodes"), ordered)
    line = F.array_join(F.transform("episodes", lambda e: F.concat_ws(":", e["episode_id"], e["role"])), ",")
    return per.withColumn("fingerprint", F.sha2(line, 256))


def unseen(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests whose fingerprint no successful run has."""
    return requests.join(runs.filter("status = 'success'").select("fingerprint"), "fingerprint", "left_anti")


def prefilter(episodes: DataFrame) -> DataFrame:
    low = F.lower("content")
    route = F.when(contains_any(low, MUST_KEEP), "must_keep").when(F.col("role") == "system", "drop").when(F.length("content") < LEAST_CHARACTERS, "drop").otherwise("keep")
    return episodes.withColumn("route", route)


def validate_facts(facts: DataFrame, schemas: DataFrame, entities: DataFrame) -> DataFrame:
    """``decision`` of every extracted fact: the first gate that it fails, or accepted."""
    known = entities.select(F.col("entity_id").alias("subject_entity_id"), F.lit(True).alias("known")).distinct()
    rows = facts.join(F.broadcast(schemas.select("predicate", "conflict_policy")), "predicate", "left").join(known, "subject_entity_id", "left")
    key = object_key(F.col("object_entity_id"), F.col("object_literal"))
    decision = (
        F.when(F.col("conflict_policy").isNull(), "rejected:unknown_predicate")
        .when(F.col("known").isNull(), "rejected:unknown_subject")
        .when(F.col("confidence") < LEAST_CONFIDENCE, "rejected:low_confidence")
        .when(key == "literal:", "rejected:empty_object")
        .when(F.col("conflict_policy").isin("llm_check", "merge"), "needs_review:policy")
        .when(F.col("sensitivity_level") == "highly_sensitive", "needs_review:sensitive")
        .otherwise("accepted")
    )
    return rows.withColumn("decision", decision)


def summarize(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


# Words of the deterministic extractor, first match first.
MOCK_PREDICATES = [("like", "likes"), ("live", "lives_in"), ("promise", "promised_to")]


def mock_extract(episodes: DataFrame, characters: int = 160) -> DataFrame:
    """A deterministic stand-in for a language model: one candidate per visible user episode."""
    low = F.lower("content")
    predicate = F.coalesce(*[F.when(F.contains(low, F.lit(word)), name) for word, name in MOCK_PREDICATES], F.lit("is_busy_with"))
    rows = episodes.filter("role = 'user' AND visibility_status = 'visible' AND searchable")
    return rows.select("episode_id", predicate.alias("predicate"), F.substring(low, 1, characters).alias("summary"))
