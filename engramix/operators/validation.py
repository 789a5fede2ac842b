"""Validation of an analyser's JSON answers: the envelope, then every candidate with all reasons against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The answers' protocol, what a candidate may be, and its limits.
PROTOCOL = "v1"
LEAST_CONFIDENCE, MOST_CHARACTERS = 0.2, 200
SCHEMA = (
    "protocol_version string, request_id string, facts array<struct<candidate_id:string, subject:string, predicate:string, object_entity:string, object_literal:string,"
    " confidence:double, evidence:array<string>, sensitivity:string>>"
)


def parsed(answers: DataFrame, raw: str = "body") -> DataFrame:
    """``answers`` with ``a``, the parsed body; what isn't such JSON is null."""
    return answers.withColumn("a", F.from_json(raw, SCHEMA, {"mode": "PERMISSIVE"}))


def envelope_reason(request_id: Column) -> Column:
    """Why an answer counts for nothing; null if it counts."""
    a = F.col("a")
    return (
        F.when(a.isNull() | (a["protocol_version"].isNull() & a["facts"].isNull()), "malformed_json")
        .when(~F.coalesce(a["protocol_version"] == PROTOCOL, F.lit(False)), "protocol_version_mismatch")
        .when(~F.coalesce(a["request_id"] == request_id, F.lit(False)), "request_id_mismatch")
        .when(a["facts"].isNull(), "facts_missing")
    )


def candidates(answers: DataFrame, schemas: DataFrame, sources: DataFrame) -> DataFrame:
    """request_id, candidate_id, reasons: one row per candidate of an answer that counts, with all reasons in order; none: accepted. Answers that count for
    nothing are one row without a candidate.

    ``schemas``: predicate, object_kind; ``sources``: request_id, episode_id (the episodes that the request showed).
    """
    judged = parsed(answers).withColumn("refused", envelope_reason(F.col("request_id")))
    bad = judged.filter(F.col("refused").isNotNull()).select("request_id", F.lit(None).cast("string").alias("candidate_id"), F.array("refused").alias("reasons"))
    each = judged.filter(F.col("refused").isNull()).select("request_id", F.posexplode("a.facts").alias("place", "f")).select("request_id", "place", "f.*")
    repeated = each.groupBy("request_id", "candidate_id").agg(F.min("place").alias("first_place"))
    shown = sources.select("request_id", F.col("episode_id").cast("string").alias("episode"), F.lit(True).alias("shown")).distinct()
    cites = each.select("request_id", "place", F.explode("evidence").alias("episode")).join(shown, ["request_id", "episode"], "left")
    cites = cites.groupBy("request_id", "place").agg(F.count(F.lit(1)).alias("n_cited"), F.count("shown").alias("n_shown"))
    kinds = schemas.select("predicate", "object_kind")
    rows = each.join(F.broadcast(kinds), "predicate", "left").join(cites, ["request_id", "place"], "left").join(repeated, ["request_id", "candidate_id"], "left")
    literal, entity = F.coalesce(F.trim("object_literal"), F.lit("")) != "", F.coalesce(F.trim("object_entity"), F.lit("")) != ""
    n, known = F.coalesce("n_cited", F.lit(0)), F.coalesce("n_shown", F.lit(0))
    sure = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    when = lambda test, reason: F.when(test, F.lit(reason))
    reasons = F.array_compact(
        F.array(
            when(F.coalesce(F.trim("candidate_id"), F.lit("")) == "", "missing_candidate_id"),
            when(F.coalesce(F.col("place") > F.col("first_place"), F.lit(False)), "duplicate_candidate_id"),
            when(F.coalesce(F.trim("subject"), F.lit("")) == "", "missing_subject"),
            when(F.col("object_kind").isNull(), "unknown_predicate"),
            when(~literal & ~entity, "missing_object"),
            when(literal & entity, "two_objects"),
            when(F.coalesce((F.col("object_kind") == "entity") & ~entity & literal, F.lit(False)), "object_must_be_entity"),
            when(F.coalesce((F.col("object_kind") == "literal") & ~literal & entity, F.lit(False)), "object_must_be_literal"),
            when(F.coalesce(F.length("object_literal") > MOST_CHARACTERS, F.lit(False)), "literal_too_long"),
            when(~sure, "confidence_out_of_range"),
            when(sure & (F.col("confidence") < LEAST_CONFIDENCE), "confidence_too_low"),
            when(n == 0, "missing_evidence"),
            when(known < n, "evidence_not_in_request"),
            when(F.coalesce(~F.col("sensitivity").isin("normal", "sensitive", "highly_sensitive"), F.lit(False)), "unknown_sensitivity"),
        )
    )
    return rows.select("request_id", "candidate_id", reasons.alias("reasons")).unionByName(bad)
