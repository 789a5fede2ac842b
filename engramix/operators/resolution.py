"""What an extraction's entity candidates stand for: an ordered ladder of matches, unique at each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(candidates: DataFrame, known: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """request_id, candidate_id, outcome, entity: resolved (an entity that there is), created, ambiguous or refused.

    ``candidates``: request_id, persona_id, candidate_id, canonical_name, known_entity_id, merge_hint; ``known``: request_id, entity_id (those that the
    request named); ``entities``: entity_id, persona_id, canonical_name and states; ``aliases``: entity_id, alias.
    The steps: the agent is refused; an id that the request named; the id that the candidate gives, if it is open and the persona's; an ambiguous hint; with the hint
    ``maybe_existing`` the open entities of that very name or alias, one of them; else a new entity, the same for all candidates of a persona and name.
    """
    open_ = entities.filter("visibility_status = 'visible' AND searchable").select("entity_id", "persona_id", "canonical_name")
    named = open_.select("persona_id", F.col("canonical_name").alias("name"), "entity_id").unionByName(
        aliases.join(open_.select("entity_id", "persona_id"), "entity_id").select("persona_id", F.col("alias").alias("name"), "entity_id")
    )
    # One row for each name: how many entities bear it, and one of them.
    named = named.groupBy("persona_id", "name").agg(F.countDistinct("entity_id").alias("n_named"), F.min("entity_id").alias("named_id"))
    rows = candidates.withColumn("name", F.trim("canonical_name"))
    rows = rows.join(known.select("request_id", F.col("entity_id").cast("string").alias("candidate_id"), F.lit(True).alias("given")).distinct(), ["request_id", "candidate_id"], "left")
    rows = rows.join(open_.select("persona_id", F.col("entity_id").alias("known_entity_id"), F.lit(True).alias("is_open")), ["persona_id", "known_entity_id"], "left")
    rows = rows.join(named, ["persona_id", "name"], "left")
    hinted = F.col("merge_hint") == "maybe_existing"
    n = F.when(hinted & (F.col("name") != ""), F.coalesce("n_named", F.lit(0))).otherwise(F.lit(0))
    outcome = (
        F.when(F.col("candidate_id") == "agent", "refused")
        .when(F.col("given"), "resolved")
        .when(F.col("known_entity_id").isNotNull(), F.when(F.col("is_open"), "resolved").otherwise("refused"))
        .when(F.col("merge_hint") == "ambiguous", "ambiguous")
        .when(n == 1, "resolved")
        .when(n > 1, "ambiguous")
        .otherwise("created")
    )
    new = F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws(":", F.col("persona_id").cast("string"), "name"), 256), 1, 16))
    entity = (
        F.when(F.col("outcome") == "created", new)
        .when(F.col("outcome") != "resolved", F.lit(None).cast("string"))
        .when(F.col("given"), F.col("candidate_id"))
        .otherwise(F.coalesce("known_entity_id", "named_id").cast("string"))
    )
    return rows.withColumn("outcome", outcome).withColumn("entity", entity).select("request_id", "candidate_id", "outcome", "entity")
