"""Who may see what: sensitivity, entity and provenance eligibility, and the central filter.

Permissions are sensitivity ranks (0 normal, 1 sensitive, 2 highly sensitive). Facts
are decided in bulk: evidence is aggregated once per fact, entities are joined once per
side, so a batch of queries costs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sensitivity_rank

VISIBLE = "visible"


def visible_at(permission: int, alias: str = "") -> Column:
    p = f"{alias}." if alias else ""
    return (F.col(f"{p}visibility_status") == VISIBLE) & F.col(f"{p}searchable") & (sensitivity_rank(F.col(f"{p}sensitivity_level")) <= permission)


def eligible_entities(entities: DataFrame, permission: int) -> DataFrame:
    return entities.select("entity_id", visible_at(permission).alias("entity_ok"))


def evidence(links: DataFrame, episodes: DataFrame, permission: int) -> DataFrame:
    """Per fact: n_links (evidence links), n_allowed (link and episode visible, rank allowed)
    and n_episodes (episode visible, whatever the link)."""
    e = episodes.select("episode_id", F.col("visibility_status").alias("e_vis"), F.col("searchable").alias("e_search"), F.col("sensitivity_level").alias("e_sens"))
    joined = links.filter("link_type = 'EVIDENCED_BY'").join(e, F.col("to_id") == F.col("episode_id"), "left")
    seen = (F.col("e_vis") == VISIBLE) & F.col("e_search")
    allowed = (F.col("visibility_status") == VISIBLE) & F.col("searchable") & seen & (sensitivity_rank(F.col("e_sens")) <= permission)
    return joined.groupBy(F.col("from_id").alias("fact_id")).agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(F.coalesce(allowed, F.lit(False))).alias("n_allowed"),
        F.count_if(F.coalesce(seen, F.lit(False))).alias("n_episodes"),
    )


def with_evidence(facts: DataFrame, counts: DataFrame) -> DataFrame:
    out = facts.join(counts, "fact_id", "left")
    return out.fillna(0, ["n_links", "n_allowed", "n_episodes"])


def provenance_allows() -> Column:
    """At least one allowed source; without any evidence link only pinned facts pass."""
    return (F.col("n_allowed") > 0) | ((F.col("n_links") == 0) & F.col("pinned"))


def search_evidence_allows() -> Column:
    """No evidence at all, or a visible episode."""
    return (F.col("n_links") == 0) | (F.col("n_episodes") > 0)


def with_entities(facts: DataFrame, entities: DataFrame, permission: int) -> DataFrame:
    """``entities_ok``: every entity that a fact names exists and is eligible."""
    ok = eligible_entities(entities, permission)
    s = ok.select(F.col("entity_id").alias("s_id"), F.col("entity_ok").alias("s_ok"))
    o = ok.select(F.col("entity_id").alias("o_id"), F.col("entity_ok").alias("o_ok"))
    joined = facts.join(s, F.col("subject_entity_id") == F.col("s_id"), "left").join(o, F.col("object_entity_id") == F.col("o_id"), "left")
    side = lambda key, flag: F.col(key).isNull() | F.coalesce(F.col(flag), F.lit(False))
    return joined.withColumn("entities_ok", side("subject_entity_id", "s_ok") & side("object_entity_id", "o_ok")).drop("s_id", "s_ok", "o_id", "o_ok")


def state_allows(permission: int, historical: bool = False, deep: bool = False) -> Column:
    """The fact's own three state axes and its sensitivity."""
    out = visible_at(permission)
    if not historical:
        out = out & (F.col("validity_status") != "invalidated") & (F.col("lifecycle_status") != "archived")
    if not deep:
        out = out & (F.col("lifecycle_status") != "deep_archived")
    return out


def authority_filter(
    facts: DataFrame, entities: DataFrame, links: DataFrame, episodes: DataFrame, permission: int = 0, historical: bool = False, deep: bool = False
) -> DataFrame:
    """The facts that may be shown, with their evidence counts.

    The cheap state test comes first and reaches the scan; entities and evidence are
    joined for the rest.
    """
    kept = facts.filter(state_allows(permission, historical, deep))
    kept = with_evidence(with_entities(kept, entities, permission).filter("entities_ok"), evidence(links, episodes, permission))
    return kept.filter(provenance_allows())


def mask_summary() -> Column:
    """The summary as an inspection may show it."""
    return (
        F.when(F.col("visibility_status") == "forgotten", "[forgotten]")
        .when(F.col("visibility_status") == "purged", "[purged]")
        .when((F.col("n_links") > 0) & (F.col("n_episodes") == 0), "[redacted]")
        .otherwise(F.col("content_summary"))
    )
