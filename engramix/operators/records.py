"""Rows that a write leaves behind: new facts with their defaults, links, queue rows, mirror payloads, tombstones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_unique
from .authority import evidence, search_evidence_allows, with_evidence

#: Fixed values of the engine's contract.
DEFAULT_FACT_TYPE, DEFAULT_SCORE, DEFAULT_PRIORITY = "stable_preference", 0.5, 5
BREAKER_WINDOW, BREAKER_FAILURES, BREAKER_OPEN_S = 20, 3, 60


def filled(value: Column, *defaults: Column) -> Column:
    """The first that is neither null, blank nor 0."""
    given = lambda c: F.when((c.cast("string") != "") & (c.cast("string") != "0") & (c.cast("string") != "0.0"), c)
    return F.coalesce(*[given(c) for c in (value, *defaults)])


def build_facts(candidates: DataFrame, schemas: DataFrame) -> DataFrame:
    """Accepted candidates as facts: empty fields filled from the predicate's schema, then from the defaults."""
    rows = candidates.join(F.broadcast(schemas), "predicate")
    sensitive = F.when(F.col("sensitive_by_default"), "sensitive").otherwise("normal")
    pinned = F.coalesce("pinned", F.lit(False))
    return rows.select(
        "fact_id",
        filled(F.col("fact_type"), F.col("default_fact_type"), F.lit(DEFAULT_FACT_TYPE)).alias("fact_type"),
        filled(F.col("confidence"), F.lit(DEFAULT_SCORE)).alias("confidence"),
        filled(F.col("importance"), F.col("default_importance").cast("double"), F.lit(DEFAULT_SCORE)).alias("importance"),
        filled(F.col("sensitivity_level"), sensitive).alias("sensitivity_level"),
        F.lit("valid").alias("validity_status"),
        F.lit("visible").alias("visibility_status"),
        F.lit("active").alias("lifecycle_status"),
        F.when(pinned, "user").alias("pin_actor"),
        F.when(pinned, "manual pin").alias("pin_reason"),
    )


def reinforce(facts: DataFrame, again: DataFrame) -> DataFrame:
    """``facts`` after their repetitions (``again``: fact_id, importance): counted, and importance never falls."""
    per = again.groupBy("fact_id").agg(F.count(F.lit(1)).alias("times"), F.max("importance").alias("most"))
    return facts.join(per, "fact_id", "left").withColumns(
        {
            "reinforcement_count": F.col("reinforcement_count") + F.coalesce("times", F.lit(0)),
            "importance": F.when(F.col("importance") > F.col("most"), F.col("importance")).otherwise(F.coalesce("most", "importance")),
        }
    ).drop("times", "most")


LINK_KEY = ["persona_id", "from_type", "from_id", "link_type", "to_type", "to_id"]


def about_links(facts: DataFrame) -> DataFrame:
    """An ABOUT_ENTITY link for the subject and the object of each fact."""
    ends = F.array_distinct(F.array_compact(F.array("subject_entity_id", "object_entity_id")))
    return facts.select(
        "persona_id", F.lit("fact").alias("from_type"), F.col("fact_id").alias("from_id"), F.lit("ABOUT_ENTITY").alias("link_type"), F.lit("entity").alias("to_type"), F.explode(ends).alias("to_id")
    )


def missing_links(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """Of ``fresh`` the links that ``links`` lacks, each once by its six parts."""
    return fresh.select(*LINK_KEY).distinct().join(links.select(*LINK_KEY), LINK_KEY, "left_anti")


def superseding_links(replaced: DataFrame) -> DataFrame:
    """A SUPERSEDES link from the later fact to each fact that it replaced (fact_id, superseded_by)."""
    return replaced.select(F.col("superseded_by").alias("from_id"), F.lit("SUPERSEDES").alias("link_type"), F.col("fact_id").alias("to_id"), F.lit("consolidation").alias("created_by"))


def sync_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Queue rows of changed facts (fact_id) and new links (from_id, link_type, to_id), each once."""
    a = nodes.select(F.lit("fact").alias("node_type"), F.col("fact_id").cast("string").alias("node_id"), F.lit("upsert_node").alias("operation"))
    b = edges.select(F.lit("memory_link").alias("node_type"), F.concat_ws(":", "from_id", "link_type", "to_id").alias("node_id"), F.lit("upsert_edge").alias("operation"))
    return a.unionByName(b).distinct().withColumns({"priority": F.lit(DEFAULT_PRIORITY).cast("bigint"), "status": F.lit("pending")})


def delete_rows(links: DataFrame, index_map: DataFrame, targets: DataFrame) -> DataFrame:
    """Queue rows that take facts (fact_id) out of the mirror: one for each link at either end, and one for each mapped node."""
    out = links.join(targets.select(F.col("fact_id").alias("from_id")).distinct(), "from_id", "left_semi")
    into = links.filter("to_type = 'fact'").join(targets.select(F.col("fact_id").alias("to_id")).distinct(), "to_id", "left_semi")
    edges = out.select("link_id").unionAll(into.select("link_id")).distinct()
    mapped = index_map.filter("node_type = 'fact' AND index_status = 'indexed'").join(targets.select(F.col("fact_id").alias("node_id")).distinct(), "node_id", "left_semi")
    return edges.select(F.lit("memory_link").alias("node_type"), F.col("link_id").alias("node_id"), F.lit("delete_edge").alias("operation")).unionAll(
        mapped.select("node_type", "node_id", F.lit("delete_node").alias("operation"))
    )


def edge_payloads(links: DataFrame, index_map: DataFrame) -> DataFrame:
    """Links with the mirror's ids of both ends, null where an end is not indexed."""
    known = index_map.filter("index_status = 'indexed'")
    a = known.filter("node_type = 'fact'").select(F.col("node_id").alias("from_id"), F.col("mirror_id").alias("from_mirror_id"))
    b = known.select(F.col("node_type").alias("to_type"), F.col("node_id").alias("to_id"), F.col("mirror_id").alias("to_mirror_id"))
    return links.join(a, "from_id", "left").join(b, ["to_type", "to_id"], "left")


def fact_payloads(facts: DataFrame, entities: DataFrame, links: DataFrame, episodes: DataFrame) -> DataFrame:
    """What the mirror stores of each eligible fact: the searchable text and its fields."""
    named = entities.select("entity_id", "canonical_name")
    rows = with_evidence(facts.filter("visibility_status = 'visible' AND searchable"), evidence(links, episodes, 0)).filter(search_evidence_allows())
    rows = rows.join(named.select(F.col("entity_id").alias("subject_entity_id"), F.col("canonical_name").alias("subject_name")), "subject_entity_id", "left")
    rows = rows.join(named.select(F.col("entity_id").alias("object_entity_id"), F.col("canonical_name").alias("object_name")), "object_entity_id", "left")
    text = join_unique(F.array("content_summary", "predicate", "subject_name", "object_name"))
    return rows.withColumn("searchable_text", text)


def entity_payloads(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """What the mirror stores of each open entity, with its aliases in order."""
    per = aliases.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
    return entities.filter("visibility_status = 'visible' AND searchable").join(per, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))


def tombstones(episodes: DataFrame, targets: DataFrame) -> DataFrame:
    """What stays of redacted episodes: when they were, and a hash of what they said."""
    return episodes.join(targets.select("episode_id").distinct(), "episode_id", "left_semi").select(
        "episode_id", "persona_id", "session_id", "occurred_at", F.lit("redacted").alias("redaction_level"), F.sha2("content", 256).alias("content_hash_before")
    )


def finish(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue after ``outcomes`` (queue_id, ok): done, or failed with one more attempt."""
    rows = queue.join(outcomes.select("queue_id", "ok"), "queue_id", "left")
    return rows.withColumns(
        {
            "attempts": F.col("attempts") + F.when(~F.col("ok"), 1).otherwise(0),
            "status": F.when(F.col("ok"), "done").when(~F.col("ok"), "failed").otherwise(F.col("status")),
        }
    ).drop("ok")


def derived_rows(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """A DERIVED_FROM link from each group's narrative to its sources, which become consolidated."""
    return facts.join(groups.select("persona_id", "subject_entity_id"), ["persona_id", "subject_entity_id"]).select(
        F.concat_ws(":", "persona_id", "subject_entity_id").alias("narrative_id"), F.lit("DERIVED_FROM").alias("link_type"), "fact_id", F.lit("consolidated").alias("lifecycle_status")
    )


def breaker(outcomes: DataFrame, window: int = BREAKER_WINDOW, failures: int = BREAKER_FAILURES, open_s: int = BREAKER_OPEN_S) -> DataFrame:
    """``outcomes``: key, at_s, seq, failed in time order of each key. Whether the circuit breaker lets each call through.

    ``failures`` among the last ``window`` calls open it for ``open_s`` seconds; the next call
    after that is a probe, which closes it or opens it again. Each step depends on the one before, so rows are streamed
    in order through one pass per task, with one key's state at a time.
    """
    sized = (window, failures, open_s)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        window, failures, open_s = sized
        key, recent, until = None, [], None
        for batch in batches:
            passed = []
            for k, at, failed in zip(batch["key"], batch["at_s"], batch["failed"]):
                if k != key:
                    key, recent, until = k, [], None
                if until is not None and at < until:
                    passed.append(False)
                    continue
                passed.append(True)
                if until is not None:
                    recent, until = [], at + open_s if failed else None
                    continue
                recent = [*recent, bool(failed)][-window:]
                if sum(recent) >= failures:
                    recent, until = [], at + open_s
            yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "allowed": passed})

    ordered = outcomes.select("key", "at_s", "seq", "failed").repartition("key").sortWithinPartitions("key", "at_s", "seq")
    return ordered.mapInPandas(run, "key long, seq long, allowed boolean")
