"""State transitions as pure functions: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import object_key

ROOT_TYPES = ["core_identity", "commitment"]


def candidate_reason(columns: list[str]) -> Column:
    """Why a candidate is refused or needs review as ``refused:...`` or ``review:...``; null where it is decided
    by the facts that are held. Tests whose columns are missing are left out."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    no_entity, no_literal = blank("object_entity_id"), blank("object_literal")
    tests = [("refused:unknown_predicate", F.col("conflict_policy").isNull()), ("refused:no_subject", blank("subject_entity_id"))]
    if "content_summary" in columns:
        tests.append(("refused:no_summary", blank("content_summary")))
    if "object_kind" in columns:
        kind = F.col("object_kind")
        tests.append(("refused:object_kind", ((kind == "entity") & no_entity) | ((kind == "literal") & no_literal)))
    tests.append(("refused:no_object", no_entity & no_literal))
    if "subject_seen" in columns:
        tests.append(("refused:unknown_subject", ~F.col("subject_seen")))
        tests.append(("refused:unknown_object", ~no_entity & ~F.col("object_seen")))
    if "n_sources" in columns:
        tests.append(("refused:unseen_source", F.col("n_seen_sources") < F.col("n_sources")))
        tests.append(("refused:no_source", (F.col("n_sources") == 0) & ~F.col("pinned")))
    tests.append(("review:llm_check", F.col("conflict_policy") == "llm_check"))
    if "default_tau_days" in columns and "valid_to" in columns:
        tests.append(("review:no_tau", (F.col("conflict_policy") == "expire_by_time") & F.col("valid_to").isNull() & F.col("default_tau_days").isNull()))
    return F.coalesce(*[F.when(test, reason) for reason, test in tests])


def consolidate(
    candidates: DataFrame,
    schemas: DataFrame,
    existing: DataFrame | None = None,
    entities: DataFrame | None = None,
    sources: DataFrame | None = None,
    discard: bool = False,
) -> DataFrame:
    """``candidates``: fact columns with an arrival order (valid_from, fact_id). The action and reason of each.

    Candidates are gated first: only those that pass can become facts. The rest of one (persona, subject,
    predicate) is decided in order by windows, as if one by one against the facts held at that moment:
    ``existing`` (valid, visible, searchable ones count), then what went before. An object that is held reinforces
    (or is discarded as a duplicate with ``discard``); otherwise "supersede" replaces all that is held, "coexist"
    adds to it, "merge" asks for review, and other policies insert.

    ``entities``: subjects and objects must be visible in it; ``sources``: fact_id, n_sources, n_seen_sources.
    """
    slot = ["persona_id", "subject_entity_id", "predicate"]
    keyed = candidates.withColumn("object_key", object_key(F.col("object_entity_id"), F.col("object_literal"))).join(F.broadcast(schemas), "predicate", "left")
    if entities is not None:
        seen = entities.filter("visibility_status = 'visible'").select("entity_id").distinct()
        for side in ("subject", "object"):
            mark = seen.select(F.col("entity_id").alias(f"{side}_entity_id"), F.lit(True).alias(f"{side}_seen"))
            keyed = keyed.join(mark, f"{side}_entity_id", "left").withColumn(f"{side}_seen", F.coalesce(f"{side}_seen", F.lit(False)))
    if sources is not None:
        keyed = keyed.join(sources, "fact_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_sources", "n_seen_sources")})
    held_key, held_any = F.lit(False), F.lit(False)
    if existing is not None:
        held = existing.filter("validity_status = 'valid' AND visibility_status = 'visible' AND searchable")
        held = held.withColumn("object_key", object_key(F.col("object_entity_id"), F.col("object_literal"))).select(*slot, "object_key").distinct()
        keyed = keyed.join(held.withColumn("held_key", F.lit(True)), [*slot, "object_key"], "left").join(held.select(*slot).distinct().withColumn("held_any", F.lit(True)), slot, "left")
        held_key, held_any = F.coalesce("held_key", F.lit(False)), F.coalesce("held_any", F.lit(False))
    keyed = keyed.withColumn("reason", candidate_reason(keyed.columns)).withColumn("decided", F.col("reason").isNull()).withColumns({"held_key": held_key, "held_any": held_any})
    order = W.partitionBy(*slot, "decided").orderBy("valid_from", "fact_id")
    same = W.partitionBy(*slot, "decided", "object_key").orderBy("valid_from", "fact_id")
    before, seen_before = F.lag("object_key").over(order), F.row_number().over(same) > 1
    replaced = F.coalesce(F.max(~F.col("held_key")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    first, key = F.first("object_key").over(order.rowsBetween(W.unboundedPreceding, 0)), F.col("object_key")
    policy, any_held = F.col("conflict_policy"), F.col("held_any") | before.isNotNull()
    again = "discard_duplicate" if discard else "reinforce"
    is_again = (
        F.when((policy == "supersede") & replaced, before == key)
        .when(policy == "supersede", F.col("held_key"))
        .when(policy == "merge", F.col("held_key") | (~F.col("held_any") & before.isNotNull() & (first == key)))
        .otherwise(F.col("held_key") | seen_before)
    )
    action = (
        F.when(F.col("reason").startswith("refused"), "reject")
        .when(F.col("reason").startswith("review"), "needs_review")
        .when(is_again, again)
        .when(~any_held, "insert")
        .when(policy == "supersede", "supersede")
        .when(policy == "coexist", "coexist")
        .when(policy == "merge", "needs_review")
        .otherwise("insert")
    )
    return keyed.withColumn("action", action).drop("decided")


def supersede(facts: DataFrame) -> DataFrame:
    """fact_id, superseded_by, valid_to of single-valued facts that a later, different value replaces."""
    key = object_key(F.col("object_entity_id"), F.col("object_literal"))
    slot = W.partitionBy("persona_id", "subject_entity_id", "predicate").orderBy("valid_from", "fact_id")
    runs = facts.withColumn("k", key).withColumn("starts", F.coalesce(F.lag("k").over(slot) != F.col("k"), F.lit(True))).filter("starts")
    return runs.select(
        "fact_id", F.lead("fact_id").over(slot).alias("superseded_by"), F.lead("valid_from").over(slot).alias("superseded_at")
    ).filter(F.col("superseded_by").isNotNull())


def expire(facts: DataFrame, now: Column) -> DataFrame:
    """Facts past their end: invalidated; archived too unless pinned or of a lasting type."""
    due = F.col("valid_to").isNotNull() & (F.col("valid_to") <= now) & (F.col("validity_status") != "invalidated") & (F.col("visibility_status") == "visible")
    keeps = F.col("pinned") | F.col("fact_type").isin(ROOT_TYPES)
    return facts.filter(due).withColumns(
        {"validity_status": F.lit("invalidated"), "lifecycle_status": F.when(keeps, F.col("lifecycle_status")).otherwise("archived")}
    )


def deep_archive(facts: DataFrame, now: Column, days: int) -> DataFrame:
    """Archived, unpinned facts of passing types whose end (or start) lies ``days`` back."""
    since = F.coalesce("valid_to", "valid_from", "created_at")
    old = since <= now - F.expr(f"INTERVAL '{days}' DAY")
    return facts.filter((F.col("lifecycle_status") == "archived") & ~F.col("pinned") & ~F.col("fact_type").isin(ROOT_TYPES) & old).withColumn("lifecycle_status", F.lit("deep_archived"))


def soft_forget(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """All facts, with the targets (fact_id) hidden, unsearchable and unpinned."""
    hit = targets.select("fact_id", F.lit(True).alias("hit")).distinct()
    f = F.coalesce("hit", F.lit(False))
    return facts.join(hit, "fact_id", "left").withColumns(
        {"visibility_status": F.when(f, "hidden").otherwise(F.col("visibility_status")), "searchable": F.col("searchable") & ~f, "pinned": F.col("pinned") & ~f}
    ).drop("hit")


def hard_forget(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """All facts, with the targets' content removed."""
    hit = targets.select("fact_id", F.lit(True).alias("hit")).distinct()
    f = F.coalesce("hit", F.lit(False))
    return facts.join(hit, "fact_id", "left").withColumns(
        {
            "visibility_status": F.when(f, "forgotten").otherwise(F.col("visibility_status")),
            "content_summary": F.when(f, "[forgotten]").otherwise(F.col("content_summary")),
            "object_literal": F.when(f & F.col("object_literal").isNotNull(), "[forgotten]").otherwise(F.col("object_literal")),
            "searchable": F.col("searchable") & ~f,
            "pinned": F.col("pinned") & ~f,
        }
    ).drop("hit")


def redact_sources(episodes: DataFrame, links: DataFrame, facts: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes with the targets (episode_id) redacted, and the fact_ids that lose their last visible source."""
    hit = targets.select("episode_id", F.lit(True).alias("hit")).distinct()
    f = F.coalesce("hit", F.lit(False))
    after = episodes.join(hit, "episode_id", "left").withColumns(
        {
            "content": F.when(f, "[redacted]").otherwise(F.col("content")),
            "visibility_status": F.when(f, "redacted").otherwise(F.col("visibility_status")),
            "searchable": F.col("searchable") & ~f,
        }
    ).drop("hit")
    cites = links.filter("link_type = 'EVIDENCED_BY'").select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("episode_id"))
    touched = cites.join(hit, "episode_id", "left_semi").select("fact_id").distinct()
    alive = cites.join(after.filter("visibility_status = 'visible' AND searchable"), "episode_id", "left_semi").select("fact_id").distinct()
    blocked = facts.join(touched, "fact_id", "left_semi").join(alive, "fact_id", "left_anti").select("fact_id")
    return after, blocked


def purge(facts: DataFrame, links: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with the targets purged, and links with those that touch a target purged."""
    hit = targets.select("fact_id").distinct()
    gone = F.coalesce("hit", F.lit(False))
    after = facts.join(hit.withColumn("hit", F.lit(True)), "fact_id", "left").withColumns(
        {
            "visibility_status": F.when(gone, "purged").otherwise(F.col("visibility_status")),
            "content_summary": F.when(gone, "[purged]").otherwise(F.col("content_summary")),
            "searchable": F.col("searchable") & ~gone,
        }
    ).drop("hit")
    a = hit.select(F.col("fact_id").alias("from_id"), F.lit(True).alias("hit_a"))
    b = hit.select(F.col("fact_id").alias("to_id"), F.lit("fact").alias("to_type"), F.lit(True).alias("hit_b"))
    marked = links.join(a, "from_id", "left").join(b, ["to_id", "to_type"], "left")
    return after, _cut_links(marked, F.coalesce("hit_a", F.lit(False)) | F.coalesce("hit_b", F.lit(False))).drop("hit_a", "hit_b")


def _cut_links(links: DataFrame, cut: Column) -> DataFrame:
    """Links with the ``cut`` ones out of sight: open ones purged, hidden ones as they were, none with its reasoning."""
    changes = {
        "visibility_status": F.when(cut & (F.col("visibility_status") == "visible"), "purged").otherwise(F.col("visibility_status")),
        "searchable": F.col("searchable") & ~cut,
    }
    if "reasoning" in links.columns:
        changes["reasoning"] = F.when(~cut, F.col("reasoning"))
    return links.withColumns(changes)


def scrub_reasoning(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (with ``reasoning``) without the reasoning of those that touch a target fact (fact_id)."""
    hit = targets.select("fact_id").distinct()
    a = hit.select(F.col("fact_id").alias("from_id"), F.lit(True).alias("hit_a"))
    b = hit.select(F.col("fact_id").alias("to_id"), F.lit("fact").alias("to_type"), F.lit(True).alias("hit_b"))
    touched = F.coalesce("hit_a", "hit_b").isNotNull()
    return links.join(a, "from_id", "left").join(b, ["to_id", "to_type"], "left").withColumn("reasoning", F.when(~touched, F.col("reasoning"))).drop("hit_a", "hit_b")


def purge_episodes(episodes: DataFrame, links: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes with the ``targets`` (episode_id) purged, links with those that point at them cut, and the
    facts (fact_id) that no open episode supports any more, whose search rows have to go."""
    hit = targets.select("episode_id").distinct()
    gone = F.coalesce("hit", F.lit(False))
    after = episodes.join(hit.withColumn("hit", F.lit(True)), "episode_id", "left").withColumns(
        {
            "content": F.when(gone, "[redacted]").otherwise(F.col("content")),
            "visibility_status": F.when(gone, "purged").otherwise(F.col("visibility_status")),
            "searchable": F.col("searchable") & ~gone,
        }
    ).drop("hit")
    b = hit.select(F.col("episode_id").alias("to_id"), F.lit("episode").alias("to_type"), F.lit(True).alias("hit_b"))
    marked = links.join(b, ["to_id", "to_type"], "left")
    cut = _cut_links(marked, F.coalesce("hit_b", F.lit(False))).drop("hit_b")
    cited = links.filter("link_type = 'EVIDENCED_BY'").select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("episode_id"))
    standing = after.filter("visibility_status = 'visible' AND searchable").select("episode_id")
    lost = cited.join(hit, "episode_id", "left_semi").select("fact_id").distinct()
    return after, cut, lost.join(cited.join(standing, "episode_id", "left_semi").select("fact_id"), "fact_id", "left_anti")


def compression_reason() -> Column:
    """Why a fact can't be compressed; null where it can."""
    return (
        F.when(F.col("visibility_status") != "visible", "not_visible")
        .when(F.col("validity_status") == "invalidated", "invalidated")
        .when(F.col("pinned"), "pinned")
        .when(F.col("fact_type").isin(ROOT_TYPES), "protected_type")
        .when(F.col("lifecycle_status").isin("consolidated", "archived", "deep_archived"), "lifecycle")
        .when(F.col("sensitivity_level") == "highly_sensitive", "sensitive")
    )


def compress(facts: DataFrame, least: int = 2) -> DataFrame:
    """persona_id, subject_entity_id, n_sources, importance of the groups with enough eligible facts."""
    eligible = facts.filter(compression_reason().isNull())
    return eligible.groupBy("persona_id", "subject_entity_id").agg(F.count(F.lit(1)).alias("n_sources"), F.round(F.avg("importance"), 6).alias("importance")).filter(F.col("n_sources") >= least)


def expire_leases(queue: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Rows in work for longer than the lease fail with one more attempt; failed rows may be claimed again."""
    stale = (F.col("status") == "processing") & (F.col("created_at") < now - F.expr(f"INTERVAL '{minutes}' MINUTE"))
    return queue.withColumns({"attempts": F.when(stale, F.col("attempts") + 1).otherwise(F.col("attempts")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def claim(queue: DataFrame, limit: int) -> DataFrame:
    """The next rows to work on: by priority, age, id."""
    return queue.filter(F.col("status").isin("pending", "failed")).orderBy("priority", "created_at", "queue_id").limit(limit)


def claimed(queue: DataFrame, limit: int, now: Column) -> DataFrame:
    """The queue after a claim: leases that ended have failed, the next ``limit`` open rows are in work since ``now``."""
    ready = expire_leases(queue, now)
    taken = claim(ready, limit).select("queue_id", F.lit(True).alias("taken"))
    return ready.join(taken, "queue_id", "left").withColumns(
        {"status": F.when(F.col("taken"), "processing").otherwise(F.col("status")), "leased_at": F.when(F.col("taken"), now)}
    ).drop("taken")


def superseded_by_rebuild(queue: DataFrame, now: Column) -> DataFrame:
    """The queue before its personas are rebuilt: leases that ended have failed, and the open rows of personas without rows in work are done, as a
    rebuild covers them. ``rebuild`` tells refused (rows in work), superseded, or kept."""
    ready = expire_leases(queue, now)
    busy = ready.filter("status = 'processing'").select("persona_id", F.lit(True).alias("busy")).distinct()
    open_ = F.col("status").isin("pending", "failed")
    rows = ready.join(busy, "persona_id", "left").withColumn("rebuild", F.when(F.col("busy"), "refused").when(open_, "superseded").otherwise("kept"))
    return rows.withColumn("status", F.when(F.col("rebuild") == "superseded", "done").otherwise(F.col("status"))).drop("busy")


def chain(episodes: DataFrame) -> DataFrame:
    """Each episode with its neighbours in the session."""
    order = W.partitionBy("session_id").orderBy("at_s", "episode_id")
    return episodes.select("episode_id", "session_id", F.lag("episode_id").over(order).alias("prev_episode_id"), F.lead("episode_id").over(order).alias("next_episode_id"))


def append_episodes(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """The log with new episodes (ids that it lacks), chained anew within their sessions."""
    from .upserts import ensure

    return chain(ensure(log.select("episode_id", "session_id", "at_s"), fresh.select("episode_id", "session_id", "at_s"), ["episode_id"]))


def rebuild_search(facts: DataFrame, counts: DataFrame) -> DataFrame:
    """Every fact with what a rebuild of the search documents does to it, and its tier."""
    from ..functions.scalars import search_tier
    from .authority import search_evidence_allows, with_evidence

    rows = with_evidence(facts, counts)
    eligible = (F.col("visibility_status") == "visible") & F.col("searchable") & search_evidence_allows()
    return rows.select("fact_id", F.when(eligible, "upsert").otherwise("delete").alias("action"), F.when(eligible, search_tier(F.col("lifecycle_status"))).alias("tier"))


def index_status(queue: DataFrame) -> DataFrame:
    """node_id, status after the queue's finished rows, the last of each node deciding."""
    last = queue.filter(F.col("status").isin("done", "failed")).groupBy("node_id").agg(F.max(F.struct("created_at", "queue_id", "operation", "status")).alias("q"))
    state = (
        F.when(F.col("q.status") == "failed", F.when(F.col("q.operation").like("delete%"), "stale_delete_failed").otherwise("failed"))
        .when(F.col("q.operation").like("delete%"), "deleted")
        .when(F.col("q.operation") == "rebuild_persona", "stale")
        .otherwise("indexed")
    )
    return last.select("node_id", state.alias("index_status"))
