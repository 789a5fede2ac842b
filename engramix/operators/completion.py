"""Linked completion: candidates that the scored facts lead to, bounded and explained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .search import top_k

#: The bonus of each rule family, and the bounds of discovery and result.
BONUSES = {"historical": 0.18, "event_bundle": 0.18, "causal": 0.36, "provenance": 0.18, "narrative": 0.18}
DISCOVERED, KEPT = 24, 12


def complete(links: DataFrame, episodes: DataFrame, entities: DataFrame, seeds: DataFrame, allowed: DataFrame, window_s: int = 7200) -> DataFrame:
    """seed_id, fact_id, rule, bonus, rank_position: for each seed the best ``KEPT`` allowed facts.

    The families are one union; of a fact found twice the larger bonus stays, then the
    family's name decides. Candidates are cut to ``DISCOVERED`` before authority, to
    ``KEPT`` after it. Facts of one family have one bonus and stand by id, so a key's first
    ``DISCOVERED`` partners are all that can stay: hot episodes, moments and entities give no more.
    """
    tagged = lambda df, rule: df.select("seed_id", "fact_id", F.lit(rule).alias("rule"))
    parts = [
        tagged(graph.linked_facts(links, seeds, ["SUPERSEDES"], inbound=False), "historical"),
        tagged(graph.linked_facts(links, seeds, ["CAUSED_BY", "EXPLAINS", "TRIGGERED_BY"]), "causal"),
        tagged(graph.shared_evidence(links, episodes, seeds, DISCOVERED), "event_bundle"),
        tagged(graph.session_window(links, episodes, seeds, window_s, DISCOVERED), "event_bundle"),
        tagged(graph.shared_entities(links, entities, seeds, DISCOVERED), "event_bundle"),
    ]
    bonus = reduce(lambda acc, kv: acc.when(F.col("rule") == kv[0], F.lit(kv[1])), BONUSES.items(), F).otherwise(F.lit(0.0))
    found = reduce(DataFrame.unionAll, parts).withColumn("bonus", bonus)
    best = found.groupBy("seed_id", "fact_id").agg(F.max(F.struct("bonus", "rule")).alias("b")).select("seed_id", "fact_id", "b.bonus", "b.rule")
    order = [F.desc("bonus"), F.asc("fact_id")]
    first = top_k(best, DISCOVERED, order, "seed_id", "place")
    return top_k(first.join(allowed.select("fact_id"), "fact_id", "left_semi"), KEPT, order, "seed_id").select("seed_id", "fact_id", "rule", "bonus", "rank_position")


def insert_superseded(selected: DataFrame, targets: DataFrame, k: int = 8) -> DataFrame:
    """query_id, fact_id, rank_position: the selection with the facts that its eligible members replaced.

    ``selected``: query_id, fact_id, rank_position, historical (came in as a replaced fact). ``targets``: query_id, source_id, fact_id,
    weight, link_id; only what the question may be shown, as nothing is filtered here. Sources are treated in the order of their ids, their targets
    by weight: a target that is not there yet comes right behind its source; where the list is full, the last fact that is neither the source nor historical
    gives way, and without such a fact nothing happens. The order makes it a fold; a source's targets past the
    first 2 ``k`` can't change the list, as it holds ``k`` at most, and are cut before the shuffle.
    """
    place = F.struct("rank_position", "fact_id", "historical")
    lists = selected.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: F.struct(x["fact_id"].alias("fact_id"), x["historical"].alias("historical"))).alias("start"))
    first = top_k(targets, 2 * k, [F.desc(F.abs("weight")), F.asc("link_id"), F.asc("fact_id")], ["query_id", "source_id"], "nth")
    steps = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "nth", "fact_id"))).alias("steps"))

    def step(acc: Column, op: Column) -> Column:
        held = F.exists(acc, lambda x: x["fact_id"] == op["fact_id"])
        full = F.size(acc) >= k
        places = F.transform(acc, lambda x, i: F.when((x["fact_id"] != op["source_id"]) & ~x["historical"], i))
        last = F.array_max(F.array_compact(places))
        rest = F.when(full, F.filter(acc, lambda x, i: i != last)).otherwise(acc)
        at = F.array_position(F.transform(rest, lambda x: x["fact_id"]), op["source_id"])
        at = F.when(at > 0, at).otherwise(F.size(rest)).cast("int")
        new = F.struct(op["fact_id"].alias("fact_id"), F.lit(True).alias("historical"))
        return F.when(held | (full & last.isNull()), acc).otherwise(F.concat(F.slice(rest, F.lit(1), at), F.array(new), F.slice(rest, at + 1, F.size(rest))))

    folded = lists.join(steps, "query_id", "left").select(
        "query_id", F.when(F.col("steps").isNull(), F.col("start")).otherwise(F.aggregate("steps", F.col("start"), step)).alias("done")
    )
    return folded.select("query_id", F.posexplode("done").alias("p", "x")).select("query_id", F.col("x.fact_id").alias("fact_id"), (F.col("p") + 1).cast("bigint").alias("rank_position"))


def superseded(links: DataFrame) -> DataFrame:
    """source_id, fact_id, weight, link_id of the open links by which a fact replaces another."""
    open_ = graph.open_links(links).filter("link_type = 'SUPERSEDES' AND to_type = 'fact' AND from_id <> to_id")
    return open_.select(F.col("from_id").alias("source_id"), F.col("to_id").alias("fact_id"), "weight", "link_id")


def overlap_rerank(query_tokens: Column, text_tokens: Column, configured: Column) -> Column:
    """Share of the query's tokens that a text holds, plus a configured score."""
    hits = F.size(F.array_intersect(query_tokens, text_tokens))
    return F.round(F.when(F.size(query_tokens) == 0, 0.0).otherwise(hits / F.size(query_tokens)) + configured, 6)


def skips_rerank(direct: Column, top: Column, margin: Column, lexical: Column) -> Column:
    """A direct question with a clear, lexically supported winner needs no rerank."""
    return direct & (top >= 0.45) & (margin >= 0.15) & lexical
