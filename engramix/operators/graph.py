"""Graph operators over typed, directed, weighted links: adjacency, degrees, spreading energy, completions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from ..sources.scratch import stored
from .search import top_k

#: Fixed values of the engine's contract.
LINK_MULTIPLIERS = {
    "CAUSED_BY": 1.0, "SUPERSEDES": 0.9, "SUPPORTS": 0.85, "EXPLAINS": 0.85, "ABOUT_ENTITY": 0.8, "CONTRIBUTED_TO": 0.8,
    "CO_OCCURS_WITH": 0.45, "DERIVED_FROM": 0.35, "EVIDENCED_BY": 0.2,
}
DECAY, LEAST_ENERGY, HUB_POWER, MOST_NODES = 0.70, 0.01, 0.5, 80


def edge_weight(provenance: bool = False) -> Column:
    w = F.greatest(F.col("weight"), F.lit(0.0)) * lookup(F.col("link_type"), LINK_MULTIPLIERS, 0.5)
    return w if provenance else F.when(F.col("link_type") == "EVIDENCED_BY", 0.0).otherwise(w)


def open_links(links: DataFrame) -> DataFrame:
    return links.filter("visibility_status = 'visible' AND searchable")


def node_key(kind: Column | str, key: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def adjacency(links: DataFrame) -> DataFrame:
    """source, target, link_type, weight: each link by its direction, in both for bidirectional ones."""
    a, b = node_key("fact", "from_id"), node_key(F.col("to_type"), "to_id")
    arrows = F.when(F.col("direction") == "forward", F.array(F.struct(a.alias("s"), b.alias("t")))).when(
        F.col("direction") == "backward", F.array(F.struct(b.alias("s"), a.alias("t")))
    ).otherwise(F.array(F.struct(a.alias("s"), b.alias("t")), F.struct(b.alias("s"), a.alias("t"))))
    return links.select(F.explode(arrows).alias("e"), "link_type", "weight").select(F.col("e.s").alias("source"), F.col("e.t").alias("target"), "link_type", "weight")


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(node_key("fact", "from_id"), node_key(F.col("to_type"), "to_id"))).alias("node"))


def degrees(links: DataFrame) -> DataFrame:
    """node, degree: links at either end."""
    return _ends(links).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


#: Up to so many nodes go to the links' scan; more meet the links by a shuffle.
SENT = 500_000


def _among(rows: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
    """The rows whose ``on`` is one of ``nodes`` (stored, each once), with the nodes' columns."""
    return rows.join(F.broadcast(nodes) if nodes.count() <= SENT else nodes, on)


def shares(links: DataFrame, frontier: DataFrame) -> DataFrame:
    """source, target, link_type, share (weight and hub damping) of the links that lead away from ``frontier`` (source, e) and may carry enough of its energy.

    Energy reaches few nodes, so links are picked where they are read, and only the ends of picked ones are counted: neither the adjacency nor all
    nodes' degrees are shuffled, sorted or held.
    """
    strongest = stored(frontier.groupBy("source").agg(F.max("e").alias("most")))
    away = _among(adjacency(links).withColumn("w", edge_weight()).filter("w > 0"), strongest, "source")
    # A degree is 1 at least, so it lets no more through.
    away = stored(away.filter(F.col("most") * (DECAY * F.col("w")) >= LEAST_ENERGY).drop("most"))
    degree = _among(_ends(links), stored(away.select(F.col("target").alias("node")).distinct()), "node").groupBy(F.col("node").alias("target")).agg(F.count(F.lit(1)).alias("degree"))
    damped = DECAY * F.col("w") / F.pow(F.greatest(F.col("degree"), F.lit(1)).cast("double"), F.lit(HUB_POWER))
    return away.join(degree, "target").select("source", "target", "link_type", damped.alias("share"))


def activate(seeds: DataFrame, links: DataFrame, hops: int = 2) -> DataFrame:
    """``seeds``: query_id, node, energy; of a node's seeds the largest counts. Energy spreads along the
    links; sums stay on the nodes, the largest single share travels on. The 80 strongest nodes of each
    query, without those below 0.01.

    Every hop is one join with the shares of the links that leave its frontier; energy
    falls by 0.7 a hop and below 0.01 goes no further, so the frontier shrinks. Hops are stored.
    """
    gained = stored(seeds.filter("energy > 0").groupBy("query_id", "node").agg(F.max("energy").alias("energy")))
    frontier = gained.select("query_id", F.col("node").alias("source"), F.col("energy").alias("e"))
    for _ in range(hops):
        met = frontier.join(shares(links, frontier.select("source", "e")), "source").select("query_id", F.col("target").alias("node"), (F.col("e") * F.col("share")).alias("energy"))
        moved = stored(met.filter(F.col("energy") >= LEAST_ENERGY))
        gained = gained.unionByName(moved)
        frontier = moved.groupBy("query_id", F.col("node").alias("source")).agg(F.max("energy").alias("e"))
    total = gained.groupBy("query_id", "node").agg(F.sum("energy").alias("sum")).filter(F.col("sum") >= LEAST_ENERGY).select("query_id", "node", F.round(F.least(F.lit(1.0), F.col("sum")), 6).alias("energy"))
    return top_k(total, MOST_NODES, [F.desc("energy"), F.asc("node")], "query_id")


def activation_chains(seeds: DataFrame, links: DataFrame, hops: int = 2) -> DataFrame:
    """query_id, node, hop, nodes, link_types: how energy first reaches each node, the whole chain from a seed.

    ``seeds`` as in ``activate``. A node's chain is that of its first hop with the largest share (then the smaller source, then the link type), appended to its
    source's own chain. Only the best arrival of each node is kept before chains are joined, so chains are as many as reached nodes.
    """
    start = stored(seeds.filter("energy > 0").groupBy("query_id", "node").agg(F.max("energy").alias("energy")))
    frontier = start.select("query_id", F.col("node").alias("source"), F.col("energy").alias("e"))
    none = F.array().cast("array<string>")
    known = start.select("query_id", "node", F.lit(0).alias("hop"), F.array("node").alias("nodes"), none.alias("link_types"))
    for hop in range(1, hops + 1):
        met = frontier.join(shares(links, frontier.select("source", "e")), "source").select("query_id", "source", F.col("target").alias("node"), "link_type", (F.col("e") * F.col("share")).alias("energy"))
        moved = stored(met.filter(F.col("energy") >= LEAST_ENERGY))
        fresh = moved.join(known.select("query_id", "node"), ["query_id", "node"], "left_anti")
        best = fresh.groupBy("query_id", "node").agg(F.min(F.struct((-F.round("energy", 9)).alias("e"), "source", "link_type")).alias("b"))
        chain = known.select("query_id", F.col("node").alias("source"), "nodes", "link_types")
        new = best.select("query_id", "node", "b.source", "b.link_type").join(chain, ["query_id", "source"])
        new = new.select("query_id", "node", F.lit(hop).alias("hop"), F.concat("nodes", F.array("node")).alias("nodes"), F.concat("link_types", F.array("link_type")).alias("link_types"))
        known = known.unionByName(new)
        frontier = moved.groupBy("query_id", F.col("node").alias("source")).agg(F.max("energy").alias("e"))
    return known


def _first_facts(rows: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """The ``most`` + 1 smallest fact ids of each key. A seed is one of them at most, so ``most`` partners stay; Spark
    cuts them in every task before the shuffle, and a hot key meets its seeds with so many rows only."""
    return rows if most is None else top_k(rows, most + 1, [F.asc("fact_id")], keys, "__place").drop("__place")


def _partners(mine: DataFrame, first: DataFrame, on: list[str], most: int) -> DataFrame:
    """seed_id, fact_id of each seed's smallest partners; ``first`` as of ``_first_facts``. A key's facts meet its seeds as one list, and of a seed's
    lists ``most`` + 1 ids stay, so no task holds a row for every pair."""
    lists = first.groupBy(*on).agg(F.collect_list("fact_id").alias("ids"))
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most + 1)
    return mine.join(lists, on).groupBy("seed_id").agg(ids.alias("ids")).select("seed_id", F.explode("ids").alias("fact_id")).filter("seed_id <> fact_id")


#: A key's facts are cut into parts of about so many, a task's unit of work, and its seeds into lists of about so many; where pairs are looked at one by one, parts hold ``ROWS``.
FACTS, SEEDS, ROWS = 1024, 64, 8192


def _many(rows: DataFrame, on: list[str], size: int, name: str) -> DataFrame:
    """The keys with more than ``size`` rows, and into how many parts (``name``) they go. One key for ``size`` rows at most, so they are sent to all tasks."""
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > size)
    return F.broadcast(counted.select(*on, F.ceil(F.col("__n") / size).cast("int").alias(name)))


def _cut(rows: DataFrame, many: DataFrame, on: list[str], row_id: str, name: str) -> DataFrame:
    """``rows`` with the part of its key that each belongs to; ``many`` as of ``_many``."""
    return rows.join(many, on, "left").withColumn(name, F.pmod(F.xxhash64(row_id), F.coalesce(F.col(name), F.lit(1))).cast("int"))


def _to_parts(rows: DataFrame, many: DataFrame, on: list[str], name: str, by: list[str]) -> DataFrame:
    """``rows``, once for each part (column ``name``) that the other side of their key is cut into, for a join by ``by``.

    Spark's estimates don't count rows that ``explode`` makes, so it would broadcast the copies through the driver: hence the hint. They are dealt to a fixed
    number of tasks, as tasks with few bytes to read would be put together, though they make many rows.
    """
    copies = rows.join(many, on, "left").withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(name), F.lit(1)) - 1)))
    return copies.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).hint("merge")


def _crossed(mine: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """seed_id, fact_id of all pairs of a key. Parts of its facts meet lists of its seeds and are unfolded into rows in the same task, ``FACTS`` times ``SEEDS`` at once.

    Pairs leave by list, fact by fact, so that files of them hold runs and repeated sequences and stay small.
    """
    many = _many(facts, on, FACTS, "__part")
    parts = _cut(facts, many, on, "fact_id", "__part").groupBy(*on, "__part").agg(F.collect_list("fact_id").alias("facts"))
    lists = _cut(mine, _many(mine, on, SEEDS, "__list"), on, "seed_id", "__list").groupBy(*on, "__list").agg(F.collect_list("seed_id").alias("seeds"))
    by = [*on, "__part"]
    met = _to_parts(lists, many, on, "__part", by).join(parts, by).select("seeds", F.explode("facts").alias("fact_id"))
    return met.select(F.explode("seeds").alias("seed_id"), "fact_id").filter("seed_id <> fact_id")


def _checked(mine: DataFrame, facts: DataFrame, on: list[str], keep: Column) -> DataFrame:
    """seed_id, fact_id of the pairs of a key that ``keep`` lets through, a part of its facts and one of its seeds at a time; fact by fact as in ``_crossed``."""
    many, led, by = _many(facts, on, ROWS, "__part"), _many(mine, on, ROWS, "__list"), [*on, "__part", "__list"]
    left = _to_parts(_cut(facts, many, on, "fact_id", "__part"), led, on, "__list", by).alias("l")
    right = _to_parts(_cut(mine, led, on, "seed_id", "__list"), many, on, "__part", by).alias("r")
    # ``keep`` is a part of the join's condition, so pairs that it rejects are never made into rows.
    both = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by]
    return left.join(right, reduce(Column.__and__, [*both, keep, F.col("seed_id") != F.col("fact_id")])).select("seed_id", "fact_id")


def _pairs(mine: DataFrame, facts: DataFrame, on: list[str], keep: Column) -> DataFrame:
    """seed_id, fact_id of the pairs that share a key. ``facts`` have a kind at each key; ``mine`` names the kinds whose facts it meets whatever they hold (``crosses``),
    and those of which ``keep`` is asked (``checks``)."""
    on = [*on, "kind"]
    crossed = _crossed(mine.withColumn("kind", F.explode("crosses")).select("seed_id", *on), facts.select("fact_id", *on), on)
    return crossed.unionByName(_checked(mine.withColumn("kind", F.explode("checks")).drop("crosses", "checks"), facts, on, keep))


def _sharing(held: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_id, fact_id of facts (``held``: fact_id, key) that share a key with a seed, each pair once.

    A pair is made at the smallest key that both hold, so pairs need no shuffle, whose size would grow with the square of a key's facts.
    """
    listed = held.groupBy("fact_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    placed = listed.select("fact_id", "keys", F.posexplode("keys").alias("at", "key")).select("fact_id", "key", F.slice("keys", F.lit(1), F.col("at")).alias("before"))
    mine = placed.join(seeds.select("fact_id").distinct(), "fact_id", "left_semi").select(F.col("fact_id").alias("seed_id"), "key", F.col("before").alias("seed_before"))
    # Only facts and seeds that both hold a smaller key may be a pair of that one.
    new, first, later = F.size("seed_before") == 0, F.lit("first"), F.lit("later")
    mine = mine.withColumns({"crosses": F.when(new, F.array(first, later)).otherwise(F.array(first)), "checks": F.when(~new, F.array(later))})
    return _pairs(mine, placed.withColumn("kind", F.when(F.size("before") == 0, first).otherwise(later)), ["key"], ~F.arrays_overlap("before", "seed_before"))


def shared_evidence(links: DataFrame, episodes: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """seed_id, fact_id of facts that cite a visible episode which a seed cites too; ``seeds``: fact_id.

    With ``most``, each seed keeps at least its ``most`` smallest partners, if it has so many; further ones may be left out.
    """
    cited = open_links(links).filter("link_type = 'EVIDENCED_BY'").select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("episode_id"))
    cited = cited.join(episodes.filter("visibility_status = 'visible' AND searchable").select("episode_id"), "episode_id", "left_semi")
    if most is None:
        return _sharing(cited.select("fact_id", F.col("episode_id").alias("key")), seeds)
    cited = cited.distinct()
    mine = cited.join(seeds.select("fact_id"), "fact_id", "left_semi").select(F.col("fact_id").alias("seed_id"), "episode_id")
    return _partners(mine, _first_facts(cited, ["episode_id"], most), ["episode_id"], most)


def _within(placed: DataFrame, seeds: DataFrame, seconds: int) -> DataFrame:
    """seed_id, fact_id of facts (``placed``: fact_id, session_id, at_s) with a moment within ``seconds`` of a seed's in the same session, each pair once.

    A pair is made in the first bucket (of a session) in which a moment of the fact is near one of the seed's, as in ``_sharing``. Where all moments of
    a seed around a bucket lie inside it, they are near all others there, and a pair needs no look at its moments unless both have an earlier session too.
    """
    spot = lambda m: F.struct(m["session_id"].alias("session_id"), F.floor(m["at_s"] / seconds).alias("bucket"))
    listed = placed.groupBy("fact_id").agg(F.array_sort(F.collect_set(F.struct("session_id", "at_s"))).alias("moments"))
    spots = listed.select("fact_id", "moments", F.explode(F.array_distinct(F.transform("moments", spot))).alias("s"))
    here = F.transform(F.filter("moments", lambda m: spot(m) == F.col("s")), lambda m: m["at_s"])
    facts = spots.select("fact_id", "s.session_id", "s.bucket", here.alias("here"), F.filter("moments", lambda m: spot(m) < F.col("s")).alias("before"))
    facts = facts.withColumn("before_in", F.array_distinct(F.col("before.session_id")))
    kind = F.when(F.size("before") == 0, "first").when(F.array_contains("before_in", F.col("session_id")), "again").otherwise("later")
    mine = listed.join(seeds.select("fact_id").distinct(), "fact_id", "left_semi").withColumnRenamed("fact_id", "seed_id").withColumn("seed_in", F.array_distinct("moments.session_id"))
    around = F.flatten(F.transform("moments", lambda m: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.struct(m["session_id"].alias("session_id"), (F.floor(m["at_s"] / seconds) + d).alias("bucket")))))
    mine = mine.withColumn("s", F.explode(F.array_distinct(around))).select("seed_id", "moments", "seed_in", "s.session_id", "s.bucket")
    inside = lambda m: F.floor(m["at_s"] / seconds) - F.col("bucket")
    there = F.filter("moments", lambda m: (m["session_id"] == F.col("session_id")) & (F.abs(inside(m)) <= 1))
    mine = mine.withColumn("there", there).withColumn("plain", F.forall("there", lambda m: inside(m) == 0))
    # A plain seed is near all facts of the bucket; those that were in no earlier one, or only in sessions that the seed was not in, need no look.
    only, kinds = F.size("seed_in") == 1, lambda *names: F.array(*map(F.lit, names))
    mine = mine.withColumn("crosses", F.when(F.col("plain") & only, kinds("first", "later")).when(F.col("plain"), kinds("first")))
    mine = mine.withColumn("checks", F.when(F.col("plain") & only, kinds("again")).when(F.col("plain"), kinds("later", "again")).otherwise(kinds("first", "later", "again")))
    earlier = F.exists("before", lambda b: F.exists("moments", lambda y: (y["session_id"] == b["session_id"]) & (F.abs(y["at_s"] - b["at_s"]) <= seconds)))
    near = F.exists("here", lambda x: F.exists("there", lambda y: F.abs(x - y["at_s"]) <= seconds))
    return _pairs(mine, facts.withColumn("kind", kind), ["session_id", "bucket"], (F.col("plain") | near) & (~F.arrays_overlap("before_in", "seed_in") | ~earlier))


def session_window(links: DataFrame, episodes: DataFrame, seeds: DataFrame, seconds: int = 7200, most: int | None = None) -> DataFrame:
    """seed_id, fact_id of facts whose evidence lies in the same session within ``seconds`` of a seed's.

    Both sides are cut into buckets of the window's width; the partner looks into three.
    ``most`` as in ``shared_evidence``; the facts of one moment of a session are cut together, and seeds of one moment share their partners.
    """
    seen = episodes.filter("visibility_status = 'visible' AND searchable").select("episode_id", "session_id", "at_s")
    cited = open_links(links).filter("link_type = 'EVIDENCED_BY'").select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("episode_id"))
    placed = cited.join(seen, "episode_id").select("fact_id", "session_id", "at_s")
    if most is None:
        return _within(placed, seeds, seconds)
    placed = placed.distinct()
    bucket = F.floor(F.col("at_s") / seconds)
    mine = placed.join(seeds.select("fact_id"), "fact_id", "left_semi").select(F.col("fact_id").alias("seed_id"), "session_id", F.col("at_s").alias("seed_s"))
    moments = mine.select("session_id", "seed_s").distinct().withColumn("bucket", F.floor(F.col("seed_s") / seconds)).withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    near = moments.join(_first_facts(placed, ["session_id", "at_s"], most).withColumn("bucket", bucket), ["session_id", "bucket"])
    near = near.filter(F.abs(F.col("at_s") - F.col("seed_s")) <= seconds).select("session_id", "seed_s", "fact_id").distinct()
    return _partners(mine, _first_facts(near, ["session_id", "seed_s"], most), ["session_id", "seed_s"], most)


def shared_entities(links: DataFrame, entities: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """seed_id, fact_id of facts about an eligible entity that a seed is about too; ``most`` as in ``shared_evidence``."""
    about = open_links(links).filter("link_type = 'ABOUT_ENTITY'").select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("entity_id"))
    ok = entities.filter("visibility_status = 'visible' AND searchable AND sensitivity_level = 'normal'").select("entity_id")
    about = about.join(ok, "entity_id", "left_semi")
    if most is None:
        return _sharing(about.select("fact_id", F.col("entity_id").alias("key")), seeds)
    about = about.distinct()
    mine = about.join(seeds.select("fact_id"), "fact_id", "left_semi").select(F.col("fact_id").alias("seed_id"), "entity_id")
    return _partners(mine, _first_facts(about, ["entity_id"], most), ["entity_id"], most)


def linked_facts(links: DataFrame, seeds: DataFrame, types: list[str], outbound: bool = True, inbound: bool = True) -> DataFrame:
    """seed_id, fact_id, link_type one link away, against the links' direction with ``inbound``."""
    typed = open_links(links).filter(F.col("link_type").isin(types) & (F.col("to_type") == "fact")).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "link_type")
    parts = []
    if outbound:
        parts.append(typed.select(F.col("a").alias("seed_id"), F.col("b").alias("fact_id"), "link_type"))
    if inbound:
        parts.append(typed.select(F.col("b").alias("seed_id"), F.col("a").alias("fact_id"), "link_type"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.join(seeds.select(F.col("fact_id").alias("seed_id")), "seed_id", "left_semi").filter("seed_id <> fact_id").distinct()
