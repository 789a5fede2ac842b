"""Pairs of facts: each once, without a shuffle of the pairs, against a plain comparison of all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engramix.operators import graph


def tables(spark, moments, kind="EVIDENCED_BY"):
    """Links of facts to episodes (or entities); episode e lies in session e % 3."""
    draw = random.Random(7)
    links = [(f, e) for f in range(60) for e in draw.sample(range(len(moments)), draw.choice([0, 1, 1, 2, 2, 3, 5]))]
    rows = spark.createDataFrame(links + links[:9], "from_id long, to_id long").withColumns({"link_type": F.lit(kind), "visibility_status": F.lit("visible"), "searchable": F.lit(True)})
    episodes = spark.createDataFrame([(e, e % 3, at) for e, at in enumerate(moments)], "episode_id long, session_id long, at_s long").withColumns({"visibility_status": F.lit("visible"), "searchable": F.lit(True)})
    return links, rows, episodes, spark.range(0, 60, 4).withColumnRenamed("id", "fact_id")


def unshuffled(pairs):
    """Nothing is aggregated above the plan's first join."""
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    return "Aggregate" not in plan.split("Join")[0]


@pytest.mark.parametrize("kind", ["EVIDENCED_BY", "ABOUT_ENTITY"])
def test_sharing(spark, kind):
    links, rows, episodes, seeds = tables(spark, range(12), kind)
    entities = episodes.select(F.col("episode_id").alias("entity_id"), "visibility_status", "searchable", F.lit("normal").alias("sensitivity_level"))
    got = graph.shared_evidence(rows, episodes, seeds) if kind == "EVIDENCED_BY" else graph.shared_entities(rows, entities, seeds)
    held = {f: {e for g, e in links if g == f} for f in range(60)}
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in range(0, 60, 4) for b in range(60) if a != b and held[a] & held[b])
    assert unshuffled(got)


@pytest.mark.parametrize("width", [10, 40, 400])
def test_session_window(spark, width):
    draw = random.Random(5)
    moments = [draw.randint(-50, 300) for _ in range(30)]
    links, rows, episodes, seeds = tables(spark, moments)
    got = graph.session_window(rows, episodes, seeds, width)
    seen = {f: [(e % 3, moments[e]) for g, e in links if g == f] for f in range(60)}
    near = lambda a, b: any(s == t and abs(x - y) <= width for s, x in seen[a] for t, y in seen[b])
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in range(0, 60, 4) for b in range(60) if a != b and near(a, b))
    assert unshuffled(got)


def final_plan(pairs):
    """What has run, without the parts of the plan that were given up meanwhile."""
    pairs.collect()
    return pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_copies_are_not_broadcast(spark):
    """Seeds' copies for the parts of a hot moment never pass through the driver, however small Spark takes them to be."""
    facts, hot = 3000, 2
    rows = spark.range(facts).select(F.col("id").alias("from_id"), (F.col("id") % hot).alias("to_id"), F.lit("EVIDENCED_BY").alias("link_type"), F.lit("visible").alias("visibility_status"), F.lit(True).alias("searchable"))
    episodes = spark.createDataFrame([(e, e, 50 * e) for e in range(hot)], "episode_id long, session_id long, at_s long").withColumns({"visibility_status": F.lit("visible"), "searchable": F.lit(True)})
    got = graph.session_window(rows, episodes, spark.range(0, facts, 500).withColumnRenamed("id", "fact_id"), 40)
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(0, facts, 500) for b in range(a % hot, facts, hot) if a != b]
    joins = [x for x in final_plan(got).splitlines() if "Join" in x and "__part" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_written_pairs_stay_small(spark, tmp_path):
    """A key's pairs come together and in order, so files hold them in a fraction of a byte each."""
    facts, keys = 8000, 40
    rows = spark.range(facts).select(F.col("id").alias("from_id"), F.pmod(F.xxhash64("id"), F.lit(keys)).alias("to_id"), F.lit("EVIDENCED_BY").alias("link_type"), F.lit("visible").alias("visibility_status"), F.lit(True).alias("searchable"))
    episodes = spark.range(keys).select(F.col("id").alias("episode_id"), F.lit("visible").alias("visibility_status"), F.lit(True).alias("searchable"))
    graph.shared_evidence(rows, episodes, spark.range(0, facts, 4).withColumnRenamed("id", "fact_id")).write.parquet(str(tmp_path / "pairs"))
    held, led = Counter(r["to_id"] for r in rows.collect()), Counter(r["to_id"] for r in rows.filter("from_id % 4 = 0").collect())
    expected = sum(led[k] * (held[k] - 1) for k in held)
    back = spark.read.parquet(str(tmp_path / "pairs"))
    assert back.count() == back.distinct().count() == expected
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.6 * expected, size / expected


@pytest.mark.parametrize("way", ["evidence", "window", "entity"])
def test_smallest_partners(spark, way):
    draw = random.Random(9)
    moments = [draw.randint(-50, 300) for _ in range(12)]
    links, rows, episodes, seeds = tables(spark, moments, "ABOUT_ENTITY" if way == "entity" else "EVIDENCED_BY")
    entities = episodes.select(F.col("episode_id").alias("entity_id"), "visibility_status", "searchable", F.lit("normal").alias("sensitivity_level"))
    got = {"evidence": lambda: graph.shared_evidence(rows, episodes, seeds, 3), "window": lambda: graph.session_window(rows, episodes, seeds, 40, 3), "entity": lambda: graph.shared_entities(rows, entities, seeds, 3)}[way]()
    held = {f: {e for g, e in links if g == f} for f in range(60)}
    near = lambda d, e: d % 3 == e % 3 and abs(moments[d] - moments[e]) <= 40 if way == "window" else d == e
    found = {}
    for a, b in map(tuple, got.collect()):
        found.setdefault(a, []).append(b)
    for a in range(0, 60, 4):
        every = [b for b in range(60) if b != a and any(near(d, e) for d in held[a] for e in held[b])]
        # The smallest are there, and with the seed's own place one more at most.
        mine = sorted(found.get(a, []))
        assert mine[:3] == every[:3] and len(mine) <= 4 and set(mine) <= set(every)
    # No row is made for a pair before a seed's lists are cut: nothing lies between the plan's last aggregate and its explode.
    top = got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert "Generate explode" in top and "Join" not in top
