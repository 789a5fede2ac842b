"""Searches in one pass: only places among the best leave a task, and nothing is lost to the cut."""

import random

from pyspark.sql import functions as F

from engramix.functions import text as T
from engramix.operators import scan, search

WORDS = "the a ab abc bcd 日本 日本語 é red cat caterpillar 12345 other".split()


def corpus(spark, n=600):
    draw = random.Random(4)
    texts = {i: "the red cat" if i % 3 == 0 else " ".join(draw.choices(WORDS, k=draw.randint(0, 9))) for i in range(n)}
    late = {i: None if i % 7 == 0 else i % 5 for i in texts}
    asked = {j: " ".join(draw.sample(WORDS, 3)) for j in range(8)} | {8: "the red cat", 9: ""}
    docs = spark.createDataFrame([(i, t, late[i]) for i, t in texts.items()], "node_id long, search_text string, updated_s long").repartition(3)
    return texts, late, asked, docs, spark.createDataFrame(list(asked.items()), "query_id long, query_text string")


def test_what_leaves_a_task(spark):
    *_, docs, asked = corpus(spark)
    blocks = scan.blocks(asked.select("query_id", F.array_distinct(search.tokens(F.col("query_text"))).alias("terms")), ["terms"])
    split = docs.select("node_id", "updated_s", search.tokens(F.col("search_text")).alias("ts"))
    found = scan.ranked(split, blocks, 4, {w: 1.0 for w in WORDS}, search.K1, search.B, 4.0)
    # Three tasks with one batch each, of 256 rows at most; a third of all documents tie.
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * 4
    assert len(scan.blocks(asked.select("query_id", T.fields(F.col("query_text")).alias("terms")), ["terms"])[0]) == 9


def test_containment_and_match_score(spark):
    texts, late, asked, docs, queries = corpus(spark)
    want, shares = [], []
    for j, q in asked.items():
        terms = set(q.split())
        hits = {i: sum(t in x for t in terms) + (len(terms) + 1) * (q in x) for i, x in texts.items() if terms}
        best = sorted((-s, -1 if late[i] is None else -late[i] - 10, i) for i, s in hits.items() if s)
        best = sorted(((s, late[i] is None, -(late[i] or 0), i) for s, _, i in best))[:5]
        want += [(j, i, -s, r + 1) for r, (s, _, _, i) in enumerate(best)]
        shares += [(j, i) for i, x in texts.items() if terms and 2 * sum(t in x for t in terms) > len(terms)]
    got = search.containment(docs, queries, 5)
    assert sorted((r.query_id, r.node_id, r.score, r.rank_position) for r in got.collect()) == sorted(want)
    held = search.term_counts(docs, queries.select("query_id", T.normalize(F.col("query_text")).alias("q"), T.fields(F.col("query_text")).alias("terms")), None)
    assert sorted((r.query_id, r.node_id) for r in held.collect()) == sorted(shares)
