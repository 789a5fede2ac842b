"""Segments of the inverted index against rebuilds, and grams against plain substring tests."""

import random

import pytest
from pyspark.sql import functions as F

from engramix.operators import postings, search

WORDS = "ab abc bcd cde xy xyz 日本 日本語 é the then other".split()
DOCS, QUERIES = "node_id long, search_text string", "query_id long, query_text string"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_upserts_and_deletes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))
    now = {i: text() for i in range(40)}
    asked = spark.createDataFrame([(i, text()) for i in range(12)], QUERIES)
    index = postings.build(spark.createDataFrame(list(now.items()), DOCS), str(tmp_path / "a"))
    for step in range(3):
        fresh = {rng.randrange(60): text() for _ in range(8)}
        index = index.upsert(spark.createDataFrame(list(fresh.items()), DOCS))
        now |= fresh
        gone = rng.sample(range(70), 6)
        index = index.delete(spark.createDataFrame([(i,) for i in gone], "node_id long"))
        now = {k: v for k, v in now.items() if k not in gone}
        # Only the changed documents were split for the new segments.
        assert spark.read.parquet(f"{index.path}/{index.segments[-2]}/docs").count() == len(fresh)
        again = postings.build(spark.createDataFrame(list(now.items()), DOCS), str(tmp_path / f"b{step}"))
        assert (index.n_docs, index.n_tokens) == (again.n_docs, again.n_tokens)
        want = rows(search.bm25(spark.createDataFrame(list(now.items()), DOCS), asked, 5), "query_id", "node_id", "score", "rank_position")
        assert rows(index.bm25(asked, 5), "query_id", "node_id", "score", "rank_position") == want
    small = index.compact(str(tmp_path / "c"))
    assert len(small.segments) == 1 and rows(small.bm25(asked, 5), "query_id", "node_id", "score", "rank_position") == want


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], DOCS), str(tmp_path / "a"))
    assert index.bm25(spark.createDataFrame([(1, "ab")], QUERIES), 5).count() == 0


def test_a_search_makes_no_pairs_of_queries_and_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the {i % 7}") for i in range(300)], DOCS)
    index = postings.build(docs, str(tmp_path / "a")).delete(docs.filter("node_id < 5").select("node_id"))
    found = index.bm25(spark.createDataFrame([(i, f"the {i}") for i in range(9)], QUERIES), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [query_id" not in plan
    assert rows(found, "query_id", "node_id")[:4] == [(0, 7), (0, 14), (1, 8), (1, 15)]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_grams_are_all_runs(spark, size):
    texts = ["", "a", "abcab", "aaaa", "日本語é😀x", "x" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search.grams(F.col("t"), size).alias("g")).collect()
    for r in got:
        assert sorted(r.g) == sorted({r.t[i : i + size] for i in range(len(r.t) - size + 1)})


def test_fields_that_hold_terms(spark):
    rng = random.Random(5)
    fields = ["".join(rng.choices("abcdé日", k=rng.randint(1, 9))) for _ in range(200)] + ["aaaa", "ab"]
    terms = ["".join(rng.choices("abcdé日", k=rng.randint(1, 5))) for _ in range(60)] + ["a", "aa", "aaa", "zzz"]
    got = search.holding_fields(spark.createDataFrame([(f,) for f in fields], "field string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert rows(got, "field", "term") == sorted((f, t) for f in set(fields) for t in set(terms) if t in f)


def test_a_megabyte_without_blanks(spark):
    """Linear in the field: every substring of it would be far too many."""
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    docs = spark.createDataFrame([(1, long, 5), (2, "short text", 6)], "node_id long, search_text string, updated_s long")
    asked = spark.createDataFrame([(1, long[500_000:500_020]), (2, "ort zzzzzzzzzz"), (3, long[10:700])], QUERIES)
    assert rows(search.containment(docs, asked, 5), "query_id", "node_id", "score") == [(1, 1, 3), (2, 1, 1), (2, 2, 1), (3, 1, 3)]
