import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from engramix.llm import near_dup, queries

SMALL = "/root/testdata/sf0.001"


def run(spark, docs, **how):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, class string, rid int")
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, **how).collect())


def edited(words, share, rng):
    return " ".join(w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in words)


@pytest.mark.parametrize("n", [2, 5])
def test_matches_all_pairs(spark, n):
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    docs = [(i, edited(base, 0.03, rng)) for i in range(100, 160)]  # one large group near the limit
    docs += [(i, edited([f"v{i // 5}_{j}" for j in range(80)], 0.03, rng)) for i in range(200, 260)]
    docs += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "É é"), (307, "é é"), (308, "Two words"), (309, "two\twords")]
    docs += [(400 + i, docs[0][1].upper()) for i in range(20)]
    assert run(spark, docs, shingle_words=n) == sorted(brute.near_dups(docs, n))


def test_query_matches_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op7_minhash_near_dedup"](spark, SMALL).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(brute.near_dups(docs))


def test_empty_and_repeated_and_null_ids(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]
    got = near_dup.near_duplicates(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "x y z"), (None, None)], "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == [
        ("5", 1, "5", True), ("5", 1, "5", True), ("None", 0, "None", True), ("None", 1, "None", True)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.node: r.root for r in near_dup.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
