import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from engramix.llm import bisection, lexical_search, queries, visits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k):
    """(item, rank, id, score) by scoring all documents in plain integers."""
    terms = lambda t: WORD.findall((t or "").translate(LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 25 + (75 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item", "rank", "id", "score").collect()), key=str)


rng = np.random.default_rng(11)
VOCABULARY = [f"w{n}" for n in range(60)] + ["Ärger", "naïve", "x_y", "日本語", "A-B", "é", "The", "THE", "the", "7"]
TEXTS = [" ".join(rng.choice(VOCABULARY, size=int(n))) for n in rng.integers(1, 40, 260)]
DOCS = [
    *enumerate(TEXTS), *[(n, "the same text of many rows w1 w2") for n in range(260, 400)], (5, TEXTS[5]), (5, TEXTS[5]), (None, TEXTS[7]), (None, "w1 w2 w3"),
    (500, None), (501, ""), (502, " \n.,;"), (503, "w9 " * 30000 + "rare"), (504, " ".join(f"u{n}" for n in range(5000))), (505, "ÄRGER ärger Ärger"),
]
ITEMS = [(1, "w1 w2 w2 the unknown"), (2, TEXTS[7]), (3, None), (4, ""), (5, "Ärger rare W9"), (5, "Ärger rare W9"), (None, "日本語 x y"), (7, "nothing known"), (8, "u4999 u1 b")]


@pytest.mark.parametrize("k,shelf,part,cluster,first,chunk", [(10, 8192, 1 << 20, 256, 8, 1024), (3, 40, 600, 8, 1, 4), (500, 100, 900, 16, 2, 1024)])
def test_equals_scoring_all(spark, monkeypatch, k, shelf, part, cluster, first, chunk):
    monkeypatch.setattr(visits, "FIRST", first)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    index = lexical_search.build_index(docs, shelf=shelf, part=part, cluster=cluster)
    got = lexical_search.search(index, spark.createDataFrame(ITEMS, "item_id long, text string"), k, chunk=chunk)
    assert found(got) == plain(DOCS, ITEMS, k)


def test_stops_before_all_clusters(spark, monkeypatch):
    monkeypatch.setattr(visits, "FIRST", 2)
    monkeypatch.setattr(visits, "GROWTH", 2)
    topics = [[f"t{topic}_{n}" for n in range(12)] for topic in range(16)]
    docs = [(n, " ".join(rng.choice(topics[n % 16], 10))) for n in range(960)]
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), cluster=16)
    visited, real = [], visits.visited_blocks
    monkeypatch.setattr(lexical_search, "visited_blocks", lambda i, v: visited.append(v.count()) or real(i, v))
    items = [(1, "t3_1 t3_2 t3_3 t3_4")]
    assert found(lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items, 10)
    assert sum(visited) < index.clusters.count() / 4


def test_bisection_puts_like_documents_side_by_side():
    doc = np.repeat(np.arange(64), 5)
    term = np.concatenate([rng.choice(10, 5, replace=False) + 10 * (d % 2) for d in range(64)])
    order, preferences = bisection.bisect(doc, term, 64, 20, 1)
    assert sorted(order) == list(range(64)) and len({d % 2 for d in order[:32]}) == 1
    leaf = bisection.routed(doc, term, 64, preferences)
    assert all(leaf[d] == leaf[d % 2] for d in range(64)) and leaf[0] != leaf[1]


@pytest.mark.parametrize("n,levels", [(0, 3), (1, 2), (5, 3), (7, 1), (100, 4)])
def test_bisection_of_any_size_is_a_permutation(n, levels):
    doc = np.repeat(np.arange(n), 3)
    order, _ = bisection.bisect(doc, rng.integers(0, 9, len(doc)), n, 9, levels)
    assert sorted(order.tolist()) == list(range(n))


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("x", 1, n, t, 2, [3]) for n, t in enumerate(TEXTS[:20])], "shelf string, n int, doc_id long, text string, score int, terms array<int>")
    items = spark.createDataFrame([("a", "w1 w2", 1, "z")], "item_id string, text string, rank int, id string")
    assert found(lexical_search.search(lexical_search.build_index(docs), items)) == plain(list(enumerate(TEXTS[:20])), [("a", "w1 w2")], 10)
    none = lexical_search.build_index(docs.limit(0))
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).columns == ["item", "rank", "id", "score"]


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_lexical_search"](spark, data)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_lexical_search"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
