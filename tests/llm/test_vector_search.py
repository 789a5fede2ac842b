import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from engramix.llm import queries, vector_search, visits


def plain(rows, k, every=100, scale=1024):
    """(query_id, rank, id, score) by comparing all pairs."""
    top = 1 << 24
    whole = lambda x: max(-top, min(top, math.floor(scale * float(x)) if math.isfinite(scale * float(x)) else int(math.copysign(top, x))))
    kept = [(n, i, [whole(x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in kept:
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0, j) for m, j, v in kept if m != n and len(v) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()), key=str)


NAN, INF = float("nan"), float("inf")
rng = np.random.default_rng(3)
ROWS = [
    *[(int(i), rng.normal(size=6).tolist()) for i in range(300)], *[(i, [0.5] * 6) for i in range(300, 460)], (0, [0.5] * 6), (0, [0.5] * 6),
    (600, None), (700, [NAN] * 6), (800, [INF] * 6), (900, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1000, []), (1001, []), (1100, [0.25, 0.5]), (1101, [-0.25, 0.5]),
    (1200, [1.0, 2.0, 3.0]), (None, [0.5] * 6), (1300, [3e38, -3e38, 0.0, 0.0, 0.0, 0.0]),
]


@pytest.mark.parametrize("k,block,chunk,first", [(10, 128, 4096, 8), (3, 7, 5, 4), (500, 16, 4096, 2)])
def test_equals_all_pairs(spark, monkeypatch, k, block, chunk, first):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(visits, "FIRST", first)
    monkeypatch.setattr(visits, "GROWTH", 2)
    rows = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>").repartition(3)
    index = vector_search.build_index(rows, F.col("vec_id") % 100 == 0)
    assert found(vector_search.top_k(index, k, chunk)) == plain(ROWS, k)
    assert index.blocks.agg(F.sum(F.size("rows"))).first()[0] == index.vectors.count()
    assert index.blocks.agg(F.max(F.size("rows"))).first()[0] <= block


def test_far_blocks_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 8)
    monkeypatch.setattr(visits, "FIRST", 1)
    monkeypatch.setattr(visits, "GROWTH", 2)
    centers = np.eye(8) * 2
    rows = [(i, (centers[i % 8] + rng.normal(size=8) * 0.01).tolist()) for i in range(800)]
    index = vector_search.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    scored = []
    real = visits.visited_blocks
    monkeypatch.setattr(vector_search, "visited_blocks", lambda i, v: scored.append(v.count()) or real(i, v))
    got = found(vector_search.top_k(index, 10))
    assert got == [r for r in plain(rows, 10) if r[0] == 0]
    assert sum(scored) < index.blocks.count() / 3


def test_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1.0, "a", 7, n, [n / 7, 1 - n / 7], 3) for n in range(9)], "row double, q string, block int, vec_id long, embedding array<float>, score int")
    index = vector_search.build_index(rows, F.col("vec_id") % 100 == 0)
    assert found(vector_search.top_k(index)) == plain([(n, np.float32([n / 7, 1 - n / 7]).tolist()) for n in range(9)], 10)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.top_k(vector_search.build_index(none, F.col("vec_id") % 100 == 0)).count() == 0


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_vector_topk"](spark, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_vector_topk"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
