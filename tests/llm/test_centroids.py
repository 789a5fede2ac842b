import hashlib
import math

import duckdb
import numpy as np
import pytest

from engramix.llm import centroids, queries


def plain(rows, k, rounds, dims, scale=256):
    """The contract in plain Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in start]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cents)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), cents


def found(clustering):
    return sorted(((r[0], r["cluster"], r["distance"]) for r in clustering.rows.collect()), key=str), clustering.centroids.tolist()


NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [0.5, -0.5, 0.25]), (1, [0.5, -0.5, 0.25]), (2, [0.1, 0.2, 0.3]), (2, [0.2, 0.2, 0.3]), (None, [0.9, 0.0, -0.9]), (None, [0.0, 0.0, 0.0]),
    (3, None), (4, []), (5, [0.1, 0.2]), (6, [0.1, 0.2, 0.3, 0.4]), (7, [0.1, None, 0.3]), (8, [0.1, NAN, 0.3]), (9, [INF, 0.2, 0.3]), (10, [-INF, 0.2, 0.3]),
    *[(n, [math.sin(n), math.cos(3 * n), math.sin(5 * n)]) for n in range(11, 90)], *[(n, [0.25, 0.25, 0.25]) for n in range(90, 140)],
]


@pytest.mark.parametrize("k,rounds", [(1, 2), (4, 0), (7, 5), (500, 3)])
def test_equals_plain_rounds(spark, k, rounds):
    rows = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").repartition(3)
    assert found(centroids.cluster_vectors(rows, k=k, rounds=rounds, dims=3)) == plain(ODD, k, rounds, 3)


def test_clashing_columns_and_empty_tables(spark):
    kind = "cluster long, v string, norms int, id string, vec_id long, embedding array<float>, distance string"
    rows = [(9, "x", 1, "y", n, [n / 4, -n / 4], "z") for n in range(9)]
    out = centroids.cluster_vectors(spark.createDataFrame(rows, kind), k=3, rounds=2, dims=2)
    assert found(out) == plain([(r[4], r[5]) for r in rows], 3, 2, 2)
    none = centroids.cluster_vectors(spark.createDataFrame([], kind), dims=2)
    assert none.rows.columns == ["vec_id", "cluster", "distance"] and none.rows.count() == 0 and none.centroid_rows().count() == 0


def test_huge_components_saturate(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0])]
    out = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=1, rounds=1, dims=2)
    assert {r.vec_id for r in out.rows.collect()} == {1, 2, 3}


def test_screening_is_exact_and_prunes():
    rng = np.random.default_rng(5)
    cents = rng.integers(-200, 200, (30, 64)) * rng.integers(0, 2, (30, 64))
    v = cents[rng.integers(0, 30, 400)] + rng.integers(-6, 6, (400, 64))
    v[:40] = cents[3]
    cents[9] = cents[3]
    cluster, best, exact = centroids.screened(v, centroids.segment_norms(v), cents)
    full = ((v[:, None] - cents[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (best == full.min(1)).all()
    assert exact < full.size / 3


@pytest.mark.parametrize("d", [1, 7, 8, 9, 64])
def test_bounds_never_exceed_distances(d):
    rng = np.random.default_rng(d)
    v, c = rng.integers(-(1 << 24), 1 << 24, (50, d)), rng.integers(-(1 << 24), 1 << 24, (9, d))
    cluster, best, _ = centroids.screened(v, centroids.segment_norms(v), c)
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (best == full.min(1)).all()


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_centroids"](spark, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_centroids"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
