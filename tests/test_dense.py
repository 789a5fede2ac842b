"""Dense search: a part's vectors meet its queries in one product, and only what may be among the best leaves it."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from engramix.operators import dense, fusion

DRAW = random.Random(3)


def vector(n=8):
    return [DRAW.choice([-0.5, -0.25, 0.0, 0.125, 0.5, 1.0]) + DRAW.choice([0.0, 0.0, 1e-7]) for _ in range(n)]


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if len(a) == len(b) else 0.0


def test_a_part_leaves_the_best():
    """Three hundred copies tie for the best: ten of them leave the part, the smallest ids."""
    far, near = [0.0, 1.0], [1.0, 0.5]
    held = pa.table({"vec_id": [*range(400)], "v": [far] * 100 + [near] * 300, "norm": [1.0] * 100 + [1.25**0.5] * 300})
    asked = pa.table({"number": [5], "q": [[1.0, 0.0]], "q_norm": [1.0], "least": [0.0]})
    found = dense.best_of_part(10)(asked, held).to_pydict()
    assert found["vec_id"] == [*range(100, 110)] and set(found["number"]) == {5}


def test_top_k(spark):
    """Copies, ties, another length and several parts and ways, against all cosines."""
    same = vector()
    vectors = [(i, same if i % 5 == 0 else vector(6 if i % 17 == 1 else 8)) for i in range(700)]
    queries = [(i, "raw", 1.0, same if i == 0 else vector()) for i in range(9)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id long, variant string, weight double, q array<double>").select(F.struct("query_id", "variant", "weight").alias("key"), F.lit(0).cast("bigint").alias("space"), "q")
    got = dense.Cells(rows, pivots=3, part=50).top_k(asked, 12).collect()
    for i, *_, q in queries:
        mine = sorted((r["rank_position"], r["vec_id"], r["score"]) for r in got if r["key"]["query_id"] == i)
        want = sorted((-round(cosine(q, v), 6), k) for k, v in vectors if any(v) and round(cosine(q, v), 6) > 0)[:12]
        assert [(-s, v) for _, v, s in mine] == want and [r for r, *_ in mine] == [*range(1, len(want) + 1)]
    assert fusion.dense_top_k(asked.select("key.*", "q"), rows, 12).count() == len(got)
