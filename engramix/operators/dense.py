"""Dense search through cells: exact nearest vectors by cosine, without meeting vectors whose cell cannot hold a result.

Vectors belong to the nearest of a few pivots (a bounded sample of the vectors), their cell. A cell's edge is the smallest cosine between its vectors and the
pivot: by the triangle inequality of angles, no vector in the cell is nearer to a query than the angle between query and pivot less the
edge's. A query first meets the cells of the highest bounds that hold k vectors together; its k-th score there decides which others it
meets. Large cells are dealt to parts of ``PART`` vectors and their queries to parts of about ``ASKED``, so no key grows with the table. A part's
vectors meet its queries in one matrix product, which leaves each query's k best of the part; their scores are then summed in order, as SQL does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .search import top_k

PIVOTS, PART, ASKED = 32, 4096, 2048
#: Scores are rounded to six places; bounds that are lower by no more than this may still tie.
SLACK = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def doubled(vec: Column | str) -> Column:
    return F.transform(F.col(vec) if isinstance(vec, str) else vec, lambda x: x.cast("double"))


def best_of_part(k: int):
    """The work of one part for ``applyInArrow``: of the queries (number, q, q_norm, least) and vectors (vec_id, v, norm) those pairs that may be
    among a query's ``k`` best once scores are rounded to six places."""

    def run(asked, held):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def matrix(column, rows):
            column = column.combine_chunks().take(pa.array(rows))
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        q_all, v_all = (pc.list_value_length(t.column(c)).to_numpy() for t, c in ((asked, "q"), (held, "v")))
        ids, norms, q_norms, least = (t.column(c).to_numpy() for t, c in ((held, "vec_id"), (held, "norm"), (asked, "q_norm"), (asked, "least")))
        at_q, at_v, scores = [np.empty(0, "int64")], [np.empty(0, "int64")], [np.empty(0)]
        for size in np.unique(q_all):  # vectors of another length have no product with the query
            mine, others = np.flatnonzero(q_all == size), np.flatnonzero(v_all == size)
            if not len(others):
                continue
            v = matrix(held.column("v"), others)
            for start in range(0, len(mine), 256):
                rows = mine[start : start + 256]
                q = matrix(asked.column("q"), rows)
                near = q @ v.T / (q_norms[rows][:, None] * norms[others])
                floor = least[rows] if len(others) <= k else np.maximum(np.partition(near, len(others) - k, axis=1)[:, len(others) - k], least[rows])
                i, j = np.nonzero(~(near < floor[:, None] - 2e-6))
                total = np.zeros(len(i))
                for d in range(size):
                    total += q[i, d] * v[j, d]
                score = total / (norms[others[j]] * q_norms[rows[i]])
                # Of equal rounded scores the smaller ids; scores that lie on a border of rounding are left to SQL's rounding.
                scaled = score * 1e6
                place = np.where(np.isnan(score), np.inf, np.floor(scaled + 0.5))
                border = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
                order = np.lexsort((ids[others[j]], -place, border, i))
                i, j, score, place, border = i[order], j[order], score[order], place[order], border[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                last = np.full(len(rows), -np.inf)
                kth = ~border & (nth == k - 1)
                last[i[kth]] = place[kth]
                keep = np.where(border, ~(place < last[i] - 1), nth < k)
                at_q.append(rows[i[keep]]), at_v.append(others[j[keep]]), scores.append(score[keep])
        taken = lambda table, c, at: table.column(c).combine_chunks().take(pa.array(np.concatenate(at)))
        return pa.table({"number": taken(asked, "number", at_q), "vec_id": taken(held, "vec_id", at_v), "score": np.concatenate(scores)})

    return run


class Cells:
    """The index of ``vectors``: vec_id, embedding, and space, if they have one; a query meets vectors of its space only."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, part: int = PART):
        space = F.col("space") if "space" in vectors.columns else F.lit(0).cast("bigint")
        rows = vectors.select("vec_id", space.alias("space"), doubled("embedding").alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).filter("norm > 0")
        ends = rows.select("v", "norm").orderBy(F.xxhash64("vec_id")).limit(pivots)
        # One row of ``pivots`` vectors at most.
        self.pivots = stored(ends.agg(F.collect_list(F.transform("v", lambda x: x / F.col("norm"))).alias("pivots")))
        near = F.array_max(F.transform("pivots", lambda p, i: F.struct((dot(F.col("v"), p) / F.col("norm")).alias("cos"), (-i).alias("at"))))
        placed = rows.join(F.broadcast(self.pivots)).withColumn("near", near)
        placed = placed.select("vec_id", "space", "v", "norm", (-F.col("near.at")).alias("cell"), F.coalesce("near.cos", F.lit(-1.0)).alias("cos"))
        placed = stored(placed)
        sizes = placed.groupBy("space", "cell").agg(F.min("cos").alias("edge"), F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
        self.cells = stored(sizes)
        dealt = placed.join(self.cells.select("space", "cell", "parts"), ["space", "cell"])
        self.vectors = dealt.select("vec_id", "space", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "v", "norm")

    def bounds(self, queries: DataFrame) -> DataFrame:
        """The queries' rows with every cell of their space and the highest cosine that it may hold."""
        angle = lambda c: F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
        rows = queries.join(F.broadcast(self.pivots)).select(*queries.columns, F.posexplode(F.transform("pivots", lambda p: dot(F.col("q"), p) / F.col("q_norm"))).alias("cell", "cos"))
        met = rows.join(self.cells, ["space", "cell"])
        gap = angle(F.coalesce("cos", F.lit(1.0))) - angle(F.col("edge"))
        return met.withColumn("bound", F.when(gap <= 0, 1.0).otherwise(F.cos(gap)) + SLACK).drop("cos", "edge")

    def scores(self, visits: DataFrame, k: int, ways: int) -> DataFrame:
        """number, vec_id, score of the vectors in the visited cells that may be among the query's ``k`` best; ``visits`` has ``least``, below which none counts."""
        keys = ["space", "cell", "part", "way"]
        asked = visits.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "way": F.pmod(F.xxhash64("number"), F.lit(ways)).cast("int")})
        held = self.vectors.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
        met = asked.select("number", "q", "q_norm", "least", *keys).groupBy(*keys).cogroup(held.select("vec_id", "v", "norm", *keys).groupBy(*keys))
        found = met.applyInArrow(best_of_part(k), f"number bigint, vec_id {self.vectors.schema['vec_id'].dataType.simpleString()}, score double")
        return found.select("number", "vec_id", F.round("score", 6).alias("score")).filter("score > 0")

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """``queries``: key, space, q. key, vec_id, score, rank_position of the ``k`` nearest vectors with a cosine above 0."""
        asked = queries.withColumn("q", doubled("q")).withColumn("q_norm", F.sqrt(dot(F.col("q"), F.col("q")))).filter("q_norm > 0")
        asked = stored(asked.withColumn("number", F.monotonically_increasing_id()))
        ways = max(1, -(-asked.count() // ASKED))
        bounds = stored(self.bounds(asked.drop("key")).drop("q", "q_norm"))
        order = W.partitionBy("number").orderBy(F.desc("bound"), F.asc("cell"))
        before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        bounds = bounds.withColumn("first", before < k)
        best = [F.desc("score"), F.asc("vec_id")]
        visited = lambda rows: self.scores(rows.join(asked.select("number", "q", "q_norm"), "number"), k, ways)
        found = stored(top_k(visited(bounds.filter("first").withColumn("least", F.lit(0.0))), k, best, "number"))
        least = found.filter(F.col("rank_position") == k).select("number", F.col("score").alias("least"))
        rest = bounds.filter("NOT first").join(least, "number", "left").fillna(0.0, ["least"]).filter(F.col("bound") >= F.col("least"))
        every = top_k(found.drop("rank_position").unionByName(visited(rest)), k, best, "number")
        return every.join(asked.select("number", "key"), "number").drop("number")
