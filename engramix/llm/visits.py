"""Visits of an index' blocks in the order of their bounds, until no block can hold a result:
what operators 12 and 13 share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Blocks that a query visits in the first round, and how much more they may be in each further round.
FIRST = 8
GROWTH = 8

Score = Callable[[DataFrame, dict[int, int]], DataFrame]


def ranked(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each query, numbered in ``rank``; tasks cut theirs before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def visit(bounds: DataFrame, k: int, score: Score) -> DataFrame:
    """The ``k`` best rows of each query: query, id, row, score, rank.

    ``bounds`` (query, shelf, block, bound) is a written table: no score in the block exceeds the bound.
    ``score(visits, least)`` gets rows (shelf, block, queries) and each query's k-th score so far, and
    gives rows (query, id, row, score), which may leave out scores below the least.

    In each round a query visits its next blocks, of the highest bounds, as long as these reach its k-th
    score; so results are exact, ties included. What a query has visited is the beginning of its list of blocks:
    the place where it ended is all that the driver keeps of it.
    """
    spark = bounds.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    best, least, limit, left = None, {}, FIRST, bounds
    while True:
        chosen = materialize(ranked(left, limit, [F.desc("bound"), F.asc("block")]))
        ends = chosen.filter(F.col("rank") == limit).select("query", "bound", "block").collect()
        found = score(chosen.groupBy("shelf", "block").agg(F.collect_list("query").alias("queries")), least)
        if best is not None:
            found = best.drop("rank").unionByName(found)
        best = materialize(ranked(found, k, order))
        least = {r["query"]: r["score"] for r in best.filter(F.col("rank") == k).collect()}
        open_ends = [(r["query"], least.get(r["query"]), r["bound"], r["block"]) for r in ends if r["bound"] >= least.get(r["query"], r["bound"])]
        if not open_ends:
            return best
        limit *= GROWTH
        marks = F.broadcast(spark.createDataFrame(open_ends, "query int, least bigint, end_bound bigint, end_block bigint"))
        beyond = (F.col("bound") < F.col("end_bound")) | ((F.col("bound") == F.col("end_bound")) & (F.col("block") > F.col("end_block")))
        reaching = F.col("least").isNull() | (F.col("bound") >= F.col("least"))
        left = bounds.join(marks, "query").filter(beyond & reaching).select(*bounds.columns)


def visited_blocks(index: DataFrame, visits: DataFrame) -> DataFrame:
    """The index' rows that are visited, with their queries. Of the shelves (folders of the index, few) only those with visits are read."""
    shelves = [r[0] for r in visits.select("shelf").distinct().collect()]
    return index.filter(F.col("shelf").isin(shelves)).join(visits, ["shelf", "block"])
