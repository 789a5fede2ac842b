"""Exact top-k search (operator 13): inner products of integer vectors by block-at-a-time pruning.

Index: vectors of like direction come to lie side by side (the nearest of ``PIVOTS`` pivots, a bounded sample
of the vectors; then the similarity to it) and are cut into ranges of at most ``BLOCK`` rows. A row of the index is
such a block: its forward index (all components) and, for every component, its largest and smallest
value. Taken as terms, a component's positive and negative parts have these as maxima: a query's sum of q * largest (q > 0)
and q * smallest (q < 0) bounds every inner product in the block. The order only sharpens the bounds; every vector is in
the index and results are exact. A hot pivot's rows are dealt to many blocks and tasks, as ranges end in the row's number.

Search: queries come in chunks (``CHUNK`` rows and ``COMPONENTS`` numbers at most, the only thing sent to all tasks), each
query visits blocks in the order of their bounds (``visits.visit``) and scores them through the forward indexes until bounds fall below its k-th score.

Vectors that are null or hold null or non-finite components take no part; an empty vector meets only other empty ones
(score 0), as vectors meet those of their own length. Components saturate at ``SATURATION``. A query meets every row but its own;
repeated rows and equal ids are rows of their own; ties go to the smaller id, null ids last. A null id is no query unless the caller says so.
Further columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, ship_package
from .vectors import exact_products, finite, integers, matrix
from .visits import visit, visited_blocks

PIVOTS = 64
BLOCK = 128
CHUNK = 4096
COMPONENTS = 1 << 20
#: Blocks whose bounds are put out at once.
SLICE = 64


@dataclass
class VectorIndex:
    """``vectors``: row, id, q (is a query), v. ``blocks``: shelf, block, dims, rows, ids, flat, tops, lows."""

    vectors: DataFrame
    blocks: DataFrame
    id_type: str


def numbered(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    kept = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vec_col).alias("v")
    )
    return materialize(kept.filter(finite(F.col("v"))).withColumn("v", integers(F.col("v"), scale)))


def build_index(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> VectorIndex:
    spark = vectors.sparkSession
    ship_package(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = numbered(vectors, is_query, id_col, vec_col, scale)
    pivots: dict[int, list] = {}
    for r in rows.select("v").orderBy(F.xxhash64("row")).limit(PIVOTS).collect():
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    near = {d: np.array(p, np.int64) for d, p in pivots.items() if d}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            shelf, likeness = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int64)
            for d in set(dims.tolist()) & near.keys():
                at = np.flatnonzero(dims == d)
                products = exact_products(matrix(batch.column(2).take(pa.array(at)), d), near[d])
                shelf[at], likeness[at] = products.argmax(1), products.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(shelf), pa.array(likeness)], ["row", "id", "v", "dims", "shelf", "likeness"])

    key = f"row bigint, id {id_type}, v array<int>, dims int, shelf int, likeness bigint"
    placed = materialize(rows.select("row", "id", "v").mapInArrow(place, key))
    order = ["shelf", "dims", F.desc("likeness"), "row"]
    ranges = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        names = None

        def block(part: pa.Table) -> pa.RecordBatch:
            part = part.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
            d = part["dims"][0].as_py()
            v = matrix(part["v"].chunk(0), d, np.int32)
            tops, lows = (v.max(0), v.min(0)) if d else (v[0], v[0])
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
            row = part["row"].chunk(0)
            return pa.RecordBatch.from_arrays(
                [part["shelf"].chunk(0)[:1], pa.array([min(row.to_pylist())], pa.int64()), part["dims"].chunk(0)[:1], one(row, None), one(part["id"].chunk(0), None),
                 one(v.ravel(), pa.int32()), one(tops, pa.int32()), one(lows, pa.int32())],
                ["shelf", "block", "dims", "rows", "ids", "flat", "tops", "lows"],
            )

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """All blocks that are known to be over; the open rest stays."""
            table = pa.Table.from_batches(kept)
            kinds = np.stack([table["shelf"].to_numpy(), table["dims"].to_numpy()])
            borders = [0, *(np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).any(0)) + 1).tolist(), len(table)]
            for lo, hi in zip(borders, borders[1:], strict=False):
                while lo < hi and (hi - lo >= BLOCK or hi < len(table) or last):
                    yield block(table.slice(lo, min(BLOCK, hi - lo)))
                    lo = min(hi, lo + BLOCK)
                if lo < hi:
                    kept[:] = table.slice(lo, hi - lo).to_batches()
                    return
            kept.clear()

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                yield from blocks(False)
        if kept:
            yield from blocks(True)

    kind = f"shelf int, block bigint, dims int, rows array<bigint>, ids array<{id_type}>, flat array<int>, tops array<int>, lows array<int>"
    path = scratch_dir(spark)
    ranges.mapInArrow(cut, kind).write.partitionBy("shelf").parquet(path)
    return VectorIndex(rows, spark.read.schema(kind).parquet(path), id_type)


def chunks(queries: DataFrame, most: int, components: int) -> Iterator[list[Row]]:
    """The query rows in lists of bounded size."""
    part, held = [], 0
    for r in queries.toLocalIterator():
        if part and (len(part) == most or held + len(r["v"]) > components):
            yield part
            part, held = [], 0
        part.append(r)
        held += len(r["v"])
    if part:
        yield part


class Chunk:
    """A chunk's queries by their length: numbers, rows and matrices."""

    def __init__(self, part: list[Row]):
        self.by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.at = np.zeros(len(part), np.int64)
        self.rows = np.array([r["row"] for r in part], np.int64)
        found: dict[int, list[int]] = {}
        for n, r in enumerate(part):
            self.at[n] = len(found.setdefault(len(r["v"]), []))
            found[len(r["v"])].append(n)
        for d, at in found.items():
            self.by_dims[d] = np.array(at, np.int32), np.array([part[n]["v"] for n in at], np.int64).reshape(len(at), d)

    def bounds(self, blocks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """query, shelf, block, bound for all queries of the blocks' length."""
        dims = blocks.column(2).to_numpy()
        for d in set(dims.tolist()) & self.by_dims.keys():
            numbers, q = self.by_dims[d]
            signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
            at = np.flatnonzero(dims == d)
            for lo in range(0, len(at), SLICE):
                part = blocks.take(pa.array(at[lo : lo + SLICE]))
                edges = np.concatenate([matrix(part.column(3), d), matrix(part.column(4), d)], axis=1)
                bound = exact_products(signed, edges)
                repeat = lambda c, n=len(numbers): pa.array(np.tile(c.to_numpy(), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(numbers, part.num_rows)), repeat(part.column(0)), repeat(part.column(1)), pa.array(bound.ravel())], ["query", "shelf", "block", "bound"]
                )

    def scores(self, v: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int, least: dict[int, int]) -> Iterator[tuple[int, int, int]]:
        """(query, place in the block, score) of each query's best rows, which lie in the order of ids."""
        _, q = self.by_dims[v.shape[1]]
        for n, s in zip(queries.tolist(), exact_products(q[self.at[queries]], v), strict=True):
            ok = rows != self.rows[n]
            if n in least:
                ok &= s >= least[n]
            at = np.flatnonzero(ok)
            for i in at[np.argsort(-s[at], kind="stable")[:k]].tolist():
                yield n, i, int(s[i])


def top_k(index: VectorIndex, k: int = 10, chunk: int = CHUNK, components: int = COMPONENTS) -> DataFrame:
    """query_id, rank, id and score of each query's best rows."""
    spark = index.vectors.sparkSession
    id_type, paths = index.id_type, []
    kind = f"query_id {id_type}, rank int, id {id_type}, score bigint"
    for part in chunks(index.vectors.filter("q").select("row", "id", "v"), chunk, components):
        queries = Chunk(part)

        def bound(batches: Iterator[pa.RecordBatch], queries: Chunk = queries) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from queries.bounds(batch)

        def score(visits: DataFrame, least: dict[int, int], queries: Chunk = queries) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for dims, rows, ids, flat, asked in zip(*batch.columns, strict=True):
                        v = flat.values.to_numpy().astype(np.int64).reshape(len(rows), dims.as_py())
                        found = list(queries.scores(v, rows.values.to_numpy(), asked.values.to_numpy(), k, least))
                        n, i, s = zip(*found, strict=True) if found else ((), (), ())
                        i = pa.array(i, pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), ids.values.take(i), rows.values.take(i), pa.array(s, pa.int64())], ["query", "id", "row", "score"])

            rows = visited_blocks(index.blocks, visits).select("dims", "rows", "ids", "flat", "queries")
            return rows.mapInArrow(run, f"query int, id {id_type}, row bigint, score bigint")

        bounds = index.blocks.select("shelf", "block", "dims", "tops", "lows").mapInArrow(bound, "query int, shelf int, block bigint, bound bigint")
        best = visit(materialize(bounds), k, score)
        named = spark.createDataFrame([(n, r["id"]) for n, r in enumerate(part)], f"query int, query_id {id_type}")
        paths.append(scratch_dir(spark))
        best.join(F.broadcast(named), "query").select("query_id", "rank", "id", "score").write.parquet(paths[-1])
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
