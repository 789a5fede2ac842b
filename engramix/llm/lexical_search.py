"""Ranked lexical search (operator 12): documents are reordered by recursive graph bisection and cut into
clusters; a query visits clusters in the order of their bounds, with exact stopping.

Index. (1) A bounded sample (``SAMPLE`` documents on average, ``FEATURES`` hashed terms of each) is bisected on the driver; its
preferences, at most 2 ** ``LEVELS`` nodes, deal every document to a shelf while it is split into terms. (2) A shelf is dealt, by row number, to
parts of about ``PART`` postings each, however many rows it has. (3) A task bisects each part down to clusters of at most ``CLUSTER`` documents.
A row of the index is a cluster: its documents, its terms with their postings (place in the cluster and impact) and each
term's largest impact. Every document with a term is in the index with all its terms; only the order comes from the sample, so it changes
no result. Places in a cluster follow the ids, so that ties are settled by id.

Search. Queries come in chunks (``CHUNK`` rows, ``TERMS`` terms at most). Terms' document counts come from the clusters' dictionaries;
a cluster's bound for a query is the sum of weight times largest impact. A query visits clusters in the order of these bounds
(``visits.visit``), scores them through their postings and stops when no bound reaches its k-th score, so results are exact.

All numbers are 64-bit integers but for the logarithm of a weight. Terms are maximal runs of letters, digits and characters beyond
ASCII of whole texts, A-Z lower-cased. Null and empty texts have none: they are in no result, and as queries have no
results. Repeated rows and equal ids are documents (or queries) of their own; null ids come last among ties. Very long texts are a cluster's
rows like others. Further columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bisection import bisect, routed
from .common import give_back, materialize, scratch_dir, ship_package
from .toxicity import spread
from .visits import visit, visited_blocks

SAMPLE = 8192
FEATURES = 64
#: Hashed terms of the sample's graph.
BUCKETS = 1 << 13
LEVELS = 6
#: Documents of a shelf, as long as there are fewer than 2 ** LEVELS shelves.
SHELF = 8192
#: Postings of a part, about.
PART = 1 << 20
CLUSTER = 256
CHUNK = 1024
TERMS = 1 << 18
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def text_terms(text: str | None) -> Counter:
    """The terms with their occurrences. A term's characters are those whose UTF-8 bytes are letters, digits or beyond ASCII."""
    return Counter(WORD.findall((text or "").encode("utf-8", "surrogatepass").lower()))


def buckets(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) % BUCKETS for t in terms), np.int64, len(terms))


@dataclass
class LexicalIndex:
    """``clusters``: shelf, block, rows, ids, terms, starts, tops, docs, impacts."""

    clusters: DataFrame
    n_docs: int
    n_terms: int
    id_type: str


def fit_shelves(docs: DataFrame, text_col: str, sample: int, shelf: int) -> list[np.ndarray]:
    """The preferences that deal documents to shelves."""
    n = docs.count()
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(n, 1) / shelf))))
    if not levels:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(buckets(list(text_terms(x.as_py()))))[:FEATURES].tolist() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["features"])

    rows = docs.sample(min(1.0, sample / n), seed=7).select(text_col).mapInArrow(run, "features array<int>").collect()
    sizes = [len(r[0]) for r in rows]
    term = np.array([x for r in rows for x in r[0]], np.int64)
    return bisect(np.repeat(np.arange(len(rows)), sizes), term, len(rows), BUCKETS, levels)[1]


def counted(docs: DataFrame, preferences: list[np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """row, id, shelf, n (all terms with repeats), terms and tfs of the documents that have terms. Terms are joined by
    blanks and counts packed as 32-bit integers: arrays of strings take more than twice the room in a shuffle."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_terms(x.as_py()) for x in batch.column(2)]
            at = np.array([i for i, c in enumerate(found) if c], np.int64)
            found = [found[i] for i in at]
            sizes = np.array([len(c) for c in found], np.int64)
            leaf = routed(np.repeat(np.arange(len(at)), sizes), buckets([t for c in found for t in c]), len(at), preferences) if preferences else np.zeros(len(at))
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(leaf.astype(np.int32)), pa.array([c.total() for c in found], pa.int64()),
                 pa.array([b" ".join(c) for c in found], pa.binary()).cast(pa.string()), pa.array([np.fromiter(c.values(), "<i4", len(c)).tobytes() for c in found], pa.binary())],
                ["row", "id", "shelf", "n", "terms", "tfs"],
            )
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, f"row bigint, id {key}, shelf int, n bigint, terms string, tfs binary"))


def cluster_part(table: pa.Table, n_docs: int, n_terms: int, cluster: int = CLUSTER) -> Iterator[pa.RecordBatch]:
    """The clusters of a part's documents (columns of ``counted``)."""
    table = table.combine_chunks()
    terms = pc.split_pattern(table["terms"].chunk(0), " ")
    ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
    size = table.num_rows
    words = terms.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(size), np.diff(ends))
    tf = np.frombuffer(b"".join(table["tfs"].to_pylist()), "<i4").astype(np.int64)
    m = 25 + (75 * table["n"].to_numpy().astype(np.int64) * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])

    levels = max(0, math.ceil(math.log2(size / cluster)))
    shared = np.bincount(code, minlength=len(words.dictionary)) > 1
    narrow = np.cumsum(shared) - 1
    edges = np.flatnonzero(shared[code])
    order, _ = bisect(doc[edges], narrow[code[edges]], size, int(shared.sum()), levels)

    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
    ids, rows = table["id"].chunk(0), table["row"].to_numpy()
    borders = np.linspace(0, size, 2**levels + 1).astype(np.int64)
    for lo, hi in zip(borders[:-1], borders[1:], strict=True):
        own = order[lo:hi]
        if not len(own):
            continue
        own = own[pc.sort_indices(pa.table({"id": ids.take(pa.array(own)), "row": rows[own]}), [("id", "ascending"), ("row", "ascending")]).to_numpy()]
        lengths = ends[own + 1] - ends[own]
        at = spread(ends[own], lengths)
        place = np.repeat(np.arange(len(own)), lengths)
        by_term = np.argsort(code[at], kind="stable")
        at, place = at[by_term], place[by_term]
        names, starts = np.unique(code[at], return_index=True)
        yield pa.RecordBatch.from_arrays(
            [table["shelf"].chunk(0)[:1], pa.array([rows[own].min()], pa.int64()), one(rows[own], pa.int64()), one(ids.take(pa.array(own)), None),
             one(words.dictionary.take(pa.array(names)), None), one(np.append(starts, len(at)), pa.int32()),
             one(np.maximum.reduceat(impact[at], starts), pa.int32()), one(place, pa.int32()), one(impact[at], pa.int32())],
            ["shelf", "block", "rows", "ids", "terms", "starts", "tops", "docs", "impacts"],
        )


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, shelf: int = SHELF, part: int = PART, cluster: int = CLUSTER
) -> LexicalIndex:
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = counted(docs, fit_shelves(docs, text_col, sample, shelf), id_col, text_col)
    shelves = rows.groupBy("shelf").agg(F.count("*"), F.sum("n"), F.sum((F.length("tfs") / 4).cast("bigint"))).collect()
    n_docs, n_terms = sum(r[1] for r in shelves), sum(r[2] for r in shelves)
    # At most 2 ** LEVELS shelves.
    parts = F.create_map(*[F.lit(x) for r in shelves for x in (r[0], -(-r[3] // part))]) if shelves else F.create_map(F.lit(0), F.lit(1))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), parts[F.col("shelf")]))
    kind = (
        f"shelf int, block bigint, rows array<bigint>, ids array<{id_type}>, terms array<string>, starts array<int>, tops array<int>,"
        " docs array<int>, impacts array<int>"
    )

    def arrange(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(list(cluster_part(table, n_docs, n_terms, cluster)))
        give_back()
        return out

    path = scratch_dir(spark)
    dealt.groupBy("shelf", "part").applyInArrow(arrange, kind).write.partitionBy("shelf").parquet(path)
    return LexicalIndex(spark.read.schema(kind).parquet(path), n_docs, n_terms, id_type)


class Chunk:
    """A chunk's queries: the vocabulary, and for each query its terms with their weights."""

    def __init__(self, found: list[Counter]):
        self.vocabulary = sorted({t for c in found for t in c})
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.sizes = np.array([len(c) for c in found], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.terms = np.array([number[t] for c in found for t in c], np.int64)
        self.repeats = np.array([x for c in found for x in c.values()], np.int64)
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, counts: dict[int, int], n_docs: int) -> None:
        w = np.zeros(len(self.vocabulary), np.int64)
        for t, df in counts.items():
            w[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        self.weights = w[self.terms] * self.repeats

    def places(self, names: pa.Array) -> np.ndarray:
        """Where each term of the vocabulary is among ``names``; -1 if it isn't."""
        known = pa.array(self.vocabulary, pa.binary()).cast(pa.string())
        return pc.fill_null(pc.index_in(known, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def bounds(self, names: pa.Array, tops: np.ndarray) -> np.ndarray:
        at = self.places(names)
        top = np.where(at >= 0, tops[at], 0)
        return np.add.reduceat(np.append(self.weights * top[self.terms], 0), self.starts[:-1]) * (self.sizes > 0)

    def scores(self, row: dict, query: int, places: np.ndarray) -> np.ndarray:
        own = slice(self.starts[query], self.starts[query + 1])
        at, weights = places[self.terms[own]], self.weights[own]
        at, weights = at[at >= 0], weights[at >= 0]
        lengths = row["starts"][at + 1] - row["starts"][at]
        hits = spread(row["starts"][at], lengths)
        out = np.zeros(row["size"], np.int64)
        np.add.at(out, row["docs"][hits], np.repeat(weights, lengths) * row["impacts"][hits])
        return out


def document_counts(index: LexicalIndex, chunk: Chunk) -> dict[int, int]:
    """The documents that hold each term of the chunk's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(chunk.vocabulary), np.int64)
        for batch in batches:
            for names, starts in zip(*batch.columns, strict=True):
                at = chunk.places(names.values)
                held = np.diff(starts.values.to_numpy())
                total += np.where(at >= 0, held[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])

    parts = index.clusters.select("terms", "starts").mapInArrow(run, "term int, n bigint")
    return {r[0]: r[1] for r in parts.groupBy("term").agg(F.sum("n")).collect()}


def chunks(items: DataFrame, most: int, terms: int) -> Iterator[tuple[list, list[Counter]]]:
    """Ids and terms of the query rows, in lists of bounded size."""
    ids, found, held = [], [], 0
    for key, text in items.toLocalIterator():
        counts = text_terms(text)
        if ids and (len(ids) == most or held + len(counts) > terms):
            yield ids, found
            ids, found, held = [], [], 0
        ids.append(key)
        found.append(counts)
        held += len(counts)
    if ids:
        yield ids, found


def search(
    index: LexicalIndex, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", chunk: int = CHUNK, terms: int = TERMS
) -> DataFrame:
    """item, rank, id and score of the ``k`` highest-scoring documents (score above 0) of each row of ``items``."""
    spark = items.sparkSession
    id_type, paths = index.id_type, []
    item_type = items.schema[item_col].dataType.simpleString()
    kind = f"item {item_type}, rank int, id {id_type}, score bigint"
    for ids, found in chunks(items.select(item_col, text_col), chunk, terms):
        queries = Chunk(found)
        queries.weigh(document_counts(index, queries), index.n_docs)

        def bound(batches: Iterator[pa.RecordBatch], queries: Chunk = queries) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shelf, block, names, tops in zip(*batch.columns, strict=True):
                    bounds = queries.bounds(names.values, tops.values.to_numpy().astype(np.int64))
                    at = np.flatnonzero(bounds > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at, pa.int32()), pa.repeat(shelf, len(at)), pa.repeat(block, len(at)), pa.array(bounds[at])], ["query", "shelf", "block", "bound"]
                    )

        def score(visits: DataFrame, least: dict[int, int], queries: Chunk = queries) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for rows, keys, names, starts, docs, impacts, asked in zip(*batch.columns, strict=True):
                        row = {"size": len(rows), "starts": starts.values.to_numpy(), "docs": docs.values.to_numpy(), "impacts": impacts.values.to_numpy()}
                        places = queries.places(names.values)
                        query, place, points = [], [], []
                        for n in asked.values.to_numpy().tolist():
                            scores = queries.scores(row, n, places)
                            at = np.flatnonzero(scores >= max(least.get(n, 1), 1))
                            at = at[np.argsort(-scores[at], kind="stable")[:k]]
                            query.append(np.full(len(at), n))
                            place.append(at)
                            points.append(scores[at])
                        place = pa.array(np.concatenate(place))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(query), pa.int32()), keys.values.take(place), rows.values.take(place), pa.array(np.concatenate(points))],
                            ["query", "id", "row", "score"],
                        )
                give_back()

            rows = visited_blocks(index.clusters, visits).select("rows", "ids", "terms", "starts", "docs", "impacts", "queries")
            return rows.mapInArrow(run, f"query int, id {id_type}, row bigint, score bigint")

        bounds = index.clusters.select("shelf", "block", "terms", "tops").mapInArrow(bound, "query int, shelf int, block bigint, bound bigint")
        best = visit(materialize(bounds), k, score)
        named = spark.createDataFrame(list(enumerate(ids)), f"query int, item {item_type}")
        paths.append(scratch_dir(spark))
        best.join(F.broadcast(named), "query").select("item", "rank", "id", "score").write.parquet(paths[-1])
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
