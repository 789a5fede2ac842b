"""MinHash near-dedup (operator 7): circulant MinHash, banding and exact Jaccard verification.

1. Every text becomes a set of n-word shingles (words between blanks, A-Z lower-cased;
   texts with fewer words are one shingle, texts without words have none).
   Texts with the same words fall into one class and go on as one.
2. Circulant MinHash: a permutation ``sigma`` spreads the shingles over ``UNIVERSE`` places,
   a second permutation ``pi`` is read from there, shifted by k for coordinate k. The K
   values of a shingle are so a contiguous window of ``pi``, and a signature is the
   minimum over the windows.
3. Signatures are cut into ``BANDS`` bands of ``ROWS`` rows. A pair with similarity 0.8
   misses all bands with a probability of 3e-6.
4. Buckets are searched without all their pairs. Every member is compared with its
   bucket's pivot (the row that shares most buckets) on the full sets, and links
   are contracted to components. A bucket whose other members are in one component is
   done. What is left open goes through a prefix filter with positions, which is exact:
   all pairs of different components that may link are compared. Nothing is capped.
5. Components by label propagation with pointer jumping over the contracted links.

Rows are numbered once and joined by that number, so repeated or null ids are
safe. Null, empty and blank texts have no shingles, link with nothing and are
their own component. Empty tables give empty results; other columns are not
read. Intermediate tables are written to the shared folder; nothing that grows
with the corpus reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, blank_words, give_back, keyed_rows, let, lower_ascii, materialize, ship_package

UNIVERSE_BITS = 20
UNIVERSE = 1 << UNIVERSE_BITS
BANDS = 32
ROWS = 5
SEED = 20_240_501
#: Words whose hashes a worker remembers.
WORD_CACHE = 200_000
#: Shingles whose windows are reduced at once.
BLOCK = 4096
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SIGNED = "rid bigint, doc_id {id}, text_hash bigint, class string, n_shingles bigint, bands array<bigint>"


class Signer:
    """Shingles, signatures and band keys of texts, in numpy."""

    def __init__(self, n: int):
        rng = np.random.default_rng(SEED)
        self.n = n
        self.sigma = rng.permutation(UNIVERSE).astype(np.uint32)
        pi = rng.permutation(UNIVERSE).astype(np.uint32)
        k = BANDS * ROWS
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
        odd = lambda size: rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.word_mix, self.row_mix, self.band_mix = odd(n), odd(ROWS), odd(BANDS)
        self.cache: dict[bytes, int] = {}

    def words(self, text: bytes) -> list[bytes]:
        return text.translate(LOWER).split()

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > WORD_CACHE:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Distinct shingles as 64-bit hashes."""
        h = self.word_hashes(words)
        width = min(self.n, len(h))
        mixed = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            mixed += h[j : j + len(mixed)] * self.word_mix[j]
        return np.unique(mixed)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.sigma[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
        parts = [self.windows[at[i : i + BLOCK]].min(axis=0) for i in range(0, len(at), BLOCK)]
        return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
        mixed = (rows * self.row_mix).sum(axis=1, dtype=np.uint64) + self.band_mix
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


_SIGNERS: dict[int, Signer] = {}


def _signer(n: int) -> Signer:
    if n not in _SIGNERS:
        _SIGNERS[n] = Signer(n)
    return _SIGNERS[n]


def sign(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """rid, doc_id, text_hash, class, n_shingles and bands of every row; one pass over the texts."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _signer(n)
        for batch in batches:
            classes, sizes, bands = [], [], []
            for value in batch.column("text"):
                words = signer.words(value.as_buffer().to_pybytes()) if value.is_valid else []
                if not words:
                    classes.append(None)
                    sizes.append(0)
                    bands.append(None)
                    continue
                found = signer.shingles(words)
                classes.append(hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest())
                sizes.append(len(found))
                bands.append(signer.band_keys(signer.signature(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("text_hash"), pa.array(classes, pa.string()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["rid", "doc_id", "text_hash", "class", "n_shingles", "bands"],
            )
        _SIGNERS.clear()
        signer = None
        give_back()

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(run, SIGNED.format(id=id_type))


def shingle_set(text: Column, n: int) -> Column:
    """The distinct shingles of a text as 64-bit hashes of their words."""
    return let(
        blank_words(lower_ascii(text)),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < n, F.array(F.xxhash64(w)))
        .otherwise(
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
            )
        ),
    )


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """rid and shingle set of the rows in ``wanted`` (rid, doc_id, text_hash).

    The list of wanted rows is broadcast only after its rows are counted.
    """
    keyed = wanted.select("rid", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    if keyed.count() <= BROADCAST_ROWS:
        keyed = F.broadcast(keyed)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    matched = texts.join(keyed, (F.col("hash") == F.col("w_hash")) & F.col("id").eqNullSafe(F.col("w_id")))
    sets = matched.select("rid", shingle_set(F.col("text"), n).alias("shingles"))
    return sets.dropDuplicates(["rid"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``100 * intersection >= percent * union``."""
    left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return both.select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb")).cast("bigint").alias("t")).filter(
        100 * F.col("i") >= percent * (F.col("t") - F.col("i"))
    ).select("a", "b")


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for links (a, b).

    Every round takes the smallest label among the neighbours, then the label's
    label; the number of rounds follows the logarithm of the longest path.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both)
    labels = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        seen = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        seen = materialize(seen)
        jump = seen.select(F.col("node").alias("j"), F.col("root").alias("jr"))
        labels = seen.join(jump, F.col("root") == F.col("j"), "left").select("node", "old", F.least("root", F.coalesce("jr", "root")).alias("root"))
        labels = materialize(labels)
        if labels.filter(F.col("old") != F.col("root")).isEmpty():
            return labels.select("node", "root")


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows of different components among which are all that may link in a bucket.

    Prefix filter: a link needs an intersection of ``percent / (100 + percent)`` of both
    sizes, and a partner is no smaller than its bucket's smallest row, nor than ``percent``
    of the row itself. With the shingles of all rows in one order, rarest first, two
    rows that link share one among the first ``n - needed + 1`` of each. Rows of the largest
    component that holds a shingle are looked up, never looked from, so the
    rows of a large group don't meet each other.
    """
    span = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).filter(F.col("lo") < F.col("hi"))
    rows = members.join(span.select("bucket", "least"), "bucket").groupBy("rid", "root", "n").agg(F.min("least").alias("least"))
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    rows = materialize(rows.join(sizes, "root"))
    each = sets.join(rows.select("rid"), "rid", "left_semi").select("rid", F.explode("shingles").alias("x"))
    counts = each.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    ordered = each.join(counts, "x").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("xs"))
    partner = F.greatest(F.col("least"), F.expr(f"({percent} * n + 99) div 100"))
    needed = F.floor((percent * (F.col("n") + partner) + 99 + percent) / (100 + percent)).cast("int")
    first = F.slice("xs", F.lit(1), F.greatest(F.col("n").cast("int") - needed + 1, F.lit(0)))
    placed = F.transform(first, lambda e, i: F.struct(e["c"].alias("c"), e["x"].alias("x"), (F.col("n") - i).alias("rest")))
    rare = F.filter(placed, lambda e: e["c"] > 1)
    postings = materialize(
        ordered.join(rows, "rid").select("rid", "n", F.struct("size", "root").alias("part"), F.explode(rare).alias("e")).select("rid", "n", "part", "e.x", "e.rest")
    )
    largest = postings.groupBy("x").agg(F.max("part").alias("top"), F.min("part").alias("low")).filter(F.col("low") < F.col("top")).select("x", "top")
    open_at = postings.join(largest, "x")
    seekers = open_at.filter(F.col("part") < F.col("top")).select("x", F.col("rid").alias("y"), F.col("n").alias("yn"), F.col("part").alias("yp"), F.col("rest").alias("yr"))
    # The first shingle that two rows share leaves both enough places for the rest of the intersection.
    fits = (100 + percent) * F.least("rest", "yr") >= percent * (F.col("n") + F.col("yn"))
    met = open_at.join(seekers, "x").filter(
        (F.col("yp") < F.col("part")) & fits & (100 * F.least("n", "yn") >= percent * F.greatest("n", "yn"))
    )
    return met.select(F.least("rid", "y").alias("a"), F.greatest("rid", "y").alias("b")).distinct()


def merge_roots(roots: DataFrame | None, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components (rid, root) with new links, and what became of the old roots (root, new)."""
    if roots is None:
        found = connected_components(links)
        return found.select(F.col("node").alias("rid"), "root"), found.select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = roots.select(F.col("rid").alias("x"), F.col("root").alias("xr"))
    named = links.join(old, F.col("a") == F.col("x"), "left").select(F.coalesce("xr", "a").alias("a"), "b")
    named = named.join(old, F.col("b") == F.col("x"), "left").select("a", F.coalesce("xr", "b").alias("b"))
    found = connected_components(named)
    rename = found.select(F.col("node").alias("root"), F.col("root").alias("new"))
    moved = roots.join(rename, "root", "left").select("rid", F.coalesce("new", "root").alias("root"))
    fresh = found.join(roots.select("rid"), F.col("node") == F.col("rid"), "left_anti").select(F.col("node").alias("rid"), "root")
    return materialize(moved.unionAll(fresh)), rename


def link_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """rid, root of all rows that link with another; ``members`` is (bucket, rid, n, near),
    with the size of the row's set and how many rows its buckets hold."""
    members = materialize(members)
    # The row with the fullest buckets lies nearest to the middle of its group.
    best = F.max(F.struct("near", F.xxhash64("rid").alias("h"), "rid", "n")).alias("p")
    candidates = materialize(members.join(members.groupBy("bucket").agg(best), "bucket"))
    # The smaller set can't hold more than the intersection needs.
    sized = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
    pairs = candidates.filter((F.col("rid") != F.col("p.rid")) & sized).select(F.least("rid", "p.rid").alias("a"), F.greatest("rid", "p.rid").alias("b"))
    links = materialize(verify(pairs.distinct(), sets, percent))
    members = candidates.filter(F.col("rid") != F.col("p.rid")).select("bucket", "rid", F.col("rid").alias("root"), "n")
    roots: DataFrame | None = None
    if not links.isEmpty():
        roots, rename = merge_roots(roots, links)
        members = members.join(rename, "root", "left").select("bucket", "rid", F.coalesce("new", "root").alias("root"), "n")
    links = materialize(verify(prefix_pairs(materialize(members), sets, percent), sets, percent))
    return roots if links.isEmpty() else merge_roots(roots, links)[0]


def classes_and_roots(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and class, root, min_id of the classes of rows with words."""
    rows = materialize(sign(docs, id_col, text_col, shingle_words))
    classes = rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("min_id"))
    reps = rows.join(classes.select("rid"), "rid")
    reps = materialize(reps)
    buckets = reps.select("rid", F.explode("bands").alias("bucket"), F.col("n_shingles").alias("n"))
    shared = materialize(buckets.groupBy("bucket").agg((F.count(F.lit(1)) - 1).alias("others")).filter(F.col("others") > 0))
    held = materialize(buckets.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "bucket"))
    near = held.groupBy("rid").agg(F.sum("others").alias("near"))
    members = held.select("bucket", "rid", "n").join(near, "rid")
    wanted = materialize(reps.join(near, "rid", "left_semi").select("rid", "doc_id", "text_hash"))
    roots = None
    if not wanted.isEmpty():
        sets = materialize(full_sets(docs, wanted, id_col, text_col, shingle_words))
        roots = link_buckets(members, sets, percent)
    if roots is None:
        return rows, classes.select("class", F.col("rid").alias("root"), "min_id")
    return rows, classes.join(roots, "rid", "left").select("class", F.coalesce("root", "rid").alias("root"), "min_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable
    by links, itself included), kept (whether the id is the component's)."""
    rows, placed = classes_and_roots(docs, id_col, text_col, shingle_words, percent)
    lowest = placed.groupBy("root").agg(F.min("min_id").alias("component_id"))
    named = placed.join(lowest, "root").select("class", "component_id")
    return rows.select("doc_id", "n_shingles", "class").join(named, "class", "left").select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id. Rows without words stay.

    Rows that repeat id and text are told apart by nothing but their place, so
    where a kept row has such repeats, one of them stays.
    """
    rows, placed = classes_and_roots(docs, id_col, text_col, shingle_words, percent)
    named = rows.filter(F.col("class").isNotNull()).select("rid", F.col("doc_id").alias("id"), F.col("text_hash").alias("key"), "class")
    named = materialize(named.join(placed.select("class", "root"), "class").drop("class"))
    keepers = named.groupBy("root").agg(F.min(F.struct("id", "rid")).alias("k")).select(F.col("k.rid").alias("rid"))
    kept = named.join(keepers, "rid", "left_semi").select("id", "key")
    dropped = materialize(named.join(keepers, "rid", "left_anti").select("id", "key").distinct())
    k = kept.select(F.col("id").alias("i"), F.col("key").alias("h"))
    repeats = materialize(dropped.join(k, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("h")), "left_semi"))
    out = keyed_rows(docs, dropped, "left_anti", id_col, text_col)
    if repeats.isEmpty():
        return out
    return out.unionAll(keyed_rows(docs, repeats, "left_semi", id_col, text_col).dropDuplicates([id_col, text_col]))
