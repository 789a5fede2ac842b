"""Quality classifier (operator 6): random-indexing word vectors pooled per document, then a
two-layer numpy network with temperature-calibrated probabilities.

1. A text becomes a stream of tokens: words (lower-cased letters), the signs around
   them, and marks for capitals, repeated words and repeated lines. The ``OWN`` tokens that
   most labelled sample texts hold have a place each (of equals the first by name); all others
   share ``SHARED`` places by a hash.
2. Random indexing: each place has a sparse random index vector of ``DIMENSIONS``; its
   context vector is the sum of the index vectors of its neighbours within ``REACH``
   tokens, over all texts. Partial sums are made per task and added up in two
   levels (by slice of places and salt, then by slice), so no task gets more than
   its share; what reaches the driver is one table of fixed size.
3. A document vector pools the word vectors (context and index) over its tokens
   and over its distinct tokens.
4. The network is trained on the driver on the document vectors of a bounded sample (``PER_LABEL``
   rows of each label), weighted to the labels' shares; every fifth is held back for the
   temperature.

Null and empty texts have a zero vector and are scored like any other. Repeated
rows give repeated results; without labels of both kinds all scores are 0.5; empty
tables give empty results; labels, languages, sources and ids are no inputs.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship_package
from .folds import balanced_ids, sample_features
from .language_id import fit_temperature

OWN, SHARED = 1 << 13, 1 << 10
TOKENS = OWN + SHARED
DIMENSIONS = 32
NONZERO = 4
REACH = 2
PER_LABEL = 1500
HIDDEN = 32
EPOCHS = 120
SLICE = 512
SALTS = 16
PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
WORD_CACHE = 150_000
#: Structural tokens.
UPPER, AGAIN, LINE_AGAIN = "\x01upper", "\x01again", "\x01line"


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(5)
    out = np.zeros((TOKENS, DIMENSIONS), np.float32)
    for row in out:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def word_tokens(word: str) -> list[str]:
    tokens = [p.lower() for p in PARTS.findall(word)]
    if len(word) > 1 and word.upper() == word and word.lower() != word:
        tokens.append(UPPER)
    return tokens


def repetitions(text: str, words: list[str]) -> tuple[int, int]:
    """Words equal to the one before, and words in lines that stood before."""
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    return again, sum((n - 1) * len(x.split()) for x, n in Counter(lines).items() if n > 1)


def packed_tokens(text: str) -> bytes:
    """The distinct tokens of a text."""
    words = text.split()
    tokens = {t for w in set(words) for t in word_tokens(w)}
    again, lines = repetitions(text, words)
    return "\n".join(sorted(tokens | {AGAIN for _ in range(again > 0)} | {LINE_AGAIN for _ in range(lines > 0)})).encode("utf-8", "surrogatepass")


def choose_vocabulary(packed: Iterable[bytes]) -> list[str]:
    """The ``OWN`` tokens that most texts hold; of equals the first by name."""
    held = Counter(t for p in packed if p for t in p.decode("utf-8", "surrogatepass").split("\n"))
    return sorted(heapq.nsmallest(OWN, held, key=lambda t: (-held[t], t)))


class Tokenizer:
    def __init__(self, vocabulary: Sequence[str] = ()):
        self.own = {token: i for i, token in enumerate(vocabulary)}
        self.known: dict[str, bytes] = {}

    def _place(self, token: str) -> int:
        at = self.own.get(token)
        return OWN + xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) % SHARED if at is None else at

    def _of_word(self, word: str) -> bytes:
        return np.array([self._place(t) for t in word_tokens(word)], np.int32).tobytes()

    def places(self, text: str) -> np.ndarray:
        """The token places of a text, in order; marks of repetition come last."""
        words = text.split()
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._of_word(w)
        marks = np.repeat(np.array([self._place(AGAIN), self._place(LINE_AGAIN)], np.int32), repetitions(text, words))
        return np.concatenate([np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32), marks])


def add_contexts(total: np.ndarray, places: np.ndarray, index: np.ndarray) -> None:
    """Adds to each place's row the index vectors of its neighbours."""
    if len(places) < 2:
        return
    vectors = index[places]
    sums = np.zeros_like(vectors)
    for d in range(1, min(REACH, len(places) - 1) + 1):
        sums[d:] += vectors[:-d]
        sums[:-d] += vectors[d:]
    order = np.argsort(places, kind="stable")
    starts = np.flatnonzero(np.diff(places[order], prepend=-1))
    total[places[order][starts]] += np.add.reduceat(sums[order], starts, axis=0)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(slice, sums) of a stream of (slice, sums)."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            row = np.frombuffer(value.as_py(), np.float64)
            totals[part] = totals[part] + row if part in totals else row
    return ((k, v.tobytes()) for k, v in sorted(totals.items()))


def context_vectors(docs: DataFrame, text_col: str = "text", vocabulary: Sequence[str] = ()) -> np.ndarray:
    """The context vectors of all places (``TOKENS`` x ``DIMENSIONS``), over all texts, at unit length."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tokens, total = index_vectors(), Tokenizer(vocabulary), np.zeros((TOKENS, DIMENSIONS), np.float64)
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    add_contexts(total, tokens.places(x.as_py()), index)
        parts = range(0, TOKENS, SLICE)
        yield pa.RecordBatch.from_pydict({"part": [p // SLICE for p in parts], "sums": [total[p : p + SLICE].tobytes() for p in parts]}, schema=schema)
        del tokens, total
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(_summed(batches))
        yield pa.RecordBatch.from_pydict({"part": [k for k, _ in rows], "sums": [v for _, v in rows]}, schema=schema)

    slices = TOKENS // SLICE
    first = docs.select(text_col).mapInArrow(partial, "part int, sums binary")
    salted = first.withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(SALTS)))
    second = salted.repartition(slices, "part", "salt").select("part", "sums").mapInArrow(add, "part int, sums binary")
    third = second.repartition(slices, "part").mapInArrow(add, "part int, sums binary")
    out = np.zeros((TOKENS, DIMENSIONS), np.float64)
    for r in third.collect():  # one row of SLICE * DIMENSIONS numbers per slice
        out[r.part * SLICE : (r.part + 1) * SLICE] += np.frombuffer(r.sums, np.float64).reshape(-1, DIMENSIONS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class QualityModel:
    vocabulary: list[str]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None
    temperature: float = 1.0

    def pooled(self, text: str | None, tokens: Tokenizer) -> np.ndarray:
        """Means of the word vectors over the tokens and over the distinct ones, and the log of their number."""
        places = tokens.places(text or "")
        if not len(places):
            return np.zeros(2 * self.vectors.shape[1] + 1)
        counts = np.bincount(places)
        at = np.flatnonzero(counts)
        vectors = self.vectors[at]
        return np.concatenate([counts[at] @ vectors / len(places), vectors.mean(axis=0), [np.log1p(len(places))]])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.spread @ w1 + b1, 0) @ w2 + b2

    def scores(self, texts: list[str | None], tokens: Tokenizer) -> np.ndarray:
        if self.layers is None or not texts:
            return np.full(len(texts), 0.5)
        z = self.logits(np.array([self.pooled(t, tokens) for t in texts])) / self.temperature
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Context and index vectors side by side."""
    return np.concatenate([contexts, index_vectors() / NONZERO**0.5], axis=1)


def train(model: QualityModel, x: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> None:
    """Trains the network of ``model`` on document vectors; without labels of both kinds it gets none."""
    if not len(y) or y.min() == y.max():
        return
    wide = x.shape[1]
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    weights = np.where(y == 1, shares[1] / max((y == 1).sum(), 1), shares[0] / max((y == 0).sum(), 1)) * len(y)
    rng = np.random.default_rng(3)
    order = rng.permutation(len(y))
    held, fitted = order[::5], np.setdiff1d(order, order[::5])
    params = [rng.normal(0, (2 / wide) ** 0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, 2)), np.zeros(2)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    scaled = (x - model.mean) / model.spread
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fitted), max(1, len(fitted) // 128)):
            step += 1
            a, t, w = scaled[rows], y[rows], weights[rows]
            h = np.maximum(a @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), t] -= 1
            d = p * w[:, None] / len(rows)
            back = (d @ params[2].T) * (h > 0)
            grads = [a.T @ back + 2e-4 * params[0], back.sum(axis=0), h.T @ d + 2e-4 * params[2], d.sum(axis=0)]
            for q, g, m in zip(params, grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                q -= 0.003 * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(params)
    if len(held):
        model.temperature = fit_temperature(model.logits(x[held]), y[held])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> QualityModel:
    """Word vectors of all of ``docs``, and the network of the rows of ``labels`` (id, label)."""
    named = labels.filter(F.col(label).isin(0, 1))
    counts = {int(r[0]): r[1] for r in named.groupBy(label).count().collect()}
    total = sum(counts.values()) or 1
    ids = balanced_ids(named, label, per_label, id_col)
    vocabulary = choose_vocabulary(row[1] for row in sample_features(docs, ids, packed_tokens, id_col, text_col))
    vectors = word_vectors(context_vectors(docs, text_col, vocabulary))
    wide = 2 * vectors.shape[1] + 1
    model = QualityModel(vocabulary, vectors, np.zeros(wide), np.ones(wide), None)
    tokens: list[Tokenizer] = []

    def pooled(text: str) -> bytes:
        if not tokens:
            tokens.append(Tokenizer(vocabulary))
        return model.pooled(text, tokens[0]).tobytes()

    sample = sample_features(docs, ids, pooled, id_col, text_col)
    x = np.array([np.frombuffer(row[1]) for row in sample]).reshape(-1, wide)
    train(model, x, np.array([int(row[2]) for row in sample], np.int64), (counts.get(0, 0) / total, counts.get(1, 0) / total))
    return model


def score_texts(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""

    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer(model.vocabulary)
        for batch in batches:
            scores = model.scores([x.as_py() for x in batch.column(1)], tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
