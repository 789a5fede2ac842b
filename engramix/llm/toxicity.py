"""Toxicity (operator 4): nearest labelled examples by exact TF-IDF cosine, found with a
block-max inverted index; distance-weighted votes give calibrated scores and evidence.

Terms are words (lower-cased letters) and their beginnings (``PREFIXES`` letters), each once by
its presence, so that a passage counts in a text of any length. The vocabulary holds all terms
of the examples. A term's weight is its IDF, scaled by its evidence: with G the likelihood ratio of the term between the labels,
(G / (G + E)) squared, so that chance finds count little; E is ``EVIDENCE``, or ``EVIDENCE_SHARE``
of the ratio of a perfect term if the sample is too small for that. A weight that all vectors
share, ``GROUND`` of a label-1 example's length, keeps texts with nothing but chance finds
apart from toxic ones: a term that every text holds. ``EVIDENCE``, ``GROUND``, ``PREFIXES`` and ``NEIGHBOURS`` were
chosen by three folds inside the rows that the query learns from; no held-out row was read for that.

The labelled examples are a bounded sample (``PER_LABEL`` rows of each label), whose
distinct words go to the driver, which indexes them whole: at most ``2 * PER_LABEL``
sparse vectors. Postings lie by term and block of ``BLOCK`` examples, with the largest weight of
each such cell; only cells that hold postings exist. The lists of terms that one in ``DENSE`` examples
holds are kept as rows, whose share of a block's bound is then exact. A query visits the ``FIRST``
blocks of the highest bounds, then all others that may hold a nearer example, so the neighbours are exact.

A neighbour votes with 1 / (0.05 + distance), scaled so that both labels weigh as in
the whole labelled table. A logistic curve fitted on leave-one-out votes calibrates
the score. Texts without any known term (null and empty ones too) get the score
of such examples, or 0 if no example is such. Whole texts are read; ties
go to the earlier example. Repeated rows give repeated results; without labels of both kinds all
scores are 0; empty tables give empty results; labels, languages, sources and ids
are no inputs of a score, and other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship_package
from .folds import balanced_ids, sample_features

PER_LABEL = 1500
EVIDENCE = 20.0
EVIDENCE_SHARE = 1 / 16
GROUND = 0.05
PREFIXES = (6, 8)
NEIGHBOURS = 21
BLOCK = 256
FIRST = 1
DENSE = 8
WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def text_terms(words: set[str]) -> list[str]:
    """The distinct terms of distinct words: the words themselves, marked by their end, and their beginnings."""
    terms = [f"{w}$" for w in words]
    for n in PREFIXES:
        terms.extend({w[:n] for w in words if len(w) > n})
    return terms


def packed_words(text: str) -> bytes:
    return "\n".join(sorted(distinct_words(text))).encode("utf-8", "surrogatepass")


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + lengths[i] - 1``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class BlockMaxIndex:
    """Unit vectors of examples, searched exactly by inner product."""

    def __init__(self, vectors: np.ndarray):
        at, terms = np.nonzero(vectors)
        self._build(at, terms, vectors[at, terms], *vectors.shape)

    @classmethod
    def of(cls, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, size: int) -> BlockMaxIndex:
        """``weights`` of ``terms`` (below ``size``) in the examples ``at`` (below ``n``)."""
        index = cls.__new__(cls)
        index._build(at, terms, weights, n, size)
        return index

    def _build(self, at, terms, weights, n, size):
        order = np.lexsort((at, terms))
        self._fill(n, np.bincount(terms, minlength=size), at[order].astype(np.int32), weights[order].astype(np.float32))

    def _fill(self, n, lengths, at, weights):
        self.n, self.blocks, self.lengths, self.at, self.weights = n, -(-n // BLOCK), lengths.astype(np.int32), at, weights
        term = np.repeat(np.arange(len(lengths)), lengths)
        # Frequent terms are rows over all examples; the others' postings in a block lie together in a cell.
        frequent = self.lengths * DENSE >= n
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.rows = np.zeros((int(frequent.sum()), self.blocks * BLOCK), np.float32)
        dense = frequent[term]
        self.rows[self.row[term[dense]], at[dense]] = weights[dense]
        places = np.flatnonzero(~dense)
        term, block = term[places], at[places] // BLOCK
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.cell_block = block[first].astype(np.int32)
        self.cell_start = places[first].astype(np.int32)
        self.cell_length = np.diff(np.append(first, len(places))).astype(np.int32)
        self.cell_max = np.maximum.reduceat(weights[places], first) if len(first) else np.empty(0, np.float32)
        self.term_cells = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(np.bincount(term[first], minlength=len(lengths)), out=self.term_cells[1:])

    def __getstate__(self):
        """The postings only; the cells are found again by the worker."""
        return self.n, self.lengths, self.at.astype(np.uint16 if self.n < 1 << 16 else np.int32), self.weights

    def __setstate__(self, state):
        n, lengths, at, weights = state
        self._fill(n, lengths, at.astype(np.int32), weights)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples (positions, cosines) with a cosine above 0; ties to the earlier."""
        row = self.row[terms]
        held = np.zeros(len(self.rows), np.float32)
        held[row[row >= 0]] = weights[row >= 0]
        base = held @ self.rows
        terms, weights = terms[row < 0], weights[row < 0]
        counts = self.term_cells[terms + 1] - self.term_cells[terms]
        cells = spread(self.term_cells[terms], counts)
        block, share = self.cell_block[cells], np.repeat(weights, counts)
        bounds = base.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, share * self.cell_max[cells], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        at, cos = np.empty(0, np.int64), np.empty(0, np.float32)
        for visit in (order[:FIRST], order[FIRST:]):
            visit = visit[bounds[visit] > 1e-6]
            if len(cos) == k:
                visit = visit[bounds[visit] >= cos[-1] - 1e-6]
            if not len(visit):
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[visit] = True
            here = wanted[block]
            mine, lengths = cells[here], self.cell_length[cells[here]]
            places = spread(self.cell_start[mine], lengths)
            scores = base + np.bincount(self.at[places], np.repeat(share[here], lengths) * self.weights[places], len(base)).astype(np.float32)
            scores.reshape(-1, BLOCK)[~wanted] = 0
            if skip >= 0:
                scores[skip] = 0
            found = np.flatnonzero(scores > 1e-6)
            if len(found) > k:
                found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
            at, cos = np.append(at, found), np.append(cos, scores[found])
            top = np.lexsort((at, -cos))[:k]
            at, cos = at[top], cos[top]
        return at, cos


@dataclass
class ToxicityModel:
    names: dict[str, int]
    idf: np.ndarray  # the last is the ground's weight
    index: BlockMaxIndex | None
    labels: np.ndarray
    ids: list
    vote_scale: tuple[float, float]
    curve: tuple[float, float] = (1.0, 0.0)
    blank_score: float = 0.0

    def vector(self, words: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of distinct words; the last is the ground, which texts without known terms lack."""
        at = [i for i in map(self.names.get, text_terms(words)) if i is not None]
        if at:
            at.append(len(self.idf) - 1)
        at = np.array(at, np.int64)
        w = self.idf[at]
        return at, (w / (np.linalg.norm(w) or 1.0)).astype(np.float32)

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        y = self.labels[at]
        w = np.where(y == 1, self.vote_scale[1], self.vote_scale[0]) / (1.05 - np.minimum(cos, 1.0))
        return float((w * y).sum() / w.sum())

    def score(self, text: str | None) -> tuple[float, list[tuple[object, float, int]]]:
        """Score, and as evidence the nearest examples (id, cosine, label)."""
        if self.index is None:
            return 0.0, []
        terms, weights = self.vector(distinct_words(text or ""))
        if not len(terms):
            return self.blank_score, []
        at, cos = self.index.search(terms, weights, NEIGHBOURS)
        if not len(at):
            return self.blank_score, []
        return self.calibrated(self.vote(at, cos)), [(self.ids[i], float(c), int(self.labels[i])) for i, c in zip(at[:3], cos[:3])]

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-4), 1 - 1e-4)
        z = self.curve[0] * math.log(v / (1 - v)) + self.curve[1]
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def likelihood_ratio(a: np.ndarray, b: np.ndarray, p: int, n: int) -> np.ndarray:
    """2 log of the likelihood ratio of terms in a of p and b of n texts."""

    def h(x, of):
        return x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, of, 1))

    t, total = a + b, p + n
    return 2 * (h(a, t) + h(b, t) + h(p - a, total - t) + h(n - b, total - t) - h(np.int64(p), total) - h(np.int64(n), total))


def train(sample: list[tuple[bytes, int]], shares: tuple[float, float], ids: list | None = None) -> ToxicityModel:
    """``sample``: the packed words and label of each example; ``shares``: of labels 0 and 1 among all labelled rows."""
    labels = np.array([int(y) for _, y in sample], np.int64)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return ToxicityModel({}, np.zeros(1), None, labels, [], (1.0, 1.0))
    names: dict[str, int] = {}
    found = []
    for packed, _ in sample:
        words = set(packed.decode("utf-8", "surrogatepass").split("\n")) if packed else set()
        found.append(np.array([names.setdefault(t, len(names)) for t in sorted(text_terms(words))], np.int64))
    size = len(names)
    empty = np.empty(0, np.int64)
    seen = [np.bincount(np.concatenate([empty, *(at for at, y in zip(found, labels) if y == label)]), minlength=size) for label in (0, 1)]
    scale = (shares[0] / n0, shares[1] / n1)
    share = seen[1] * scale[1] + seen[0] * scale[0]
    ratio = likelihood_ratio(seen[1], seen[0], n1, n0)
    perfect = float(likelihood_ratio(np.array([n1]), np.array([0]), n1, n0)[0])
    idf = np.append(np.log(1 / np.clip(share, 1e-4, 1)) * (ratio / (ratio + min(EVIDENCE, EVIDENCE_SHARE * perfect))) ** 2, 0.0)
    if norms := [n for at, y in zip(found, labels) if y == 1 and (n := np.linalg.norm(idf[at]))]:
        idf[-1] = GROUND * np.median(norms)
    vectors = []
    for at in found:
        at = np.append(at, size) if len(at) else at
        w = idf[at]
        vectors.append((at, (w / (np.linalg.norm(w) or 1.0)).astype(np.float32)))
    index = BlockMaxIndex.of(
        np.repeat(np.arange(len(sample)), [len(at) for at, _ in vectors]), np.concatenate([at for at, _ in vectors]), np.concatenate([w for _, w in vectors]), len(sample), size + 1
    )
    model = ToxicityModel(names, idf, index, labels, ids or list(range(len(sample))), scale)
    weights = np.where(labels == 1, scale[1], scale[0])
    votes = np.full(len(sample), np.nan)
    for i, (at, w) in enumerate(vectors):
        if len(at):
            near, cos = index.search(at, w, NEIGHBOURS, skip=i)
            if len(near):
                votes[i] = model.vote(near, cos)
    blank = np.isnan(votes)
    if blank.any():
        model.blank_score = float((weights * labels)[blank].sum() / weights[blank].sum())
    if (~blank).any():
        model.curve = fit_curve(votes[~blank], labels[~blank], weights[~blank])
    return model


def fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' log odds: Newton's method with
    halved steps, and a weak prior around (1, 0)."""
    v = np.clip(votes, 1e-4, 1 - 1e-4)
    x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], axis=1)
    w = weights / weights.sum() * len(v)
    b, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(c: np.ndarray) -> float:
        z = np.where(labels == 1, 1, -1) * (x @ c)
        return float((w * np.logaddexp(0, -z)).sum() + ((c - prior) ** 2).sum() / 2)

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (p - labels)) + (b - prior)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(hess, grad)
        while loss(b - step) > loss(b) and np.abs(step).max() > 1e-9:
            step /= 2
        b = b - step
    return float(max(b[0], 0.1)), float(b[1])


def clustered(sample: list[tuple[object, bytes, int]]) -> list[tuple[object, bytes, int]]:
    """The examples in an order that puts those of a label, and of these those that share their most
    frequent words, side by side: blocks then differ in their bounds."""
    held = [set(packed.split(b"\n")) for _, packed, _ in sample]
    counts = Counter(w for words in held for w in words)
    top = heapq.nsmallest(64, counts, key=lambda w: (-counts[w], w))
    order = sorted(range(len(sample)), key=lambda i: (-int(sample[i][2]), [w not in held[i] for w in top]))
    return [sample[i] for i in order]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> ToxicityModel:
    """The model of the rows of ``labels`` (id, label), whose texts are in ``docs``."""
    named = labels.filter(F.col(label).isin(0, 1))
    counts = {int(r[0]): r[1] for r in named.groupBy(label).count().collect()}
    total = sum(counts.values()) or 1
    sample = sample_features(docs, balanced_ids(named, label, per_label, id_col), packed_words, id_col, text_col)
    sample = clustered(sample)
    shares = counts.get(0, 0) / total, counts.get(1, 0) / total
    model = train([row[1:] for row in sample], shares, [row[0] for row in sample])
    give_back()
    return model


def score_texts(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and evidence (the three nearest examples) of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(x.as_py()) for x in batch.column(1)]
            evidence = [[{"example": i, "cosine": c, "label": y} for i, c, y in e] for _, e in found]
            kind = pa.struct([("example", batch.schema.field(0).type), ("cosine", pa.float64()), ("label", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, pa.list_(kind))],
                [id_col, "score", "evidence"],
            )
        give_back()

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {key}, score double, evidence array<struct<example:{key},cosine:double,label:int>>"
    )
