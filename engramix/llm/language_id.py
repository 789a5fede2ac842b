"""Language ID (operator 5): sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties, then temperature calibration.

Texts are lower-cased; every character but letters counts as one blank (runs of
blanks as one). N-grams of 1 to 3 characters are hashed into ``FEATURES``
places; the whole text is counted, in blocks that hand on their last two characters. The
model is fitted on the driver on a sample: the counts (never the texts) of ``PER_LABEL`` texts
of each language at most, of all languages (it grows with their number); every fifth
text is held back for the temperature.

Null texts and texts without a letter are ``und`` with score 0. Repeated rows
give repeated results; without labelled rows every text is ``und``; empty tables
give empty results; other columns are not read. Of equally likely languages the
first by name is given. Added columns whose names are taken get underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, give_back, ship_package
from .folds import balanced_ids, sample_features

FEATURES = 1 << 14
PER_LABEL = 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
#: Characters counted at once.
BLOCK = 1 << 20
UNDETERMINED = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _is_letter(code: int) -> bool:
    return chr(code).isalpha()


_LETTERS = np.array([_is_letter(c) for c in range(0x3000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one blank (32) for each run of other characters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.where(codes < len(_LETTERS), _LETTERS[np.minimum(codes, len(_LETTERS) - 1)], True)
    high = np.flatnonzero(codes >= len(_LETTERS))
    if len(high):
        known[high] = [_is_letter(int(c)) for c in codes[high]]
    codes = np.where(known, codes, np.uint32(32))
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[:1] = True
    return codes[keep]


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts by feature; None for texts without a letter.

    Blocks are lower-cased one by one; a block begins with the last two characters of the one before, whose own n-grams
    are not counted again, so the counts are those of the whole text."""
    total = np.zeros(FEATURES, np.int64)
    held = np.array([32], np.uint32)
    seen = False
    for i in range(0, len(text), BLOCK):
        codes = letters(text[i : i + BLOCK])
        if len(codes) and codes[0] == 32 and held[-1] == 32:
            codes = codes[1:]
        if not len(codes):
            continue
        seen = seen or bool((codes != 32).any())
        _add_ngrams(total, held, codes)
        held = np.concatenate([held, codes])[-2:]
    if not seen:
        return None
    if held[-1] != 32:
        _add_ngrams(total, held, np.array([32], np.uint32))
    total[_place_of_blank()] += 1  # the one in front
    return total


def _place_of_blank() -> int:
    return int((np.array([32], np.uint32) * _MIX[0])[0] >> np.uint32(18))


def _add_ngrams(total: np.ndarray, before: np.ndarray, codes: np.ndarray) -> None:
    """Adds the n-grams that end in ``codes``; up to two characters of ``before`` stand in front."""
    k = len(before)
    codes = np.concatenate([before, codes]).astype(np.uint32)
    one = codes * _MIX[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MIX[1] + codes[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MIX[2] + codes[2:]
    hashed = np.concatenate([one[k:], two[k - 1 :] * _MIX[0], three[max(k - 2, 0) :] * _MIX[0]])
    total += np.bincount(hashed >> np.uint32(18), minlength=FEATURES)


def nonzero(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return at, counts[at]


def packed_counts(text: str) -> bytes:
    """The places and counts of a text; nothing for texts without a letter."""
    counts = ngram_counts(text)
    return b"" if counts is None else np.concatenate(nonzero(counts)).astype(np.int64).tobytes()


def unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.log1p(counts) * self.idf[at]
        return at, x / (np.linalg.norm(x) or 1.0)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at, x = self.vector(at, counts)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if text and self.languages else None
        if counts is None:
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(*nonzero(counts)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm."""
    if not len(classes):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(classes)), classes], 1e-12)).mean())

    lo, hi, ratio = np.log(0.2), np.log(5.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(sample: list[tuple[bytes, str]]) -> LanguageModel:
    """FTRL-proximal over the sample's packed counts, in a fixed shuffled order."""
    languages = sorted({label for _, label in sample})
    place = {label: i for i, label in enumerate(languages)}
    rows = [(unpacked(packed), place[label]) for packed, label in sample if packed]
    n = len(languages)
    df = np.bincount(np.concatenate([np.empty(0, np.int64), *(at for (at, _), _ in rows)]), minlength=FEATURES)
    model = LanguageModel(languages, np.log((1 + len(rows)) / (1 + df)) + 1, np.zeros((FEATURES, n)), np.zeros(n), 1.0)
    order = np.random.default_rng(11).permutation(len(rows))
    held, fitted = order[::5], np.setdiff1d(order, order[::5])
    z, squares = np.zeros((FEATURES + 1, n)), np.zeros((FEATURES + 1, n))

    def weights(at: np.ndarray) -> np.ndarray:
        small = np.abs(z[at]) <= L1
        return np.where(small, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(squares[at])) / ALPHA + L2))

    vectors = {i: model.vector(*rows[i][0]) for i in fitted}
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(fitted):
            at, x = vectors[i]
            at, x = np.append(at, FEATURES), np.append(x, 0.1)
            w = weights(at)
            error = _softmax(x @ w)
            error[rows[i][1]] -= 1
            g = np.outer(x, error)
            sigma = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / ALPHA
            z[at] += g - sigma * w
            squares[at] += g * g
    full = weights(np.arange(FEATURES + 1))
    model.weights, model.bias = full[:-1], 0.1 * full[-1]
    if len(held):
        model.temperature = fit_temperature(np.array([model.logits(*rows[i][0]) for i in held]), np.array([rows[i][1] for i in held]))
    return model


def fit(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> LanguageModel:
    """The model of the rows' languages, from at most ``per_label`` rows of each."""
    named = labelled.filter(F.col(lang_col).isNotNull())
    ids = balanced_ids(named, lang_col, per_label, id_col)
    model = train([row[1:] for row in sample_features(labelled, ids, packed_counts, id_col, text_col)])
    give_back()
    return model


def identify(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score"
) -> DataFrame:
    """``docs`` with ``pred_col`` and ``score_col`` appended (with underscores in front where these names are taken)."""
    ship_package(docs.sparkSession)
    pred_col, score_col = appended(docs.columns, [pred_col, score_col])
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(value.as_py()) for value in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*batch.schema.names, pred_col, score_col],
            )
        give_back()

    return docs.mapInArrow(run, ", ".join([*columns, f"`{pred_col}` string", f"`{score_col}` double"]))
