"""Quality classifier: supervised subword embeddings.

Hashed word and character n-gram vectors are learnt with numpy stochastic
gradient descent, averaged per document and read by a softmax layer. Case and
punctuation stay in the text: words are runs without white space. Word n-grams
are words and pairs of them; pairs of one word share a feature besides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._features import SPACE, hashed, segments
from ._labels import SAMPLE_ROWS, held_out, labelled_sample
from ._memory import lean, release
from ._text import taken

BITS, DIM, ORDERS = 18, 16, (3, 4)
EPOCHS, RATE = 4, 0.15
THRESHOLD = 0.3
#: The feature of a word that repeats the one before.
REPEAT = 1


@dataclass
class QualityModel:
    """``direction``: each feature's vector times the difference of the output rows; ``bias``: that of their biases."""

    direction: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """The probability of label 1 for each whole text; a text without words has the bias's."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for blob, docs, starts in segments(texts, False, SPACE):
            for at, feature in _features(blob, starts):
                own = np.searchsorted(starts, at, side="right") - 1
                total += np.bincount(docs[own], self.direction[feature], len(texts))
                count += np.bincount(docs[own], minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def _features(blob: bytes, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    found = hashed(blob, SPACE, ORDERS, BITS)
    at, word = found[0]
    own = np.searchsorted(starts, at, side="right")
    same = own[1:] == own[:-1]
    pair = word[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(31)
    pair *= np.uint64(0xD6E8FEB86659FD93)
    again = at[1:][(word[1:] == word[:-1]) & same]
    return [*found, (at[1:][same], (pair >> np.uint64(64 - BITS)).astype(np.int32)[same]), (again, np.full(len(again), REPEAT, dtype=np.int32))]


def _bags(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct features of each text and their shares."""
    for text in texts:
        found = [f for blob, _, starts in segments([text], False, SPACE) for _, f in _features(blob, starts)]
        ids, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int), np.zeros(0, int))
        yield ids, (counts / max(1, counts.sum())).astype(np.float32)


def train(texts: Sequence[str], labels: Sequence[int], seed: int = 7) -> QualityModel:
    """Vectors, output rows and biases by stochastic gradient descent, one document a step, steps scaled by row (Adagrad).

    No labels: every score is 0.5. One class only: the smoothed share of that class.
    """
    y = np.asarray(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return QualityModel(np.zeros(1 << BITS, dtype=np.float32), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    outputs = rng.uniform(-0.1, 0.1, (2, DIM)).astype(np.float32)
    bias = np.array([0, prior], dtype=np.float32)
    seen_v = np.full(1 << BITS, 1e-12, dtype=np.float32)
    seen_o = np.full((2, DIM), 1e-8, dtype=np.float32)
    bags = list(_bags(texts))
    steps = EPOCHS * len(bags)
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, shares = bags[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            if not len(ids):
                continue
            rows = vectors[ids]
            hidden = shares @ rows
            z = outputs @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ outputs
            g = np.outer(p, hidden)
            seen_o += g * g
            outputs -= rate * g / np.sqrt(seen_o)
            bias -= np.float32(0.05) * rate * p
            square = shares * shares * np.float32((back * back).mean())
            seen_v[ids] += square
            vectors[ids] = rows - (rate * shares / np.sqrt(seen_v[ids]))[:, None] * back
    return QualityModel((vectors @ (outputs[1] - outputs[0])).astype(np.float32), float(bias[1] - bias[0]))


def score_quality(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int), a row for each row of ``docs``.

    Learns from up to ``rows`` labelled documents of any length that are not held out; the
    score is a function of the whole text alone. Null texts are scored as
    empty. A null doc_id is not held out. Repeated rows come back repeated;
    an empty table gives no rows. Other columns are not read.
    """
    model = train(*labelled_sample(docs, labels, "quality", rows))
    release()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches, 1):
            ids = batch.column(0).to_pylist()
            p = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(x) for x in ids], pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(score), "doc_id bigint, held_out boolean, score double, predicted int")
