"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is the logistic of the summed weights of its distinct hashed
words and within-word character 5-grams; a document's is the noisy-or of its
sentences', ``1 - prod(1 - s)``. In a text longer than most labelled ones the
sentences that do not offend weigh less, as if there were only so many, so that
plain text adds nothing with length; an offending one counts in full at any
length. Only document labels are learnt from, and the
sentence scores then locate the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import SENTENCE_END, WORD, hashed, segments
from ._labels import SAMPLE_ROWS, held_out, labelled_sample
from ._memory import lean, release
from ._text import taken

BITS, ORDERS = 20, (5,)
EPOCHS, RATE, DECAY, START_BIAS = 20, 0.5, 1e-5, -5.0
#: A feature is learnt if more toxic documents of the sample have it than expected, with so large a log-likelihood ratio.
LEAST_EVIDENCE = 10.0
#: How much a toxic document counts.
WEIGHT = 3.0
THRESHOLD = 0.5
#: A sentence is named as offending from this score on.
SENTENCE_THRESHOLD = 0.5
#: This share of the labelled texts has no more sentences than the usual length.
USUAL = 0.9


def _sentences(blob: bytes, starts: np.ndarray) -> np.ndarray:
    """The start of each sentence; a document's start is one too."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    after = np.flatnonzero(SENTENCE_END[raw[:-1]]) + 1
    return np.union1d(after, starts)


def _instances(texts: Sequence[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, sentence starts, document of each sentence, sentence and feature of each distinct pair)."""
    for blob, docs, starts in segments(texts, True, SENTENCE_END):
        first = _sentences(blob, starts)
        owner = docs[np.searchsorted(starts, first, side="right") - 1]
        pairs = np.concatenate([((np.searchsorted(first, at, side="right") - 1).astype(np.int64) << BITS) | f for at, f in hashed(blob, ~WORD, ORDERS, BITS)])
        pairs.sort()
        if len(pairs):
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        yield blob, first, owner, pairs >> BITS, pairs & ((1 << BITS) - 1)


def _weighed(z: np.ndarray, n: np.ndarray | int, usual: float) -> np.ndarray:
    """What a sentence of logit z counts in a text of n sentences: usual / n if it does not offend and the text is longer than usual."""
    return np.where(z < np.log(SENTENCE_THRESHOLD / (1 - SENTENCE_THRESHOLD)), np.minimum(1, usual / np.maximum(n, 1)), 1.0)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    #: Sentences of a text of usual length.
    usual: float = 1.0

    def _sentence_logits(self, sentence: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(sentence, self.weights[feature], n) + self.bias

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """The noisy-or of each whole text; a text without words has none and scores 0."""
        plain, offends, n = (np.zeros(len(texts)) for _ in range(3))
        for _, first, owner, sentence, feature in _instances(texts):
            z = self._sentence_logits(sentence, feature, len(first))
            worded = np.bincount(sentence, minlength=len(first)) > 0
            z, owner = z[worded], owner[worded]
            weak = _weighed(z, 2, 1.0) < 1
            loss = -np.logaddexp(0, z)
            plain += np.bincount(owner[weak], loss[weak], len(texts))
            offends += np.bincount(owner[~weak], loss[~weak], len(texts))
            n += np.bincount(owner, minlength=len(texts))
        return -np.expm1(offends + plain * np.minimum(1, self.usual / np.maximum(n, 1)))

    def offending(self, text: str | None, threshold: float = SENTENCE_THRESHOLD) -> list[tuple[str, float]]:
        """The sentences (lower case) that score ``threshold`` or more, in order."""
        out = []
        for blob, first, _, sentence, feature in _instances([text]):
            z = self._sentence_logits(sentence, feature, len(first))
            worded = np.bincount(sentence, minlength=len(first)) > 0
            p = 1 / (1 + np.exp(-z))
            ends = np.append(first[1:], len(blob))
            out += [(blob[first[k] : ends[k]].decode("utf-8", "replace").strip(), float(p[k])) for k in np.flatnonzero(worded & (p >= threshold))]
        return out


def train(texts: Sequence[str], labels: Sequence[int], seed: int = 7) -> ToxicityModel:
    """Weights by stochastic gradient descent (Adagrad steps) on the noisy-or's log loss, one document a step.

    The gradient at a sentence's logit is s for a clean document and
    -s (1-P)/P for a toxic one. No labels or one class: all weights stay 0 and
    the bias is that of the smoothed share.
    """
    y = np.asarray(labels, dtype=np.int64)
    size = 1 << BITS
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel(np.zeros(size, dtype=np.float32), float(np.log(share / (1 - share))))
    seen_docs = np.zeros((2, size), dtype=np.int64)
    for text, label in zip(texts, y, strict=True):
        seen_docs[label, np.unique(np.concatenate([f for *_, f in _instances([text])]))] += 1
    both = seen_docs.sum(axis=0)
    expected = both * (np.bincount(y, minlength=2) / len(y))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * np.where(seen_docs > 0, seen_docs * np.log(seen_docs / expected), 0).sum(axis=0)
    telling = (evidence >= LEAST_EVIDENCE) & (seen_docs[1] > expected[1])
    bags: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for text in texts:
        base, sentences, features = 0, [], []
        for _, first, _, sentence, feature in _instances([text]):
            kept, at = np.unique(sentence, return_inverse=True)
            known = telling[feature]
            sentences.append((at[known] + base).astype(np.int32))
            features.append(feature[known])
            base += len(kept)
        ids, at = np.unique(np.concatenate(features), return_inverse=True)
        bags.append((base, np.concatenate(sentences), ids, at.astype(np.int32)))
    usual = max(1.0, float(np.quantile([n for n, *_ in bags], USUAL)))
    weights = np.zeros(size, dtype=np.float64)
    seen = np.full(size, 1e-6)
    bias, seen_bias = START_BIAS, 1.0
    rng = np.random.default_rng(seed)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            n, sentence, ids, at = bags[i]
            rate = RATE * (1 - 0.9 * done / steps)
            done += 1
            if not n:
                continue
            z = np.clip(np.bincount(sentence, weights[ids][at], n) + bias, -30, 30)
            p = 1 / (1 + np.exp(-z))
            share = _weighed(z, n, usual)
            whole = -np.expm1(-(share * np.logaddexp(0, z)).sum())
            p *= share
            g = p if not y[i] else -WEIGHT * p * (1 - whole) / max(whole, 1e-9)
            step = np.bincount(at, g[sentence], len(ids)) + DECAY * weights[ids]
            seen[ids] += step * step
            weights[ids] -= rate * step / np.sqrt(seen[ids])
            seen_bias += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / np.sqrt(seen_bias)
    return ToxicityModel(weights.astype(np.float32), bias, usual)


def _learnt(docs: DataFrame, labels: DataFrame, rows: int) -> ToxicityModel:
    model = train(*labelled_sample(docs, labels, "toxic", rows))
    release()
    return model


def _score_frame(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            p = np.clip(model.scores(texts), 0, 1)
            toxic = p >= THRESHOLD
            found = [[s for s, _ in model.offending(text)] if bad else [] for text, bad in zip(texts, toxic, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(x) for x in ids], pa.bool_()), pa.array(p, pa.float64()), pa.array(toxic.astype(np.int32)), pa.array(found, pa.list_(pa.string()))], ["doc_id", "held_out", "score", "predicted", "sentences"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(score), "doc_id bigint, held_out boolean, score double, predicted int, sentences array<string>")


def score_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int, sentences array<string>), a row for each row of ``docs``.

    ``sentences`` are the offending ones of a text that is predicted toxic.
    Learns from up to ``rows`` labelled documents of any length that are not held out; the
    score is a function of the whole text alone. Null and empty texts score 0.
    A null doc_id is not held out. Repeated rows come back repeated; an empty
    table gives no rows. Other columns are not read.
    """
    return _score_frame(docs, _learnt(docs, labels, rows))


def offending_sentences(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, threshold: float = SENTENCE_THRESHOLD) -> DataFrame:
    """(doc_id, sentence, score) for each sentence that scores ``threshold`` or more; null cases as in ``score_toxicity``."""
    model = _learnt(docs, labels, rows)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches, 1):
            found = [(i, *x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in model.offending(text, threshold)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in found], pa.int64()), "sentence": pa.array([x[1] for x in found], pa.string()), "score": pa.array([x[2] for x in found], pa.float64())})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(locate), "doc_id bigint, sentence string, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under the threshold; null texts stay."""
    model = _learnt(docs, labels, rows)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches, at):
            p = model.scores(batch.column(at).to_pylist())
            yield batch.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(lean(keep), docs.schema)
