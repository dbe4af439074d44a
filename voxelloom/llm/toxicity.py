"""Toxicity by multiple-instance learning: documents are bags of sentences, labels are known for bags only.

A sentence has the probability p = sigmoid(weights of its hashed words, plus bias); its
document has 1 - prod(1 - p) over its sentences (noisy-or). Fitting raises the document likelihood of a
bounded sample of labelled rows (`sample` in `train`) from a fold of ids that is not held out, and the
fitted sentence scores then locate the offending sentences.

Sentences end at . ! ? and line feeds; words are runs of ASCII letters and digits, lower-cased, and
non-ASCII characters. Only the text is scored. Null texts count as empty; a text without words has the
score 0. Without both labels in the sample every score is 0. One row per row, repeated and null ids too; an empty table
has none. Only doc_id and text are read for scores, so other columns' names don't matter; a score at the threshold is
predicted toxic. A text is worked on whatever its length, at some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import _text as T
from voxelloom.llm import linear as L

BITS = 18
SAMPLE = 6000
THRESHOLD = 0.3
#: Ids of this remainder are held out of the fit.
FOLDS, HELD_OUT = 4, 2
#: Sample documents that must hold a feature before it gets a weight.
LEAST_DOCS = 3

_NOT_STOP = ~T._table(b".!?\n")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


@dataclass
class Bags:
    """Features of a chunk: slot and sentence of each, sentence bounds in bytes, row of each sentence."""

    slots: np.ndarray
    sentence: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def bags(chunk: T.Chunk) -> Bags:
    starts, ends = T.word_bounds(chunk, T.ALNUM)
    s_starts, s_ends = T.word_bounds(chunk, _NOT_STOP)
    of = np.searchsorted(s_starts, starts, side="right") - 1
    used, of = np.unique(of, return_inverse=True)
    s_starts, s_ends = s_starts[used], s_ends[used]
    slots = T.word_hashes(chunk, starts, ends, lower=True) >> np.uint64(64 - BITS)
    return Bags(slots.astype(np.int32), of, s_starts, s_ends, chunk.row_of(s_starts))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, sentences = [], []
        for chunk in T.chunks(batch["text"], max_rows=1):  # one text at a time; the sample is small
            b = bags(chunk)
            slots.append(b.slots.astype("<i4").tobytes())
            sentences.append(b.sentence.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(slots, pa.binary()), pa.array(sentences, pa.binary())], ["doc_id", "label", "slots", "vals"])


def fit_noisy_or(slots: np.ndarray, sentence: np.ndarray, doc: np.ndarray, labels: np.ndarray, l1: float = 0.4, steps: int = 120, rate: float = 1.0) -> Model:
    """slots and sentence: one for each feature; doc: one for each sentence.

    Proximal steps sized by each weight's own gradients; the absolute penalty leaves weights at 0 that only
    noise would move.
    """
    n, n_sentences = len(labels), len(doc)
    pairs = np.unique(doc[sentence].astype(np.int64) * (1 << BITS) + slots) & ((1 << BITS) - 1)
    used = (np.bincount(pairs, minlength=1 << BITS) >= LEAST_DOCS)[slots]
    del pairs
    sentence = sentence[used]
    ids, slots = np.unique(slots[used], return_inverse=True)
    slots = slots.astype(np.int32)
    w, seen, bias = np.zeros(len(ids)), np.full(len(ids), 1e-12), -5.0
    for _ in range(steps):
        z = np.bincount(sentence, w[slots], n_sentences) + bias
        total = np.clip(np.bincount(doc, np.logaddexp(0, z), n), 1e-6, 500)
        g = np.where(labels == 1, -1 / np.expm1(total), 1.0)[doc] * L.sigmoid(z)
        gradient = np.bincount(slots, g[sentence], len(ids))
        seen += gradient**2
        step = rate / np.sqrt(seen)
        w -= step * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias -= float(np.clip(5 * g.sum() / n, -0.3, 0.3))
    out = np.zeros(1 << BITS, np.float32)
    out[ids] = w
    return Model(out, bias)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled rows that are not held out; None if a class is missing."""
    keep = T.crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT
    rows = L.labelled_sample(docs, labels, column, sample, keep).mapInArrow(_features, "doc_id long, label int, slots binary, vals binary").collect()
    slots, local, at, y, _ = L.joined_arrays(rows)
    if len(set(y.tolist())) < 2:
        return None
    # Sentence numbers count from 0 in each document; make them count over all.
    per_doc = np.zeros(len(y), np.int64)
    np.maximum.at(per_doc, at, local.astype(np.int64) + 1)
    base = np.cumsum(per_doc) - per_doc
    model = fit_noisy_or(slots, (local.astype(np.int64) + base[at]).astype(np.int32), np.repeat(np.arange(len(y), dtype=np.int32), per_doc), y)
    del rows, slots, local, at
    T.release_memory()
    return model


def bag_scores(chunk: T.Chunk, model: Model | None) -> tuple[Bags | None, np.ndarray, np.ndarray]:
    """Sentences of the chunk, the score of each row, and of each sentence."""
    if model is None:
        return None, np.zeros(chunk.rows), np.zeros(0)
    b = bags(chunk)
    z = np.bincount(b.sentence, model.weights[b.slots], len(b.starts)) + model.bias
    score = -np.expm1(-np.bincount(b.rows, np.logaddexp(0, z), chunk.rows))
    return b, np.clip(score, 0.0, 1.0), L.sigmoid(z)


def _spans(chunk: T.Chunk, b: Bags | None, p: np.ndarray, threshold: float) -> list[list[dict]]:
    """Character spans of the sentences at or over the threshold, a list for each row."""
    own: list[list[dict]] = [[] for _ in range(chunk.rows)]
    found = np.flatnonzero(p >= threshold)
    if len(found):
        points = T.code_points(chunk.data)
        for k in found.tolist():
            row = int(b.rows[k])
            first = points[chunk.offsets[row]]
            own[row].append({"start": int(points[b.starts[k]] - first), "end": int(points[b.ends[k]] - first), "score": float(p[k])})
    return own


def _score(model, threshold: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [np.zeros(0)], []
            for chunk in T.chunks(batch["text"]):
                b, score, p = bag_scores(chunk, model.value)
                scores.append(score)
                spans += _spans(chunk, b, p, threshold)
            score = np.concatenate(scores)
            predicted = (score >= threshold).astype(np.int32)
            columns = [batch["doc_id"], batch["held_out"], pa.array(score), pa.array(predicted), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "offending"])

    return T.tidy(task)


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """held_out, score, predicted and the character spans of sentences at or over the threshold.

    The broadcast model has 2**BITS weights whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = T.id_and_text(docs, (T.crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(_score(shared, threshold), _SCHEMA)


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs`, all their columns, without the rows whose text scores at or over the threshold; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = np.concatenate([np.zeros(0), *(bag_scores(chunk, shared.value)[1] for chunk in T.chunks(batch.column(at)))])
            yield batch.filter(pa.array(scores < threshold))

    return T.light_batches(docs).mapInArrow(T.tidy(task), docs.schema)
