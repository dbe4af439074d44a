"""Quality rules: counted base rules and a calibrated n-gram classifier.

Words are runs of characters other than ASCII white space. `n_repeat_words` counts words in a 3-word
window found twice or more in its text; `n_dup_lines` counts lines with a word that equal an earlier
line. Windows and lines are compared by 64-bit hashes.

The classifier is a logistic regression over shares of hashed words, word pairs and runs of 4 characters, fitted on
a bounded sample of labelled rows (`sample` in `train`), Platt-calibrated on a fold kept out of the fit,
and held against a fixed threshold. Without both labels in the sample every text scores 1.

A null or empty text has no words and so fails the base rules. One row per row, repeated and null ids too; an empty table
has none. Only doc_id and text are read, so other columns' names don't matter; ties at the threshold are kept. A text is
worked on whatever its length, at some 60 bytes a word and 10 a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelloom.llm import _text as T
from voxelloom.llm import linear as L

WORD_BITS, PAIR_BITS, CHAR_BITS, CHAR_WIDTH = 13, 13, 13, 4
SIZE = (1 << WORD_BITS) + (1 << PAIR_BITS) + (1 << CHAR_BITS)
SAMPLE = 4000
#: Calibrated probability of label 1 below which a text is dropped.
THRESHOLD = 0.5
_SYMBOL = T._table(b"#*$%&|<>")
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def _repeats(groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (group, key) occurs more than once, and whether it occurred before."""
    order = np.lexsort((keys, groups))
    g, k = groups[order], keys[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    often, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    often[order] = same[:-1] | same[1:]
    again[order] = same[:-1]  # lexsort is stable, so the first of equals is the earliest
    return often, again


def measure(chunk: T.Chunk, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of the chunk."""
    n, rows = chunk.rows, chunk.row_of(starts)
    count = lambda at, w=None: np.bincount(at, w, n).astype(np.int64)
    points = T.code_points(chunk.data)
    symbols = np.flatnonzero(_SYMBOL[chunk.data])

    hashes, first = T.windows(T.word_hashes(chunk, starts, ends), rows, 3)
    often, _ = _repeats(rows[first], hashes)
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[first[often] + k] = True

    lines = T.Chunk(chunk.data, chunk.offsets, 0)
    line_starts, line_ends = T.word_bounds(lines, chunk_lines)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_rows = chunk.row_of(line_starts)
    _, again = _repeats(line_rows, T.word_hashes(chunk, line_starts, line_ends))
    return {
        "n_words": count(rows),
        "word_chars": count(rows, points[ends] - points[starts]),
        "n_symbols": count(chunk.row_of(symbols)),
        "n_dup_lines": count(line_rows, again),
        "n_repeat_words": count(rows, covered),
    }


#: Bytes of a line: all but the line feed.
chunk_lines = ~T._table(b"\n")


def _slots(chunk: T.Chunk, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, word pairs and characters: slots in one table of weights, and the first and past-last of each row."""
    rows, hashes = chunk.row_of(starts), T.word_hashes(chunk, starts, ends, lower=True)
    pairs, first = T.windows(hashes, rows, 2)
    chars, char_starts, char_ends = L.char_ngrams(chunk, CHAR_WIDTH, CHAR_BITS)
    every = np.arange(chunk.rows + 1)
    cuts, pair_cuts = np.searchsorted(rows, every), np.searchsorted(rows[first], every)
    words = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    pairs = (pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int32) + (1 << WORD_BITS)
    limit = len(chars)
    return [
        (words, cuts[:-1], cuts[1:]),
        (pairs, pair_cuts[:-1], pair_cuts[1:]),
        (chars.astype(np.int32) + (1 << WORD_BITS) + (1 << PAIR_BITS), np.minimum(char_starts, limit), np.minimum(char_ends, limit)),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, values = [], []
        for chunk in T.chunks(batch["text"]):
            found = _slots(chunk, *T.word_bounds(chunk, T.NOT_SPACE))
            for r in range(chunk.rows):
                own = [np.unique(s[a[r] : b[r]], return_counts=True) for s, a, b in found]
                slots.append(np.concatenate([x for x, _ in own]).astype("<i4").tobytes())
                values.append(np.concatenate([n / max(1, n.sum()) for _, n in own]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "label", "slots", "vals"])


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE, folds: int = 5) -> Model | None:
    """Fit on at most `sample` labelled rows; one fold of ids calibrates. None if a class is missing."""
    rows = L.labelled_sample(docs, labels, column, sample).mapInArrow(_features, "doc_id long, label int, slots binary, vals binary").collect()
    slots, values, at, y, ids = L.joined_arrays(rows)
    if len(set(y.tolist())) < 2:
        return None
    held = np.array([T.crc_fold_py(i, folds) == 0 for i in ids])
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    position = np.cumsum(~held) - 1
    own = ~held[at]
    w, b = L.fit_logistic(slots[own], values[own], position[at[own]], y[~held], SIZE)
    logits = np.bincount(at, w[slots] * values, len(y)) + b
    slope, offset = L.platt(logits[held], y[held]) if len(set(y[held].tolist())) == 2 else (1.0, 0.0)
    del rows, slots, values, at
    T.release_memory()
    return Model(w.astype(np.float32), b, slope, offset)


def _score(model, threshold: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            done: dict[str, list[np.ndarray]] = {}
            for chunk in T.chunks(batch["text"]):
                starts, ends = T.word_bounds(chunk, T.NOT_SPACE)
                out = measure(chunk, starts, ends)
                score = np.ones(chunk.rows)
                if m is not None:
                    shares = sum(L.row_sums(m.weights[s], a, b) / np.maximum(1, b - a) for s, a, b in _slots(chunk, starts, ends))
                    score = L.sigmoid(m.slope * (shares + m.bias) + m.offset)
                failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
                for name, values in (out | {"base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}).items():
                    done.setdefault(name, []).append(values)
            if done:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(np.concatenate(x)) for x in done.values())], ["doc_id", *done])

    return T.tidy(task)


def apply_rules(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, score (calibrated probability of label 1) and kept. The broadcast model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return T.id_and_text(docs).mapInArrow(_score(shared, threshold), _SCHEMA)
