"""Labelled samples and sparse linear models for the two text classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm._text import LOWER, Chunk, code_points, light_batches


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int, keep: Column | None = None) -> DataFrame:
    """doc_id, text and `label` (0 or 1) of at most `limit` labelled ids, chosen by a hash of the id.

    Only the fit is bounded; its ids, `limit` at most, are what is broadcast. Null ids, texts and labels and labels
    other than 0 and 1 are left out; an id labelled twice has its larger label, an id with several rows its first text.
    """
    light_batches(docs)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    named = named.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if keep is not None:
        named = named.where(keep)
    chosen = named.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def char_ngrams(chunk: Chunk, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of the n-gram of characters (A-Z lower-cased) at each character of the chunk, and the first and past-last of
    each row's n-grams."""
    codes = np.frombuffer(LOWER[chunk.data].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = code_points(chunk.data)[chunk.offsets]
    n = max(0, len(codes) - width + 1)
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out = out * np.uint32(0x01000193) + codes[k : k + n]
    slots = (out * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return slots, offsets[:-1], np.maximum(offsets[1:] - width + 1, offsets[:-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Full-batch steps for one vector of weights."""

    def __init__(self, size: int, rate: float):
        self.w, self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        self.w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def fit_logistic(slots: np.ndarray, values: np.ndarray, rows: np.ndarray, labels: np.ndarray, size: int, l2: float = 1e-5, steps: int = 200, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias; classes weigh the same whatever their shares."""
    n = len(labels)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum()))
    fit = Adam(size + 1, rate)
    for _ in range(steps):
        wrong = weight * (sigmoid(np.bincount(rows, fit.w[slots] * values, n) + fit.w[-1]) - labels)
        gradient = np.bincount(slots, values * wrong[rows], size + 1) + l2 * fit.w
        gradient[-1] = wrong.sum()
        fit.step(gradient)
    return fit.w[:-1], float(fit.w[-1])


def platt(logits: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that turn held-out logits into probabilities, targets smoothed by the class counts."""
    good, bad = labels.sum(), (1 - labels).sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * logits + b)
        g = np.array([((p - target) * logits).sum() + 1e-3 * (a - 1), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * logits**2).sum() + 1e-3, (q * logits).sum()], [(q * logits).sum(), q.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        shrink = min(1.0, 1.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - shrink * da, b - shrink * db
    return float(max(a, 1e-3)), float(b)


def row_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for each pair; empty ones are 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[np.maximum(ends, starts)] - total[starts]


def joined_arrays(rows: Iterator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Slots, values, row numbers, labels and ids of collected rows (doc_id, label, slots, values) in id order."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    slots = [np.frombuffer(r["slots"], "<i4") for r in rows]
    values = [np.frombuffer(r["vals"], "<f4") for r in rows]
    empty = np.zeros(0)
    return (
        np.concatenate([*slots, empty.astype("<i4")]),
        np.concatenate([*values, empty.astype("<f4")]),
        np.repeat(np.arange(len(rows), dtype=np.int32), [len(s) for s in slots]) if rows else empty.astype(np.int32),
        np.array([r["label"] for r in rows], float),
        [r["doc_id"] for r in rows],
    )
