"""Vectorised text helpers that the operators run inside Spark tasks.

A task sees Arrow batches. `chunks` cuts them into slices of about one megabyte of UTF-8 so that the
working arrays stay small whatever the batch size, and the rest of the module works on whole slices:
byte classes come from 256-entry tables, words from class changes, and word hashes from one
multiply-and-sum over the bytes. A null text counts as an empty one.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_RANDOM = np.random.default_rng(20240229)
_BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE = _table(b" \t\n\x0b\x0c\r")
#: Byte classes: white-space separated words, and runs of ASCII letters, digits and non-ASCII characters.
NOT_SPACE = ~SPACE
ALNUM = _table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x41, 0x5B)) + bytes(range(0x80, 0x100)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Chunk:
    """Some rows of a batch: `data` holds their texts end to end, row r at `offsets[r]:offsets[r+1]`."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The row that holds each byte position."""
        return np.searchsorted(self.offsets, at, side="right") - 1


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, max_rows: int = 1 << 16) -> Iterator[Chunk]:
    """Slices of at most `limit` bytes and `max_rows` rows, or of one longer text."""
    texts = texts.fill_null("") if texts.null_count else texts
    large = texts.cast(pa.large_string())
    _, raw_offsets, raw = large.buffers()
    n = len(large)
    if not n:
        return
    offsets = np.frombuffer(raw_offsets, np.int64, n + 1, large.offset * 8)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, at + max_rows)
        yield Chunk(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def word_bounds(chunk: Chunk, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of bytes of the class; runs end where their row ends."""
    inside = member[chunk.data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(inside) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[chunk.offsets] = True
    cuts = np.flatnonzero(edge)
    kept = inside[cuts[:-1]]
    return cuts[:-1][kept], cuts[1:][kept]


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, with A-Z lower-cased first if asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    codes = _BYTE_CODES[LOWER] if lower else _BYTE_CODES
    powers, total = _power_table(int(lengths.max())), np.cumsum(lengths)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # some words at a time, so that a long text's arrays stay small
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
        n = lengths[at:end]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        values = codes[chunk.data[place + np.repeat(starts[at:end], n)]] * powers[place]
        out[at:end] = np.add.reduceat(values, first)
        at = end
    return mix(out)


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of `width` consecutive words of one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    whole = np.flatnonzero(rows[:n] == rows[width - 1 : width - 1 + n])
    return mix(out[whole]), whole


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of characters before each byte, with one more entry for the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def crc_fold_py(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def light_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches hold at most BATCH_BYTES: long texts and sets don't pile up in a task.

    Spark reads the size when the plan runs, so it is a setting of the session; one that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`task`, giving the memory that it no longer uses back at its end: Spark keeps idle Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        release_memory()

    return run


def release_memory() -> None:
    """Give what the process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def id_and_text(docs: DataFrame, *more: Column) -> DataFrame:
    """Only what an operator reads, so that other columns, whatever their names, can't clash, in light batches."""
    light_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
