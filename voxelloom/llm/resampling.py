"""Resampling by importance: documents drawn in proportion to how much likelier their n-grams are in a target corpus.

A 256-byte table lower-cases A-Z and blanks every separator, leaving digits, letters and all bytes beyond ASCII, so that a
text's UTF-8 is one `translate` and one `split` away from its words. A feature is a run of 1 to `max_n` words joined by one
space; its bucket is the crc32 of its bytes modulo `buckets`, and the checksum of a run seeds that of the run one word
longer, so that no joined text is ever made.

1. One pass over the documents and one over the target count features a bucket. Each task sums its texts in a Counter
   and sends on at most `buckets` counts, which Spark adds; the driver gets `buckets` sums whatever the input.
2. A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), for s of the S features of
   the documents and t of the T of the target. The table of gains is broadcast: its size is the parameter `buckets`.
3. A second pass gives each document its weight, the floored mean of its features' gains, and a score: the
   weight plus Gumbel noise from a hash of `<seed>:<id>`. The highest scores are a draw without replacement.
4. Ranks without a global sort in one task: counts by score, of which there are few as scores are whole numbers in
   thousandths of a log, say where the draw ends. Rows from there up are dealt by ranges of score, id and row, and a row's
   rank is the number of rows in the ranges before plus its place in its own; copies of one row don't meet in one task.

Null texts have no words, and texts without words have weight 0; a null id is hashed as an empty string and comes after other
ids in ties. Repeated rows are documents of their own, each drawn and ranked by itself. Empty documents or targets
count 0 features. Only doc_id and text are read, so other columns' names don't matter. A text is read whole,
`SLICE_BYTES` of it at a time. Scored rows are written to the shared folder before they are ranked, so a lost executor
can't change what the ranks refer to.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm._text import id_and_text, light_batches, tidy
from voxelloom.llm.storage import written

#: Words of a longer text are split so many bytes at a time.
SLICE_BYTES = 1 << 20
TRANSLATION = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def word_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about SLICE_BYTES."""
    clean, at = raw.translate(TRANSLATION), 0
    while at < len(clean):
        end = len(clean) if len(clean) - at <= SLICE_BYTES else clean.find(b" ", at + SLICE_BYTES)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def feature_hashes(raw: bytes, max_n: int) -> Iterator[tuple[int, list[int]]]:
    """(words, crc32 of every run of 1 to `max_n` words that ends in them) for each slice of a text."""
    carried: list[bytes] = []
    for new in word_slices(raw):
        words = carried + new
        sums = list(map(zlib.crc32, words))
        found, spaced = sums[len(carried) :], [b" " + w for w in words]
        for n in range(2, max_n + 1):
            sums = list(map(zlib.crc32, spaced[n - 1 :], sums))
            found += sums[max(0, len(carried) - n + 1) :]
        yield len(new), found
        carried = words[len(words) - max_n + 1 :] if max_n > 1 else []


def _buckets(hashes: list[int], buckets: int) -> np.ndarray:
    return np.fromiter(hashes, np.int64, len(hashes)) % buckets


def _counted(buckets: int, max_n: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text.is_valid:
                    for _, hashes in feature_hashes(bytes(text.as_buffer()), max_n):
                        counts.update(_buckets(hashes, buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    return tidy(task)


def bucket_counts(texts: DataFrame, buckets: int, max_n: int) -> np.ndarray:
    """Features a bucket over a whole table with a text column."""
    light_batches(texts)
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(buckets, max_n), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares in the target and in the documents, add-one smoothed."""
    n, total_s, total_t = len(source), float(source.sum()), float(target.sum())
    ratios = ((t + 1.0) * (total_s + n) / ((s + 1.0) * (total_t + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weighed(shared, buckets: int, max_n: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = features = total = 0
                for n, hashes in feature_hashes(bytes(text.as_buffer()) if text.is_valid else b"", max_n):
                    words, features = words + n, features + len(hashes)
                    total += int(table[_buckets(hashes, buckets)].sum())
                out.append((words, features, total // features if features else 0))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_features", "weight"])

    return tidy(task)


def _gumbel(seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row in its sorted partition."""
    at = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "part")), pa.array(np.arange(at, at + batch.num_rows))], ["row", "part", "place"])
        at += batch.num_rows


def highest(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """(row, rank) of the best `percent` of the eligible rows of `scored` (doc_id, score and a unique row number)."""
    rows = scored.where(eligible).select("score", "doc_id", "row")
    counts = sorted(((r["score"], r["n"]) for r in rows.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    taken, last = 0, None
    for score, n in counts:
        if taken >= wanted:
            break
        taken, last = taken + n, score
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    best = rows.where(F.col("score") >= F.lit(last).cast("long"))
    placed = best.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.spark_partition_id().alias("part")).mapInArrow(_numbered, "row long, part int, place long")
    placed = written(placed, "ranks")
    sizes, before = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect(), [0]
    for r in sizes:
        before.append(before[-1] + r["n"])
    starts = scored.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=False)], "part int, start long")
    ranked = placed.join(F.broadcast(starts), "part").select("row", (F.col("start") + F.col("place") + 1).alias("rank"))
    return ranked.where(F.col("rank") <= wanted)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, max_n: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every row."""
    source, wanted = (bucket_counts(t, buckets, max_n) for t in (docs, target))
    shared = docs.sparkSession.sparkContext.broadcast(gains(source, wanted))
    weighed = id_and_text(docs).mapInArrow(_weighed(shared, buckets, max_n), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.select("*", (F.col("weight") + _gumbel(seed)).alias("score"), F.monotonically_increasing_id().alias("row")), "scored")
    ranked = highest(scored, F.col("n_words") >= least_words, percent)
    return scored.join(ranked, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
