"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each place in that tree of decisions has a context tree over the bytes
before it, the latest first, to DEPTH. A node's counts give the Krichevsky-Trofimov estimate, and its weighted
probability is half that estimate and half the product of its children, so all depths are mixed with
weights that the corpus sets. The frozen weights then give every (context, byte) one probability.
Texts are A-Z lower-cased, begin in a context of zero bytes and end with a zero byte.

How it runs, with nothing whole in one place:

1. Texts are cut into blocks of at most BLOCK_BYTES and written, compressed, with their block: all later steps read these
   files, so a lost executor can't deal the rows anew.
2. Each task counts the distinct byte windows (DEPTH context bytes and the next) and words of a block; counts are of
   training rows, windows of all rows.
3. Counts of one window are added wherever it lies, and the distinct windows then meet by their two latest context bytes,
   which solves depth 2 and below once: each window keeps the probabilities of its eight decisions from depth 2 down, each
   context sends its nodes up. A task holds at least one such context whole: its distinct windows, about 200 bytes each.
4. Aggregation makes the nodes at depths 1 and 0, at most 65,280: what the driver gathers and broadcasts. Each window's value
   then follows from its own row.
5. The values return to the blocks that hold the keys and meet the block's texts.

`base_score` is the add-one unigram score over words and an end token. Rows whose id has the held-out
crc32 remainder don't train. Null texts count as empty: they are an end token and a zero byte. Without
training rows counts are 0 and every decision has probability 1/2. One row per row, repeated and null ids too; an empty
table has none. Only doc_id and text are read, so other columns' names don't matter. A text is in one block whatever its
length, and is counted a slice at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import _text as T
from voxelloom.llm.storage import drop_shuffles, written

DEPTH = 4
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 48 << 20
_WINDOW, _WORD, _NODE = 0, 1, 2
#: Windows that a task solves together, and at least one whole context of SPLIT bytes.
SOLVED_ROWS, SPLIT = 1 << 18, 2
_END_TOKEN = np.array([1], np.uint64)
_HALF = math.log(0.5)
_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2: Stirling's series after a shift by eight."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int, least: int = 2) -> Iterator[tuple]:
    """For each of a byte's eight decisions: label and bit of each row, the probability of that bit from depth `least`
    down, and the nodes at that depth: a row of each, n0, n1 and the log of the weighted probability.

    `keys` hold the context bytes, the latest first, then the next byte; contexts that share their first `least` bytes
    are whole.
    """
    byte = keys & 0xFF
    for k in range(8):
        label, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
        inner, p, first_of_child = None, None, None
        for d in range(depth, least - 1, -1):
            context = keys >> (8 * (depth - d) + 8)
            _, first, at = np.unique(context * 256 + label, return_index=True, return_inverse=True)
            n1 = np.bincount(at, counts * bit, len(first))
            n0 = np.bincount(at, counts * (1 - bit), len(first))
            estimate = log_kt(n0, n1)
            own = (np.where(bit == 1, n1[at], n0[at]) + 0.5) / (n0 + n1 + 1)[at]
            if inner is None:
                weighted, p = estimate, own
            else:
                children = np.bincount(at[first_of_child], inner, len(first))
                weighted = np.logaddexp(_HALF + estimate, _HALF + children)
                share = np.exp(_HALF + estimate - weighted)[at]
                p = share * own + (1 - share) * p
            inner, first_of_child = weighted, first
        yield label, bit, p, first_of_child, n0, n1, inner


def top(c1: np.ndarray, label: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depths 1 and 0. mix[c1, label, bit] + rest[c1, label] * p is the probability of a bit that has p from depth 2 down."""
    estimate = log_kt(n0, n1)
    weighted = np.logaddexp(_HALF + estimate, _HALF + children)
    share1 = np.exp(_HALF + estimate - weighted)
    r0, r1 = np.bincount(label, n0, 256), np.bincount(label, n1, 256)
    root = log_kt(r0, r1)
    share0 = np.exp(_HALF + root - np.logaddexp(_HALF + root, _HALF + np.bincount(label, weighted, 256)))
    mix, rest = np.zeros((256, 256, 2)), np.zeros((256, 256))
    s0 = share0[label]
    for bit, (r, n) in enumerate(((r0, n0), (r1, n1))):
        mix[c1, label, bit] = s0 * ((r + 0.5) / (r0 + r1 + 1))[label] + (1 - s0) * share1 * (n + 0.5) / (n0 + n1 + 1)
    rest[c1, label] = (1 - s0) * (1 - share1)
    return mix, rest


def window_keys(chunk: T.Chunk, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each byte of each text and of its end, and the row of each."""
    sizes = np.diff(chunk.offsets)
    padded = np.zeros(depth + len(chunk.data) + depth * chunk.rows, np.uint8)
    rows = np.repeat(np.arange(chunk.rows), sizes)
    at = depth + np.arange(len(chunk.data)) + depth * rows
    padded[at] = T.LOWER[chunk.data]
    use = np.zeros(len(padded), bool)
    use[at] = True
    use[depth + chunk.offsets[1:] + depth * np.arange(chunk.rows)] = True
    place = np.flatnonzero(use)
    return _keys(padded, place, depth), np.repeat(np.arange(chunk.rows), sizes + 1)


def _keys(padded: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    keys = np.zeros(len(place), np.int64)
    for d in range(1, depth + 1):
        keys = keys << 8 | padded[place - d]
    return keys << 8 | padded[place]


def window_slices(chunk: T.Chunk, depth: int, size: int = 2 * T.CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`window_keys`, a slice at a time where one text is longer than `size`."""
    if chunk.rows > 1 or len(chunk.data) <= size:
        yield window_keys(chunk, depth)
        return
    for at in range(0, len(chunk.data) + 1, size):
        end = min(at + size, len(chunk.data) + 1)
        before = np.zeros(max(0, depth - at), np.uint8)
        after = np.zeros(end - min(end, len(chunk.data)), np.uint8)
        padded = np.concatenate([before, T.LOWER[chunk.data[max(0, at - depth) : end]], after])
        yield _keys(padded, np.arange(depth, depth + end - at), depth), np.zeros(end - at, np.int64)


def token_keys(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, then of each text's end, and the row of each."""
    starts, ends = T.word_bounds(chunk, T.NOT_SPACE)
    hashes = T.word_hashes(chunk, starts, ends, lower=True)
    return np.concatenate([hashes, np.repeat(_END_TOKEN, chunk.rows)]).view(np.int64), np.concatenate([chunk.row_of(starts), np.arange(chunk.rows)])


class _Blocks:
    """Number of the block of each chunk: the task's partition and how many BLOCK_BYTES came before."""

    def __init__(self):
        self.base, self.size = TaskContext.get().partitionId() << 24, 0

    def of(self, chunk: T.Chunk) -> int:
        if self.size and self.size % BLOCK_BYTES + len(chunk.data) > BLOCK_BYTES:
            self.size = -(-self.size // BLOCK_BYTES) * BLOCK_BYTES
        block = self.base + self.size // BLOCK_BYTES
        self.size += max(1, len(chunk.data))
        return block


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at, keys = pd.factorize(np.concatenate([k for k, _ in parts]))
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _held(ids: list) -> np.ndarray:
    return np.array([T.crc_fold_py(i, FOLDS) == HELD_OUT for i in ids], bool)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts with their block, compressed."""
    blocks = _Blocks()
    for batch in batches:
        values = batch["doc_id"].to_pylist()
        for chunk in T.chunks(batch["text"]):
            own = pa.array(values[chunk.first : chunk.first + chunk.rows], pa.int64())
            table = pa.RecordBatch.from_arrays([own, pa.array(np.diff(chunk.offsets))], ["doc_id", "size"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_batch(table)
            head = sink.getvalue().to_pybytes()
            body = zstandard.compress(chunk.data.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([blocks.of(chunk)], pa.int64()), pa.array([head], pa.binary()), pa.array([body], pa.binary())], ["block", "head", "body"])


def _unpacked(head: bytes, body: bytes) -> tuple[list, T.Chunk]:
    """Ids and texts of one chunk."""
    rows = pa.ipc.open_stream(head).read_all()
    return rows["doc_id"].to_pylist(), T.Chunk(np.frombuffer(zstandard.decompress(body), np.uint8), np.concatenate([[0], np.cumsum(rows["size"].to_numpy())]), 0)


def _count(depth: int):
    """Distinct windows and words of each block, with how often they train."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        parts: dict[int, list] = {_WINDOW: [], _WORD: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, found in parts.items():
                keys, n = _summed(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), now)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["block", "kind", "key", "n"])
                found.clear()

        for batch in batches:
            for block, head, body in zip(batch["block"].to_pylist(), batch["head"], batch["body"], strict=True):
                if now is not None and block != now:
                    yield from flush()
                now = block
                ids, chunk = _unpacked(head.as_py(), body.as_py())
                trains = ~_held(ids)
                for kind, pieces in ((_WINDOW, window_slices(chunk, depth)), (_WORD, [token_keys(chunk)])):
                    for keys, rows in pieces:
                        at, found = pd.factorize(keys)
                        parts[kind].append((found, np.bincount(at, trains[rows], len(found))))
                        if len(parts[kind]) >= 32:
                            parts[kind][:] = [_summed(parts[kind])]
        if now is not None:
            yield from flush()

    return T.tidy(task)


def _solve(depth: int):
    """From windows and words, sorted so that whole contexts of SPLIT bytes follow each other: each window with its eight
    probabilities from that depth down, nodes summed to contexts of one byte, and the words as they come."""
    shift = 8 * (depth + 1 - SPLIT)
    names = ["kind", "key", "n", "p", "label", "n0", "n1", "weighted"]

    def solved(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        p, nodes = np.empty((len(keys), 8)), []
        for k, (label, _, own, first, n0, n1, weighted) in enumerate(subtrees(keys, counts.astype(float), depth, SPLIT)):
            p[:, k] = own
            nodes.append((keys[first] >> (8 * depth) << 8 | label[first], n0, n1, weighted))
        node, n0, n1, weighted = (np.concatenate(x) for x in zip(*nodes, strict=True))
        found, at = np.unique(node, return_inverse=True)
        sums = [np.bincount(at, x, len(found)) for x in (n0, n1, weighted)]
        nulls = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
        wide = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, 64 * len(keys) + 1, 64, dtype=np.int32)), pa.py_buffer(p)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), _WINDOW, np.int32)), pa.array(keys), pa.array(counts), wide, *nulls(len(keys), pa.int32(), pa.float64(), pa.float64(), pa.float64())], names)
        kind = pa.array(np.full(len(found), _NODE, np.int32))
        yield pa.RecordBatch.from_arrays([kind, pa.array(found >> 8), *nulls(len(found), pa.int64(), pa.binary()), pa.array((found & 255).astype(np.int32)), *map(pa.array, sums)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            kind = batch["kind"].to_numpy()
            words = np.flatnonzero(kind == _WORD)
            if len(words):
                own = batch.take(pa.array(words))
                yield pa.RecordBatch.from_arrays([own["kind"], own["key"], own["n"], pa.nulls(len(words), pa.binary()), pa.nulls(len(words), pa.int32()), *(pa.nulls(len(words), pa.float64()) for _ in range(3))], names)
            use = kind == _WINDOW
            keys, counts = np.concatenate([keys, batch["key"].to_numpy()[use]]), np.concatenate([counts, batch["n"].to_numpy()[use]])
            if len(keys) >= SOLVED_ROWS:
                whole = int(np.searchsorted(keys, keys[-1] >> shift << shift))  # the last context may go on
                if whole:
                    yield from solved(keys[:whole], counts[:whole])
                    keys, counts = keys[whole:], counts[whole:]
        if len(keys):
            yield from solved(keys, counts)

    return T.tidy(task)


def _values(depth: int, shared):
    """Log10 probability of each window."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, rest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, raw = batch["key"].to_numpy(), batch["p"]
            begin = int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset])
            p = np.frombuffer(raw.buffers()[2], np.float64, 8 * len(raw), begin).reshape(-1, 8)
            c1, byte, total = keys >> (8 * depth), keys & 0xFF, np.zeros(len(keys))
            for k in range(8):
                label, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
                total += np.log10(mix[c1, label, bit] + rest[c1, label] * p[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["key", "value"])

    return T.tidy(task)


def _score(depth: int, n_train: int, n_distinct: int):
    """Scores of one block: its texts and the values of its windows and words."""
    floor = math.log10(n_train + n_distinct + 1)

    def group(texts: pa.Table, values: pa.Table) -> pa.Table:
        kind, key, value = values["kind"].to_numpy(), values["key"].to_numpy(), values["value"].to_numpy()
        known = {}
        for k in (_WINDOW, _WORD):  # two tasks that read one block count its keys twice
            index, own = pd.Index(key[kind == k]), value[kind == k]
            known[k] = (index, own) if index.is_unique else (index.unique(), own[~index.duplicated()])

        def look(k: int, wanted: np.ndarray) -> np.ndarray:
            index, vals = known[k]
            return vals[index.get_indexer(wanted)]

        out = []
        for head, body in zip(texts["head"].to_pylist(), texts["body"].to_pylist(), strict=True):
            ids, chunk = _unpacked(head, body)
            n = chunk.rows
            score = sum((np.bincount(at, look(_WINDOW, keys), n) for keys, at in window_slices(chunk, depth)), np.zeros(n))
            words, at = token_keys(chunk)
            count = look(_WORD, words)
            base = np.bincount(at, np.log10(count + 1) - floor, n)
            out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(_held(ids)), "n_tokens": np.bincount(at, minlength=n), "n_known": np.bincount(at, count > 0, n).astype(np.int64), "base_score": base, "score": score, "bits_per_byte": -score * math.log2(10) / (np.diff(chunk.offsets) + 1)}))
        return pa.concat_tables(out)

    return group


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte of every row.

    bits_per_byte is the code length of the text and its end over its bytes and one.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is from 2 to 6, so that a window fits a 64-bit key")
    spark = docs.sparkSession
    texts = written(T.id_and_text(docs).mapInArrow(_texts, "block long, head binary, body binary"), "texts")
    counted = written(texts.mapInArrow(_count(depth), "block long, kind int, key long, n long"), "counts")
    latest = F.when(F.col("kind") == _WINDOW, F.shiftright("key", 8 * (depth + 1 - SPLIT))).otherwise(F.col("key"))
    sums = counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    ordered = sums.select("kind", "key", "n", latest.alias("latest")).repartition("latest").drop("latest").sortWithinPartitions("kind", "key")
    solved = written(ordered.mapInArrow(_solve(depth), "kind int, key long, n long, p binary, label int, n0 double, n1 double, weighted double"), "solved")
    drop_shuffles(spark)

    nodes = solved.where(F.col("kind") == _NODE).groupBy(F.col("key").alias("c1"), "label")
    first = nodes.agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weighted"))).orderBy("c1", "label").toPandas()
    shared = spark.sparkContext.broadcast(top(*(first[c].to_numpy(np.int64) for c in ("c1", "label")), *(first[c].to_numpy(np.float64) for c in ("n0", "n1", "weighted"))))
    word_sums = solved.where(F.col("kind") == _WORD)
    n_train, n_distinct = word_sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()

    window_values = solved.where(F.col("kind") == _WINDOW).select("key", "p").mapInArrow(_values(depth, shared), "key long, value double").select(F.lit(_WINDOW).alias("kind"), "key", "value")
    word_values = word_sums.select("kind", "key", F.col("n").cast("double").alias("value"))
    values = counted.select("block", "kind", "key").join(window_values.unionByName(word_values), ["kind", "key"])
    scored = texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_score(depth, n_train, n_distinct), _SCHEMA)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
