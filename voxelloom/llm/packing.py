"""Minimum-bin-slack packing of token sequences.

Each task encodes and packs the documents of its own partition, so nothing is shuffled and the work of a task is
bounded by its input. Whole windows are cut off the front of long documents; what is left of each
document is shorter than a window. Of these remainders only the multiset of lengths matters: `fill` runs
a bitset subset-sum over the distinct lengths (multiplicities in binary), takes the sum closest to the
capacity, and walks back through the bitsets to find how many of each length make it. Counts that fill a
window exactly are used for as many windows as the multiset holds; a slack that nothing fits is closed
by cutting the longest remainder.

When a partition's remainders no longer fill a window, the rest is laid end to end and cut at powers of
two, which need no padding.

A null text is an empty one; an empty document is its end id. Repeated rows are packed each for itself.
Sequence ids are the partition's number times 2**33 plus a count, unique over the result. An empty table
has no pieces; only doc_id and text are read, so other columns' names don't matter. A task holds HELD_BYTES of ids,
or one text's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm._text import id_and_text, tidy
from voxelloom.llm.tokenize import encoder

WINDOW = 2048
#: Remainders that a task holds before it packs them.
HELD = 200_000
HELD_BYTES = 16 << 20

_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take for the sum closest to `capacity` from below.

    A bitset has bit s when sum s can be reached. Longer lengths come first, so short ones, which close
    small gaps, are kept for later windows where there is a choice.
    """
    steps: list[tuple[int, int, int]] = []  # length, how many of it this step adds, sums reachable before it
    reach, mask = 1, (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, block = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            block *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return dict(chosen)


def pack_lengths(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (item, start in the item, length)."""
    out: list[list[tuple[int, int, int]]] = []
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, n in enumerate(lengths.tolist()):
        whole = n // window
        out += [[(item, k * window, window)] for k in range(whole)]
        if n % window:
            by_length[n % window].append((item, whole * window))
    volume = sum(k * len(v) for k, v in by_length.items())
    while volume >= window:
        chosen = fill({k: len(v) for k, v in by_length.items()}, window)
        slack = window - sum(k * n for k, n in chosen.items())
        times = 1 if slack else min(len(by_length[k]) // n for k, n in chosen.items())
        for _ in range(times):
            out.append([(*by_length[k].pop(), k) for k, n in chosen.items() for _ in range(n)])
        for k in chosen:
            if not by_length[k]:
                del by_length[k]
        if slack:  # nothing left fits it, so the longest remainder gives its front
            longest = max(by_length)
            item, start = by_length[longest].pop()
            if not by_length[longest]:
                del by_length[longest]
            out[-1].append((item, start, slack))
            by_length[longest - slack].append((item, start + slack))
        volume -= window * times
    rest = [(item, start, k) for k, items in sorted(by_length.items(), reverse=True) for item, start in items]
    room = 0
    total = sum(n for _, _, n in rest)
    for item, start, n in rest:
        while n:
            if not room:
                room = 1 << (total.bit_length() - 1)
                out.append([])
            cut = min(n, room)
            out[-1].append((item, start, cut))
            start, n, room, total = start + cut, n - cut, room - cut, total - cut
    return out


def _pack(path: str, end_id: int, window: int, held_rows: int):
    end = int(end_id).to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, base = encoder(path), TaskContext.get().partitionId() << 33
        docs: list[int | None] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            tokens = np.array([len(x) // 4 for x in held], np.int64)
            rows: list[tuple] = []
            for pieces in pack_lengths(tokens, window):
                offset = 0
                for item, start, n in pieces:
                    rows.append((docs[item], start, n, int(tokens[item]), base, offset, held[item][4 * start : 4 * (start + n)]))
                    offset += n
                base += 1
            docs.clear()
            held.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        size = 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = of.encode(text.as_py()) + end
                docs.append(doc)
                held.append(ids)
                size += len(ids)
                if len(docs) >= held_rows or size >= HELD_BYTES:
                    yield flush()
                    size = 0
        if docs:
            yield flush()

    return tidy(task)


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, held_rows: int = HELD) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids.

    Every id of every document lies in exactly one piece; `assemble` puts the sequences together.
    """
    return id_and_text(docs).mapInArrow(_pack(path, end_id, window, held_rows), _SCHEMA)


def assemble(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and `ids` of each whole sequence, at most one window a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda x: x.ids), F.lit(b""), lambda a, x: F.concat(a, x))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
