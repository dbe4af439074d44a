"""Token ids on disk: fixed-size blocks in bit or byte planes, each plane compressed with zstandard.

Documents are dealt by ranges of doc_id, so file k holds ids below file k+1's, and written in order. A
file's rows are chunks of blocks; a chunk's row is also its entry in the index: which part and place it has, which
documents it holds, how many ids, how many a block, and where every plane of every block ends in its payload. A reader
finds a document's chunk from the columns alone, and `block_ids_of` decompresses one block without the others.

Payload of a chunk: the compressed planes, block after block. A block has `block_ids` ids (the last one of a chunk
what is left, filled with zeros to whole bytes), plane p of it has byte p (or bit p) of each of its ids. Planes that are
all zero, as the high ones are, take a few bytes.

Spark writes the files as Parquet, so a lost executor's attempt leaves nothing behind and any store that
Spark reaches will do. Rows with a null id come first, repeated and null ids follow each other by their text
(ranges include its front, so that the null ids aren't one task), an empty document holds the end id alone, an empty table gives
no chunk. Only doc_id and text are read, so other columns' names don't matter. A task holds one chunk: at least
`chunk_ids`, and the whole of the document that reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.llm._text import id_and_text, tidy
from voxelloom.llm.storage import new_folder
from voxelloom.llm.tokenize import encoder

BLOCK_IDS = 1 << 16
#: Ids in a chunk before the next document opens a new one.
CHUNK_IDS = 1 << 20
#: Entries of a worker's table of pre-tokens.
TABLE_ENTRIES = 1_000_000

_CHUNK = "part int, chunk int, start_in_part long, n_docs int, n_ids long, block_ids int, doc_ids binary, doc_nulls binary, lengths binary, planes string, plane_ends binary, payload binary"


def to_planes(ids: np.ndarray, kind: str = "byte", multiple: int = 1) -> list[bytes]:
    """The planes of one block of ids (unsigned 32-bit), filled with zeros to a multiple of so many ids."""
    ids = np.concatenate([ids, np.zeros(-len(ids) % multiple, "<u4")])
    if kind == "byte":
        return [x.tobytes() for x in np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)]
    return [np.packbits((ids >> np.uint32(p)) & np.uint32(1)).tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).reshape(-1).view("<u4")[:n]
    out = np.zeros(n, "<u4")
    for p, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype("<u4") << np.uint32(p)
    return out


def block_ids_of(row: dict, block: int) -> np.ndarray:
    """Ids of one block of a chunk; only its planes are decompressed."""
    n_planes = 4 if row["planes"] == "byte" else 32
    ends = np.frombuffer(row["plane_ends"], "<i8")
    cuts = [0, *ends.tolist()][block * n_planes : (block + 1) * n_planes + 1]
    planes = [zstandard.decompress(row["payload"][a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return from_planes(planes, min(row["block_ids"], row["n_ids"] - block * row["block_ids"]), row["planes"])


def _writer(path: str, end_id: int, kind: str, block_ids: int, chunk_ids: int, level: int):
    end = int(end_id).to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, chunk, start = encoder(path, TABLE_ENTRIES), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, start, size
            ids, pack = np.frombuffer(b"".join(held), "<u4"), zstandard.ZstdCompressor(level=level).compress
            packed = [pack(p) for k in range(0, len(ids), block_ids) for p in to_planes(ids[k : k + block_ids], kind)]
            row = {
                "part": part,
                "chunk": chunk,
                "start_in_part": start,
                "n_docs": len(docs),
                "n_ids": size,
                "block_ids": block_ids,
                "doc_ids": np.array([x or 0 for x in docs], "<i8").tobytes(),
                "doc_nulls": np.array([x is None for x in docs], np.uint8).tobytes(),
                "lengths": np.array([len(x) // 4 for x in held], "<i8").tobytes(),
                "planes": kind,
                "plane_ends": np.cumsum([len(x) for x in packed]).astype("<i8").tobytes(),
                "payload": b"".join(packed),
            }
            chunk, start, size = chunk + 1, start + size, 0
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = of.encode(text.as_py()) + end
                docs.append(doc)
                held.append(ids)
                size += len(ids) // 4
                if size >= chunk_ids:
                    yield flush()
        if docs:
            yield flush()

    return tidy(task)


_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()), ("lengths", pa.binary()), ("planes", pa.string()), ("plane_ends", pa.binary()), ("payload", pa.binary())])


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0, kind: str = "byte", block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, level: int = 3) -> None:
    """Encode every text, append `end_id`, and write the ids to `folder` in ascending doc_id order."""
    if kind not in ("byte", "bit") or block_ids < 1:
        raise ValueError("planes are 'byte' or 'bit', of blocks of an id or more")
    keyed = id_and_text(docs, F.substring(F.col("text").cast("string"), 1, 256).alias("front"))
    ordered = keyed.repartitionByRange("doc_id", "front").drop("front").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(path, end_id, kind, block_ids, chunk_ids, level), _CHUNK).write.parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = b"".join(block_ids_of(row, k).tobytes() for k in range(-(-row["n_ids"] // row["block_ids"])))
            lengths = np.frombuffer(row["lengths"], "<i8")
            ends = np.cumsum(lengths)
            doc = pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["doc_nulls"], bool))
            values = pa.array([ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([doc, pa.array(row["start"] + ends - lengths), pa.array(lengths), values], ["doc_id", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and `ids` of each document, from the files.

    A chunk knows its place in its file. Where a file starts comes from one row for each file, so what is
    broadcast is bounded by the number of files.
    """
    chunks = spark.read.schema(_CHUNK).parquet(folder)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    starts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("part_start"))
    placed = chunks.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))
    return placed.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str, end_id: int = 0, **options) -> DataFrame:
    """Write to a new folder in the shared one, and read back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write_token_files(docs, path, folder, end_id, **options)
    return read_token_files(spark, folder)
