"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a given share, and their groups.

Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set holds the
64-bit hashes of its distinct `width`-word shingles, or of its whole sequence if it has fewer words.

1. One pass gives every document its set's size, class (documents with equal sets are one class, so copies cost nothing
   later) and parity sketch, and counts shingles over all documents, each class once a task, in a table that has about a
   cell for each shingle up to 2**MOST_BITS cells. Tasks send their counts compressed; of the sums only ranks are kept, half
   a byte a cell.
2. Each class sorts its shingles rare-first by these ranks and takes the prefix that a partner must share. Shingles in a
   cell that was counted once are in one class only, so they take their places and are left out before anything is
   shuffled: in a table that isn't full most prefixes consist of them. Rows of one shingle meet in one partition, where those
   without a partner of a like length go, and so do classes that have fewer such rows than a pair must share; a pair is a
   candidate if its lengths and the places of each shared shingle allow the overlap. Prefixes are `shared_in_prefix` - 1
   longer than one common shingle needs, so a pair that links has that many in common there; pairs with fewer, which long
   documents have by chance, are dropped by count. Then the sketches decide, which keep for each of 256 slots
   whether an odd number of shingles fell in it: slots that differ can't outnumber shingles that differ, which bounds what
   the suffixes still have in common. Larger sets have a second sketch of a slot or more for each shingle.
3. Candidates are verified once a pair on the whole sets, which are made again from compressed texts where the two of a
   pair meet: a text takes a third of its set's bytes there. To avoid all pairs in a group of near copies,
   the first round takes one leader for each shingle, the class whose prefix is most common, as the text is
   that the others are copies of; the second takes every remaining candidate between different components, from
   the classes of a shingle that aren't in its leader's component. Links inside a component can't change it, so
   no component is lost.

Hot keys: a shingle whose cell counts over HOT_TOKEN and over four times the mean has its rows dealt by
class, and finds its leader by partial aggregates; other shingles have no more rows than that. Joins on a shingle,
class or node deal the rows of a hot one over tasks (`skew`). The counts only order shingles, leave out those of one class, and
pick the way: any order is exact, rarer prefixes are cheaper. What is broadcast has a bounded size: the table, a bitmap of the classes
that a round verifies (sized by their number, 32 MB at most), and lists of hot keys. Beyond 2**MOST_BITS shingles, about
0.8 GB of text, the table fills: then shingles of one class can't be told from those of a few, more rows are shuffled (at most
all of the prefixes), and results stay the same. Each step's table goes when the next is written, all of them at the end.

Null and empty texts have no set, link with nothing and are their own component. Rows without an id take no
part; their component is null. Repeated ids are compared by each of their texts. An empty table has no rows. Other
columns are never read, whatever their names. A text is one set in one task: its shingles take about 40 bytes a
word there. Hashes of 64 bits stand for shingles and sets; a false match inside one pair has odds of about 1e-13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import _text as T
from voxelloom.llm.components import components
from voxelloom.llm.skew import dealt_join, hot_keys, split_join
from voxelloom.llm.storage import Steps, drop_shuffles, written

#: Bits of a cell's number in the table of counts: at least and at most, and those within one of its blocks. The largest
#: table takes half a byte a cell in every task, 64 MB.
LEAST_BITS, MOST_BITS, BLOCK_BITS, PARITY = 20, 27, 18, 256
#: Ranks of a count: 0 is a cell that one class at most has a shingle in, HOT one that may hold a hot shingle.
HOT_RANK = 15
#: Bits of the number of a class in the bitmap of a round, at least and at most (32 MB), and those within one of its blocks.
BITMAP_BITS, BITMAP_BLOCK = (16, 28), 16
#: Rows of one shingle, pairs of one class and copies of one class before they are dealt over several tasks.
HOT_TOKEN, HOT_CLASS, HOT_COPIES = 2_000, 200, 10_000
_PARITY_COLUMNS = ("p0", "p1", "p2", "p3")


def shingle_sets(chunk: T.Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and class sums of the distinct shingles of the chunk: rows and hashes sorted by both, sizes a row."""
    starts, ends = T.word_bounds(chunk, T.NOT_SPACE)
    rows = chunk.row_of(starts)
    hashes = T.word_hashes(chunk, starts, ends, lower=True)
    grams, first = T.windows(hashes, rows, width)
    gram_rows = rows[first]
    n_words = np.bincount(rows, minlength=chunk.rows)
    for k in range(1, width):  # short texts: their k words as one shingle, told apart from longer ones
        short = n_words == k
        if short.any():
            whole, at = T.windows(hashes, rows, k)
            own = short[rows[at]]
            grams = np.concatenate([grams, T.mix(whole[own] + np.uint64(k))])
            gram_rows = np.concatenate([gram_rows, rows[at][own]])
    order = np.lexsort((grams, gram_rows))
    grams, gram_rows = grams[order], gram_rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (gram_rows[1:] != gram_rows[:-1])
    return gram_rows[new], grams[new], np.bincount(gram_rows[new], minlength=chunk.rows)


def set_classes(rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row's set, the same for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    sums = total[ends] - total[ends - sizes]
    return T.mix(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[T.Chunk]:
    return T.chunks(batch["text"], max_rows=4096)


def table_bits(docs: DataFrame) -> int:
    """So many bits that the table has about a cell for each shingle, up to MOST_BITS."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // 6).bit_length()))


def _packed_counts(cells: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Sorted cells with their counts as one row a block: steps between cells and counts in byte planes, compressed."""
    block = cells >> BLOCK_BITS
    cuts = np.searchsorted(block, np.arange((1 << (bits - BLOCK_BITS)) + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own, n = cells[cuts[k] : cuts[k + 1]] & ((1 << BLOCK_BITS) - 1), counts[cuts[k] : cuts[k + 1]]
        both = np.stack([np.diff(own, prepend=0), n]).astype("<u4")
        yield k, zstandard.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    steps, counts = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1)
    return np.cumsum(steps), counts.astype(np.int64)


class _Fresh:
    """Whether a class is new to this task; a copy that passes again after very many classes is merely counted again."""

    def __init__(self):
        self.done: set[int] = set()

    def of(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if len(self.done) > 200_000:
            self.done.clear()
        return np.array([n > 0 and not (c in self.done or self.done.add(c)) for n, c in zip(sizes.tolist(), classes.tolist(), strict=True)], bool)


def _profile(width: int, own: list[str], bits: int):
    """Rows for each document (its `own` numbers, size, class and sketch), then this task's part of the table in blocks."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        cells, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return cells, np.bincount(at, np.concatenate([n for _, n in parts]), len(cells)).astype(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, fresh = [], _Fresh()
        names = [*own, "n_shingles", "class_id", *_PARITY_COLUMNS, "wide", "block", "counts"]
        for batch in batches:
            n_all, class_all, odd, wide = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)], [pa.array([], pa.binary())]
            for chunk in _chunks(batch):
                rows, grams, sizes = shingle_sets(chunk, width)
                classes = set_classes(rows, grams, sizes)
                counted = (grams >> np.uint64(64 - bits))[fresh.of(classes, sizes)[rows]].astype(np.int64)
                parts.append(np.unique(counted, return_counts=True))
                if len(parts) >= 16:
                    parts = [merged(parts)]
                n_all.append(sizes)
                class_all.append(classes)
                odd.append(_parities(rows, grams, chunk.rows))
                wide.append(wide_sketches(rows, grams, sizes))
            n = np.concatenate(n_all)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(n), pa.array(np.concatenate(class_all), mask=n == 0), *(pa.array(np.ascontiguousarray(c)) for c in np.concatenate(odd).T), pa.concat_arrays(wide), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        packed = list(_packed_counts(*merged(parts), bits)) if parts else []
        nulls = [pa.nulls(len(packed), pa.binary() if name == "wide" else pa.int64()) for name in names[:-2]]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array([k for k, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names)

    return T.tidy(task)


def rank_edges(mean: float) -> np.ndarray:
    """The least count of each rank from 1 up: 2, then steps of a constant ratio up to what is hot."""
    most = max(HOT_TOKEN, 4 * mean)
    return np.concatenate([[2], np.geomspace(min(max(3.0, mean / 2), most), most, HOT_RANK - 1)])


def _ranked(mean: float):
    """Blocks of ranks, two in a byte, from the parts of their counts; one part in memory at a time."""
    edges = rank_edges(mean)

    def packed(total: np.ndarray) -> bytes:
        ranks = np.searchsorted(edges, total, side="right").astype(np.uint8)
        return (ranks[::2] | ranks[1::2] << 4).tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            out = []
            for block, raw in zip(batch["block"].to_pylist(), batch["counts"], strict=True):
                if block != now:
                    if now is not None:
                        out.append((now, packed(total)))
                    now, total = block, np.zeros(1 << BLOCK_BITS, np.int64)
                cells, n = _unpacked_counts(raw.as_py())
                total[cells] += n
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["block", "ranks"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed(total)], pa.binary())], ["block", "ranks"])

    return T.tidy(task)


def _rank_table(profile: DataFrame, bits: int) -> np.ndarray:
    """Ranks of all cells, two in a byte: at most 2**MOST_BITS of them whatever the input."""
    total = profile.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = profile.where("block IS NOT NULL").select("block", "counts").repartition("block").sortWithinPartitions("block")
    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 1)), np.uint8)
    for row in parts.mapInArrow(_ranked(total / (1 << bits)), "block int, ranks binary").collect():
        out[row["block"]] = np.frombuffer(row["ranks"], np.uint8)
    return out.reshape(-1)


def ranks_of(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    bits = (2 * len(table)).bit_length() - 1
    cells = (grams >> np.uint64(64 - bits)).astype(np.int64)
    return (table[cells >> 1] >> (4 * (cells & 1)).astype(np.uint8)) & np.uint8(15)


def _parities(rows: np.ndarray, grams: np.ndarray, n_rows: int) -> np.ndarray:
    odd = np.bincount(rows * PARITY + (grams % np.uint64(PARITY)).astype(np.int64), minlength=n_rows * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_rows, PARITY), axis=1).view(np.int64)


def wide_sketches(rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parities of at least as many slots as a set has shingles, a power of two; empty for sets that `_parities` serves."""
    slots = np.where(sizes > PARITY, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    ends = np.cumsum(slots)
    own = slots[rows] > 0
    rows, grams = rows[own], grams[own]
    at = (ends - slots)[rows] + (grams & (slots[rows] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=slots.sum()) & 1).astype(np.uint8)).tobytes()
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def slots_that_differ(x: bytes, y: bytes) -> int:
    """Between two wide sketches; the longer one is folded to the slots of the other. 0 where there is none."""
    short, long = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    if not len(short):
        return 0
    while len(long) > len(short):
        half = len(long) // 2
        long = long[:half] ^ long[half:]
    return int(np.bitwise_count(short ^ long).sum())


def least_overlap(size_a, size_b, percent: int):
    """Fewest common shingles with which 100 * common >= percent * union."""
    return -(-(percent * (size_a + size_b)) // (100 + percent))


def shared_in_prefix(size):
    """How many shingles the prefixes of a linked pair must share: more for long sets, at least one."""
    return np.maximum(1, size // 50)


def prefix_rows(table: np.ndarray, rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray, fresh: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Row, shingle, place and rank of the shingles of each fresh set's prefix that another class may have, rare-first.

    Shingles of rank 0 are in one class only: they take their places, but nobody else can have them.
    """
    rank = ranks_of(table, grams).astype(np.uint64)
    order = np.lexsort(((rank << np.uint64(56)) | (grams >> np.uint64(8)), rows))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - -(-percent * sizes // 100) + shared_in_prefix(sizes)
    own = np.flatnonzero((place < prefix[rows]) & fresh[rows] & (rank[order] > 0))
    return rows[own], grams[order][own], place[own], rank[order][own].astype(np.int64)


def _prefixes(shared, width: int, percent: int):
    """A row for each of `prefix_rows`; `deal` is the class where the shingle may be hot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fresh = shared.value, _Fresh()
        for batch in batches:
            for chunk in _chunks(batch):
                rows, grams, sizes = shingle_sets(chunk, width)
                classes = set_classes(rows, grams, sizes)
                at, tokens, place, rank = prefix_rows(table, rows, grams, sizes, fresh.of(classes, sizes), percent)
                common = np.bincount(at, rank, chunk.rows) / np.maximum(1, np.bincount(at, minlength=chunk.rows))
                columns = [tokens.view(np.int64), classes[at], sizes[at].astype(np.int32), place.astype(np.int32), (1000 * common[at]).astype(np.int32)]
                deal = pa.array(classes[at], mask=rank < HOT_RANK)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), deal], ["token", "class_id", "n", "place", "common", "deal"])

    return T.tidy(task)


def _least(a: str, b: str, percent: int) -> Column:
    return F.expr(f"({percent}L * ({a}.n + {b}.n) + {99 + percent}L) div {100 + percent}L")


def _possible(a: str, b: str, percent: int) -> Column:
    """Length and positional filters on two rows of one shingle."""
    na, nb, pa_, pb = (F.col(f"{side}.{name}").cast("long") for name in ("n", "place") for side in (a, b))
    near = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return near & (F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1) >= _least(a, b, percent))


def _suffix(a: str, b: str, percent: int) -> Column:
    """Suffix filter: the parity sketches of two classes allow the overlap."""
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in _PARITY_COLUMNS), F.lit(0))
    return differ <= F.col(f"{a}.n") + F.col(f"{b}.n") - 2 * _least(a, b, percent)


def _wide_filtered(percent: int):
    """Pairs (a, b) whose wide sketches allow the overlap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            most = na + nb - 2 * least_overlap(na, nb, percent)
            differ = [slots_that_differ(x.as_buffer(), y.as_buffer()) for x, y in zip(batch["wa"], batch["wb"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(np.array(differ, np.int64) <= most))

    return T.tidy(task)


def _suffix_filtered(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that pass the suffix filter; of `sketches`, a row a document, only those of these classes move."""
    counts, hot = _ends(pairs)
    bits, bitmap = _bitmap(counts, counts.count())
    shared = pairs.sparkSession.sparkContext.broadcast(bitmap)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_bitmap(shared.value, bits, batch["class_id"].to_numpy())))

    sketches = sketches.mapInArrow(listed, sketches.schema).dropDuplicates(["class_id"])
    for side in ("a", "b"):
        own = sketches.select("class_id", F.struct("n", *_PARITY_COLUMNS, "wide").alias(f"of_{side}"))
        pairs = dealt_join(pairs.withColumn("class_id", F.col(side)), own, ["class_id"], hot, F.col("b" if side == "a" else "a")).drop("class_id")
    ends = [F.col(f"of_{side}.{c}").alias(f"{c[0]}{side}") for c in ("n", "wide") for side in "ab"]
    return pairs.where(_suffix("of_a", "of_b", percent)).select("a", "b", *ends).mapInArrow(_wide_filtered(percent), "a long, b long")


def _ends(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """How many pairs each class is in, and the classes that are in very many, if there are any."""
    ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
    counts = ends.groupBy("class_id").agg(F.count("*").alias("pairs"))
    hot = hot_keys(counts, ["class_id"], "pairs", pairs.count(), HOT_CLASS)
    return counts, None if hot.isEmpty() else hot


def _in_bitmap(bitmap: np.ndarray, bits: int, classes: np.ndarray) -> np.ndarray:
    cells = (classes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return ((bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)


def _texts(shared, bits: int, width: int):
    """Class and compressed text of the documents whose class may be in the bitmap, each class once a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, packer = set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for chunk in _chunks(batch):
                rows, grams, sizes = shingle_sets(chunk, width)
                classes = set_classes(rows, grams, sizes)
                found = []
                for r in np.flatnonzero(_in_bitmap(shared.value, bits, classes) & (sizes > 0)).tolist():
                    if (c := int(classes[r])) not in done:
                        done.add(c)
                        found.append((c, packer.compress(chunk.data[chunk.offsets[r] : chunk.offsets[r + 1]].tobytes())))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["class_id", "packed"])

    return T.tidy(task)


def _bitmap(classes: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits of a class's number, and a bitmap of the numbers of `n` classes with room for 16 times as many, made in blocks."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], (16 * n).bit_length()))
    cell = F.shiftrightunsigned("class_id", 64 - bits)
    cells = classes.select(F.shiftright(cell, BITMAP_BLOCK).cast("int").alias("block"), (cell % (1 << BITMAP_BLOCK)).cast("int").alias("at"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, at = batch["block"].to_numpy(), batch["at"].to_numpy()
            for block in np.unique(blocks).tolist():
                held.setdefault(block, np.zeros(1 << BITMAP_BLOCK, bool))[at[blocks == block]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["block", "bits"])

    out = np.zeros((1 << (bits - BITMAP_BLOCK), 1 << (BITMAP_BLOCK - 3)), np.uint8)
    for row in cells.repartition("block").mapInArrow(task, "block int, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits, out.reshape(-1)


def _overlap(width: int, percent: int):
    """Pairs (a, b) whose sets overlap enough; sets are made for some pairs at a time, each once."""

    def sets(packed: dict[int, bytes]) -> dict[int, np.ndarray]:
        texts = [zstandard.decompress(x) for x in packed.values()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        _, grams, sizes = shingle_sets(T.Chunk(np.frombuffer(b"".join(texts), np.uint8), offsets, 0), width)
        return dict(zip(packed, np.split(grams, np.cumsum(sizes)[:-1]), strict=True))

    def enough(x: np.ndarray, y: np.ndarray) -> bool:
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int((y[at] == x).sum())
        return 100 * common >= percent * (len(x) + len(y) - common)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True))
            keep, packed, size = [], {}, 0
            for k, pair in enumerate(pairs):
                for c, side in zip(pair, ("left", "right"), strict=True):
                    if c not in packed:
                        packed[c] = batch[side][k].as_py()
                        size += zstandard.frame_content_size(packed[c])
                if size >= T.CHUNK_BYTES or k == len(pairs) - 1:
                    held = sets(packed)
                    keep += [enough(held[x], held[y]) for x, y in pairs[len(keep) : k + 1]]
                    packed, size = {}, 0
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return T.tidy(task)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets overlap enough; only the texts of these classes move."""
    counts, hot = _ends(pairs)
    bits, bitmap = _bitmap(counts, counts.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    texts = docs.select("text").mapInArrow(_texts(shared, bits, width), "class_id long, packed binary")
    texts = texts.join(counts.select("class_id"), "class_id", "left_semi").dropDuplicates(["class_id"])
    left = split_join(pairs.withColumn("class_id", F.col("a")), texts.withColumnRenamed("packed", "left"), ["class_id"], hot, F.col("b"))
    both = split_join(left.withColumn("class_id", F.col("b")), texts.withColumnRenamed("packed", "right"), ["class_id"], hot, F.col("a"))
    return both.select("a", "b", "left", "right").mapInArrow(_overlap(width, percent), "a long, b long")


def _with_neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Without the rows whose neighbours by length, in their shingle, are too short and too long for them; hot ones stay."""
    sizes = "OVER (PARTITION BY token, deal ORDER BY n, class_id)"
    near = f"deal IS NOT NULL OR 100L * shorter >= {percent}L * n OR 100L * n >= {percent}L * longer"
    return rows.selectExpr("*", f"lag(n) {sizes} AS shorter", f"lead(n) {sizes} AS longer").where(near).drop("shorter", "longer")


def _prefix_groups(docs: DataFrame, table: np.ndarray, width: int, percent: int, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Prefix rows of shingles that two classes or more share, each with the leader of its shingle: those that are surely not
    hot, and the rest with their number of `classes`.

    Rows without a partner of a like length go first, then the classes with too few rows left, then rows that had only these.
    What the first step leaves is written, so that the shuffle of all prefixes is gone from disk before the next ones start.
    """
    spark = docs.sparkSession
    rows = docs.select("text").mapInArrow(_prefixes(spark.sparkContext.broadcast(table), width, percent), "token long, class_id long, n int, place int, common int, deal long")
    rows = steps.write(_with_neighbours(rows.repartition("token", "deal").dropDuplicates(["token", "deal", "class_id"]), percent), "near")
    drop_shuffles(spark)
    # A class with fewer such rows than a pair must share has no partner either.
    counted = rows.selectExpr("*", "count(*) OVER (PARTITION BY class_id) AS own")
    rows = counted.where(f"own >= greatest(1L, (({percent}L * n + 99L) div 100L) div 50L)").drop("own")
    rows = _with_neighbours(rows.repartition("token", "deal"), percent)
    first = "min(struct(-common AS rare, xxhash64(class_id) AS h, class_id, n, place)) OVER (PARTITION BY token, deal) AS first"
    rows = rows.selectExpr("*", first)
    groups = steps.write(rows.select("token", "deal", F.struct("class_id", "n", "place").alias("row"), "first"), "prefixes")
    steps.drop("near")
    drop_shuffles(spark)
    leader = F.struct("first.class_id", "first.n", "first.place").alias("leader")
    cold, hot = groups.where("deal IS NULL").select("token", "row", leader), groups.where("deal IS NOT NULL")
    leaders = hot.groupBy("token").agg(F.count("*").alias("classes"), F.min("first").alias("first")).where("classes > 1")
    led = dealt_join(hot.select("token", "row"), leaders, ["token"], hot_keys(leaders, ["token"], "classes", hot.count(), HOT_TOKEN), F.col("row.class_id"))
    return cold, steps.write(led.select("token", "row", leader, "classes"), "hot")


def _counted(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (a, b) of classes that share enough shingles of their prefixes, from one row for each such shingle."""
    need = F.greatest(F.lit(1), F.expr(f"least({a}.n, {b}.n) div 50"))
    low, high = F.least(F.col(f"{a}.class_id"), F.col(f"{b}.class_id")), F.greatest(F.col(f"{a}.class_id"), F.col(f"{b}.class_id"))
    pairs = rows.select(low.alias("a"), high.alias("b"), need.alias("need")).groupBy("a", "b").agg(F.count("*").alias("common"), F.max("need").alias("need"))
    return pairs.where("common >= need").select("a", "b")


def _labelled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    rows = groups.withColumn("class_id", F.col("row.class_id")).join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    return rows.withColumn("label", F.coalesce("label", "class_id"))


def _between(cold: DataFrame, hot: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Rows (row, other) of one shingle and different components that the filters allow.

    Only `other`, a class outside the component of the shingle's leader, is matched with the whole shingle; shingles
    whose classes are all in one component, as those of near copies are, give nothing.
    """
    other = [F.col("row").alias("other"), F.col("label").alias("other_label")]
    apart = (F.col("label") != F.col("other_label")) & ((F.col("label") == F.col("led")) | (F.col("row.class_id") < F.col("other.class_id")))

    def sketched(rows: DataFrame) -> DataFrame:
        """Rows of mixed shingles only carry the sketches of their classes."""
        joined = rows.withColumn("class_id", F.col("row.class_id")).join(sketches.drop("n"), "class_id")
        return joined.withColumn("row", F.struct("row.*", *_PARITY_COLUMNS)).drop("class_id", *_PARITY_COLUMNS)

    led = "max(CASE WHEN class_id = leader.class_id THEN label END) OVER (PARTITION BY token) AS led"
    rows = _labelled(cold, labels).repartition("token").selectExpr("token", "row", "label", led)
    rows = sketched(rows.selectExpr("*", "max(label <> led) OVER (PARTITION BY token) AS mixed").where("mixed").drop("mixed"))
    apart = apart & _possible("row", "other", percent) & _suffix("row", "other", percent)
    pairs = rows.join(rows.where("label <> led").select("token", *other), "token").where(apart).select("row", "other")
    if hot.isEmpty():
        return pairs
    rows = _labelled(hot, labels)
    leaders = rows.where("class_id = leader.class_id").select("token", "classes", F.col("label").alias("led"))
    keys = hot_keys(leaders, ["token"], "classes", hot.count(), HOT_TOKEN)
    rows = dealt_join(rows.select("token", "row", "label", "class_id"), leaders.drop("classes"), ["token"], keys, F.col("class_id"))
    rows = sketched(rows).withColumn("class_id", F.col("row.class_id"))
    more = dealt_join(rows, rows.where("label <> led").select("token", *other), ["token"], keys, F.col("class_id"))
    return pairs.unionByName(more.where(apart).select("row", "other"))


def join_classes(docs: DataFrame, sketches: DataFrame, table: np.ndarray, width: int, percent: int) -> DataFrame:
    """(node, label): the component of each class that links with a class of a smaller number."""
    spark, steps = docs.sparkSession, Steps(docs.sparkSession, "jaccard")
    cold, hot = _prefix_groups(docs, table, width, percent, steps)

    def linked(rows: DataFrame, other: str, name: str) -> DataFrame:
        """The links among the pairs (row, other): counted, held to their sketches, verified; each step goes with the next."""
        drop_shuffles(spark)
        pairs = steps.write(_counted(rows, "row", other), f"{name}-counted")
        drop_shuffles(spark)
        possible = steps.write(_suffix_filtered(pairs, sketches, percent), f"{name}-possible")
        steps.drop(f"{name}-counted")
        found = steps.write(_verified(possible, docs, width, percent), f"{name}-links")
        steps.drop(f"{name}-possible")
        drop_shuffles(spark)
        return found

    led = cold.unionByName(hot.drop("classes")).where("row.class_id <> leader.class_id").where(_possible("row", "leader", percent))
    links = linked(led, "leader", "stars")
    own = sketches.drop("wide").dropDuplicates(["class_id"])
    more = linked(_between(cold, hot, components(links, steps.folder), own, percent), "other", "between")
    labels = components(links.unionByName(more))
    steps.drop()
    return labels


def _linked(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Size and class of each of `rows` with its numbers, and (node, label) of the classes that link with others."""
    numbers, bits = [c for c in rows.columns if c != "text"], table_bits(rows)
    schema = "".join(f"{c} long, " for c in numbers) + "n_shingles long, class_id long, p0 long, p1 long, p2 long, p3 long, wide binary, block int, counts binary"
    profile = written(rows.mapInArrow(_profile(width, numbers, bits), schema), "profile")
    sketches = profile.where("class_id IS NOT NULL").select("class_id", F.col("n_shingles").alias("n"), *_PARITY_COLUMNS, "wide")
    labels = join_classes(rows.where("doc_id IS NOT NULL"), sketches, _rank_table(profile, bits), width, percent)
    return profile.where("block IS NULL").select(*numbers, "n_shingles", "class_id"), labels


def _with_least(documents: DataFrame, labels: DataFrame, value: Column) -> DataFrame:
    """`documents` with a set, and the least `value` of their `component`; a class of many copies is dealt over tasks."""
    members = documents.where("class_id IS NOT NULL")
    classes = members.groupBy("class_id").agg(F.min(value).alias("least_id"), F.count("*").alias("copies"))
    classes = written(classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("label", F.coalesce("label", "class_id")), "classes")
    least = classes.groupBy("label").agg(F.min("least_id").alias("component"), F.count("*").alias("members"))
    total = members.count()
    found = dealt_join(classes.select("class_id", "label"), least.drop("members"), ["label"], hot_keys(least, ["label"], "members", total, HOT_COPIES), F.col("class_id"))
    return dealt_join(members, found.select("class_id", "component"), ["class_id"], hot_keys(classes, ["class_id"], "copies", total, HOT_COPIES), value)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of its group) and class_id of every row."""
    documents, labels = _linked(T.id_and_text(docs), width, percent)
    linked = _with_least(documents, labels, F.col("doc_id"))
    alone = documents.where("class_id IS NULL").withColumn("component", F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", component.alias("component_id"), "class_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group only, of the smallest id; all columns stay.

    Rows are told apart by id and text, so texts under a repeated id are judged each by its own group. Of rows
    that repeat both, one stays, the same one whatever the partitions. Rows without an id or without words stay.
    """
    text_key = F.xxhash64(F.col("text").cast("string"))
    documents, labels = _linked(T.id_and_text(docs, text_key.alias("text_key")), width, percent)
    judged = _with_least(documents.where("doc_id IS NOT NULL"), labels, F.struct("doc_id", "text_key"))
    stays = F.struct("doc_id", "text_key") == F.col("component")
    rows = judged.groupBy("doc_id", "text_key").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("copies"))
    found = written(rows.where("NOT stays OR copies > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "stays", "copies"), "judged")

    # A document's columns travel as one, so that their names can't clash with the keys.
    named = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    keyed = docs.where(named).select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), text_key.alias("_text"))
    total = found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot, spread = hot_keys(found, ["_id", "_text"], "copies", total, HOT_COPIES), F.monotonically_increasing_id()
    kept = dealt_join(keyed, found.select("_id", "_text"), ["_id", "_text"], hot, spread, "left_anti").select("doc.*")
    if not found.where("stays").isEmpty():
        repeated = dealt_join(keyed, found.where("stays").select("_id", "_text"), ["_id", "_text"], hot, spread)
        # Rows that repeat id and text may differ elsewhere: the one of the least hash stays, wherever it lies.
        chosen = repeated.groupBy("_id", "_text").agg(F.min_by("doc", F.struct(F.xxhash64(F.to_json("doc")), F.to_json("doc"))).alias("doc"))
        kept = kept.unionByName(chosen.select("doc.*"))
    return docs.where(~named).unionByName(kept)
