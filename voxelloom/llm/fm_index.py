"""Benchmark decontamination with an FM-index over each shard of training words.

A task turns its texts into word numbers of the benchmark's vocabulary. Words outside it can't be in any
window, so they only separate runs, and runs shorter than the shortest window are left out. When enough
runs are gathered (`shard_words`), the shard is indexed: suffix order by prefix doubling, its BWT in a wavelet tree
stored level by level, and text positions sampled along the runs. All windows are searched backwards at
once, their last words first; the rows found are followed to sampled positions, and the hits of each
document merge into spans. Nothing is shuffled.

A window is `width` consecutive words of an item; an item with fewer words, but not none, is one window.
Words are runs of ASCII letters and digits (lower-cased) and non-ASCII characters. Null texts have no
words; null items are left out; equal item ids count once. One row per row, repeated ids too.

The benchmark is the query set: its windows are broadcast. Its text is measured first, and beyond `max_query_bytes`
(8 MB, some 120 MB of windows) the items are cut into blocks that are searched one after the other, with the same rows.

Ties don't arise: every item with an occurring window counts. An empty table gives no rows, an empty benchmark no hits;
only doc_id and text are read, so other columns' names don't matter. A text is one part of a shard whatever its length:
its words take some 60 bytes each there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import _text as T

WIDTH = 13
SHARD_WORDS = 1 << 20
SAMPLE_EVERY = 8
MAX_QUERY_BYTES = 8 << 20
#: Bytes of rows that `drop_contaminated` holds until they are judged.
HELD_BYTES = 16 << 20

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
_SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:int,end:int,words:int>>"


class WaveletTree:
    """rank(symbol, i): occurrences of a symbol before position i. Levels hold one bit of every symbol, high bit first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((bit, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            high = np.where(one, zeros + before[high], high - before[high])
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, place, low = np.zeros(len(at), np.int64), at.astype(np.int64), np.zeros(len(at), np.int64)
        for bit, before, zeros in self.levels:
            one = before[place + 1] > before[place]
            symbol |= one.astype(np.int64) << bit
            low = np.where(one, zeros + before[low], low - before[low])
            place = np.where(one, zeros + before[place], place - before[place])
        return symbol, place - low


def suffix_order(words: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """Positions by their suffixes; run ends (`is_end`) sort before all words, among themselves by place."""
    n = len(words)
    rank = np.where(is_end, np.cumsum(is_end) - 1, words.astype(np.int64) + int(is_end.sum()))
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        follow[is_end] = 0
        key = rank * (n + int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if int(new[order[-1]]) == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Index of runs of words (numbers from 1); every run ends with a 0."""

    def __init__(self, words: np.ndarray, n_words: int, every: int = SAMPLE_EVERY):
        is_end = words == 0
        self.order = suffix_order(words, is_end)
        bwt = words[self.order - 1]
        self.tree = WaveletTree(bwt, n_words + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=n_words + 1))])
        # Positions are kept for every so many words and at the start of each run, so that no walk crosses a run's end.
        starts = np.empty(len(words), bool)
        starts[0], starts[1:] = True, is_end[:-1]
        kept = (np.arange(len(words)) % every == 0) | starts
        self.sampled = kept[self.order]
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = self.order[self.sampled]
        del self.order

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last row of each window; `windows` holds the words right-aligned."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.sampled), np.int64)
        for k in range(windows.shape[1]):
            live = np.flatnonzero((low < high) & (k < lengths))
            if not len(live):
                break
            word = windows[live, windows.shape[1] - 1 - k]
            low[live] = self.first[word] + self.tree.rank(word, low[live])
            high[live] = self.first[word] + self.tree.rank(word, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        at, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[at[live]]
            hit = live[done]
            out[hit] = self.positions[self.before[at[hit]]] + walked[hit]
            live = live[~done]
            if len(live):
                word, rank = self.tree.access(at[live])
                at[live] = self.first[word] + rank
                walked[live] += 1
        return out


@dataclass(frozen=True)
class Queries:
    """Sorted hashes of the benchmark's words (word k has number k + 1), its windows, and the items of each."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray
    item_cuts: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, str]], width: int) -> Queries:
        """Arrays all the way: a window takes 4 * (width + 2) bytes and its item, a word 8."""
        texts = pa.array([text for _, text in items], pa.string())
        own = np.array([item for item, _ in items], np.int64)
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for chunk in T.chunks(texts):
            starts, ends = T.word_bounds(chunk, T.ALNUM)
            hashes.append(T.word_hashes(chunk, starts, ends, lower=True))
            owners.append(chunk.row_of(starts) + chunk.first)
        words, row = np.concatenate(hashes), np.concatenate(owners)
        vocabulary, number = np.unique(words, return_inverse=True)
        number = (number + 1).astype(np.int32)
        # Windows of whole width, then the items with fewer words, right-aligned.
        n = np.bincount(row, minlength=len(items))
        first = np.cumsum(n) - n
        table, owner, lengths = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(number) >= width:
            whole = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
            table.append(np.lib.stride_tricks.sliding_window_view(number, width)[whole])
            owner.append(row[whole])
            lengths.append(np.full(len(whole), width))
        for item in np.flatnonzero((n > 0) & (n < width)).tolist():
            line = np.zeros((1, width), np.int32)
            line[0, width - n[item] :] = number[first[item] : first[item] + n[item]]
            table.append(line)
            owner.append(np.array([item]))
            lengths.append(np.array([n[item]]))
        found, at = np.unique(np.concatenate(table), axis=0, return_inverse=True)
        size = np.zeros(len(found), np.int64)
        size[at.ravel()] = np.concatenate(lengths)
        pairs = np.unique(np.stack([at.ravel(), own[np.concatenate(owner)]], 1), axis=0)
        return Queries(vocabulary, found, size, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(found) + 1)))


@dataclass
class _Shard:
    """Rows waiting for their index, and the runs of benchmark words in them."""

    docs: list = field(default_factory=list)
    n_words: list = field(default_factory=list)
    words: list = field(default_factory=list)  # numbers, a 0 after each run
    rows: list = field(default_factory=list)
    starts: list = field(default_factory=list)  # of each word, in characters of its document
    ends: list = field(default_factory=list)
    size: int = 0

    def add(self, chunk: T.Chunk, docs: list, q: Queries) -> None:
        starts, ends = T.word_bounds(chunk, T.ALNUM)
        rows = chunk.row_of(starts)
        self.n_words.append(np.bincount(rows, minlength=chunk.rows))
        first_row = len(self.docs)
        self.docs += docs
        if not len(starts) or not len(q.vocabulary):
            return
        hashes = T.word_hashes(chunk, starts, ends, lower=True)
        at = np.minimum(np.searchsorted(q.vocabulary, hashes), len(q.vocabulary) - 1)
        number = np.where(q.vocabulary[at] == hashes, at + 1, 0)
        known = number > 0
        edge = np.ones(len(known) + 1, bool)
        edge[1:-1] = (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])
        cuts = np.flatnonzero(edge)
        size = np.diff(cuts)
        long = known[cuts[:-1]] & (size >= int(q.lengths.min()))
        if not long.any():
            return
        run_starts, sizes = cuts[:-1][long], size[long]
        ends_at = np.cumsum(sizes)
        index = np.arange(ends_at[-1]) + np.repeat(run_starts - (ends_at - sizes), sizes)
        points = T.code_points(chunk.data)
        base = points[chunk.offsets[rows[index]]]
        self.words.append(np.insert(number[index], ends_at, 0))
        self.rows.append(np.insert(rows[index] + first_row, ends_at, -1))
        self.starts.append(np.insert(points[starts[index]] - base, ends_at, 0))
        self.ends.append(np.insert(points[ends[index]] - base, ends_at, 0))
        self.size += len(self.words[-1])

    def result(self, q: Queries) -> pa.RecordBatch:
        n = len(self.docs)
        n_hit, items, spans = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
        if self.size:
            words, rows, starts, ends = (np.concatenate(x) for x in (self.words, self.rows, self.starts, self.ends))
            index = FMIndex(words, len(q.vocabulary))
            low, high = index.search(q.windows, q.lengths)
            counts = high - low
            window = np.repeat(np.arange(len(counts)), counts)
            found = index.locate(np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts))
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, found, 1)
            np.add.at(change, found + q.lengths[window], -1)
            hit = np.cumsum(change[:-1]) > 0
            n_hit = np.bincount(rows[hit], minlength=n)
            pairs = np.unique(np.stack([rows[found], window], 1), axis=0)
            for row, w in pairs.tolist():
                items[row] += q.item_of[q.item_cuts[w] : q.item_cuts[w + 1]].tolist()
            cut = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            for a, b in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
                spans[rows[a]].append({"start": int(starts[a]), "end": int(ends[b - 1]), "words": b - a})
        columns = [
            pa.array(self.docs, pa.int64()),
            pa.array(np.concatenate(self.n_words).astype(np.int64)),
            pa.array(n_hit.astype(np.int64)),
            pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())),
            pa.array(spans, _SPANS),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "item_ids", "spans"])


def _search(queries, shard_words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, shard = queries.value, _Shard()
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for chunk in T.chunks(batch["text"]):
                shard.add(chunk, ids[chunk.first : chunk.first + chunk.rows], q)
                if shard.size >= shard_words or len(shard.docs) >= 50_000:
                    yield shard.result(q)
                    shard = _Shard()
        if shard.docs:
            yield shard.result(q)

    return T.tidy(task)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of several blocks, side by side in arrays, to one."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            spans: list[dict] = []
            text = row["text"] or ""
            for span in sorted((s for block in row["all_spans"] for s in block), key=lambda s: (s["start"], s["end"])):
                if spans and span["start"] < spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], span["end"])
                else:
                    spans.append(dict(span))
            for span in spans:
                piece = T.Chunk(np.frombuffer(text[span["start"] : span["end"]].encode(), np.uint8), np.zeros(0, np.int64), 0)
                piece.offsets = np.array([0, len(piece.data)])
                span["words"] = len(T.word_bounds(piece, T.ALNUM)[0])
            out.append({"doc_id": row["doc_id"], "n_words": row["n_words"], "n_hit": sum(s["words"] for s in spans), "item_ids": sorted({i for x in row["all_items"] for i in x}), "spans": spans})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", _SPANS)]))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()


def _blocks(items: DataFrame, max_query_bytes: int) -> int:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-total // max_query_bytes) or 1


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted numbers) and removal spans (characters, end exclusive) of every row."""
    spark = docs.sparkSession
    items = _items(benchmark)
    blocks = _blocks(items, max_query_bytes)
    rows = T.id_and_text(docs)
    if blocks == 1:
        shared = spark.sparkContext.broadcast(Queries.of([tuple(r) for r in items.collect()], width))
        return rows.mapInArrow(_search(shared, shard_words), _SCHEMA)
    # One pass a block over the same rows, which a key tells apart even where ids repeat.
    keyed = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    found = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Queries.of([tuple(r) for r in block.collect()], width))
        own = keyed.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text").mapInArrow(_search(shared, shard_words), _SCHEMA)
        found = own if found is None else found.unionByName(own)
    merged = found.groupBy(F.col("doc_id").alias("key")).agg(F.first("n_words").alias("n_words"), F.collect_list("item_ids").alias("all_items"), F.collect_list("spans").alias("all_spans"))
    whole = keyed.withColumn("key", F.xxhash64("doc_id", "text")).join(merged, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return whole.select("doc_id", "text", "n_words", "all_items", "all_spans").mapInArrow(_merge, _SCHEMA)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def _drop(queries):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, held, shard, size = queries.value, [], _Shard(), 0

        def judged() -> Iterator[pa.RecordBatch]:
            found, at = shard.result(q), 0
            n_hit, n_words = found["n_hit"].to_numpy(), found["n_words"].to_numpy()
            keep = pa.array((n_hit == 0) | (20 * n_hit < n_words))
            for batch in held:
                yield batch.filter(keep.slice(at, batch.num_rows))
                at += batch.num_rows

        for batch in batches:
            for chunk in T.chunks(batch.column(batch.schema.get_field_index("text")).cast(pa.string())):
                shard.add(chunk, [None] * chunk.rows, q)
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from judged()
                held, shard, size = [], _Shard(), 0
        if held:
            yield from judged()

    return T.tidy(task)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """`docs` without the rows that are contaminated; all their columns stay. Each row is judged by its own text.

    Rows are filtered where they are read, so null, repeated and clashing ids don't matter and nothing is shuffled. Where
    the benchmark takes several blocks, whose hits add up, texts are told apart by hash.
    """
    items = _items(benchmark)
    if _blocks(items, max_query_bytes) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(Queries.of([tuple(r) for r in items.collect()], width))
        return T.light_batches(docs).mapInArrow(_drop(shared), docs.schema)
    key = F.xxhash64(F.col("text").cast("string"))
    found = find_contamination(docs.select(key.alias("doc_id"), "text"), benchmark, width, max_query_bytes=max_query_bytes)
    bad = found.where(contaminated()).select(F.col("doc_id").alias("_bad")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), key.alias("_key"))
    return rows.join(bad, rows["_key"] == bad["_bad"], "left_anti").select("doc.*")
