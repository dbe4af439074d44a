"""Exact top-k search by inner product over an impact-ordered index, read score at a time.

Vectors are whole numbers, floor(scale * x). The index deals them over shards of about SHARD_ROWS rows. In a shard every dimension
has its postings (row numbers) in segments of one quantised impact, `value >> shift`, ordered by impact, with the least and the
greatest value in each segment. What a segment can add to a query's score is at most its weight in that dimension times the
better of these two, so for positive weights segments are read from the high end of a dimension and for negative ones from the low end.

A query's segments are processed by descending contribution, twice as many postings each round. After a round a row's score is at most
the contributions of its segments read so far plus, in every dimension where its own hasn't come up, that of the best segment left
there. Rows whose bound is below the k-th best score known can't be in the answer; that is the only reason to leave a row out.
Reading stops when these proofs leave fewer rows than it would pay to read on for, and all that are left are rescored exactly on
whole vectors. When it stops is a matter of cost only. Bounds are sums of whole numbers in doubles, with room for their rounding.

1. Each query first meets its own shard, which gives it a k-th best score to start from elsewhere.
2. Then it meets all other shards. Queries are dealt over parts of about QUERY_ROWS, so that a task holds one shard and
   reads queries one batch at a time: the stated query set against all rows, in blocks, with neither side whole anywhere.
3. Each shard sends at most k rows a query, only those no worse than the known score; the best k are kept.

Rows that repeat id and vector are one entry with a count, made before they are dealt out, so copies can't fill a shard; each
copy counts in the answer. A query's own rows are those of its id. Repeated query rows ask once; different vectors under
one id each ask for themselves. Ties go to the smaller id. Vectors that are null or hold null or non-finite components, and rows
without an id, take no part; shorter vectors count as filled up with zeros. Fewer than k other rows are all returned, an
empty table gives no row. Scaled components from 2**31 on, and scores that might not fit 64 bits, raise an error. Only vec_id and
embedding are read, so other columns' names don't matter. The index and the first answers are written to the shared
folder before they are read, so a lost executor can't deal rows anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm._text import light_batches, tidy
from voxelloom.llm.storage import written

SHARD_ROWS, QUERY_ROWS = 8192, 1024
#: Impacts keep so many bits below the sign.
IMPACT_BITS = 6
_INDEX = "shard long, n int, dims int, ids binary, copies binary, vectors binary, postings binary, segments binary"
_FOUND = "query_id long, query_key long, own long, vec_id long, copies long, score long"


class Shard:
    """Some vectors with their postings: `segments` has a row of dimension, begin, end, least and greatest value for each."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, postings: np.ndarray, segments: np.ndarray):
        self.ids, self.copies, self.vectors, self.postings = ids, copies, vectors, postings
        self.dim, self.begin, self.end, self.least, self.most = segments.T

    @classmethod
    def build(cls, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> Shard:
        largest = int(np.abs(vectors).max(initial=0))
        shift = max(0, largest.bit_length() - IMPACT_BITS)
        n, postings, segments = len(ids), [np.zeros(0, np.int32)], []
        for d in range(vectors.shape[1]):
            column = vectors[:, d]
            order = np.argsort(column, kind="stable")
            impact = column[order] >> shift
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(impact)) + 1, [n]])
            postings.append(order.astype(np.int32))
            segments += [(d, d * n + a, d * n + b, column[order[a]], column[order[b - 1]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return cls(ids, copies, vectors, np.concatenate(postings), np.array(segments, np.int64).reshape(-1, 5))

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.vectors[rows, : len(query)].astype(np.int64) @ query

    def possible(self, query: np.ndarray, known: float, own_id: int, k: int) -> np.ndarray:
        """Rows that may be among the k best and reach `known`; all others are proven not to."""
        n, weight = len(self.ids), np.zeros(self.vectors.shape[1], np.int64)
        weight[: len(query)] = query
        use = np.flatnonzero(weight[self.dim])
        w = weight[self.dim[use]]
        gain = np.maximum(w * self.least[use], w * self.most[use]).astype(np.float64)
        order = np.argsort(-gain, kind="stable")
        size = (self.end - self.begin)[use]
        total = np.cumsum(size[order])
        room = 1e-12 * np.abs(gain).sum() + 1e-9
        others, read, target = self.ids != own_id, 0, 2 * n
        bound = np.full(n, np.inf)
        while read < len(order):
            read = min(len(order), int(np.searchsorted(total, target)) + 1)
            left = order[read:][::-1]
            best_left = np.zeros(len(weight))
            best_left[self.dim[use[left]]] = gain[left]  # a dimension's best segment comes last and stays
            segments = np.sort(order[:read])
            at = use[segments]
            runs = np.flatnonzero(np.concatenate([[True], self.begin[at][1:] != self.end[at][:-1]]))
            last = np.concatenate([runs[1:], [len(at)]]) - 1
            rows = np.concatenate([self.postings[a:b] for a, b in zip(self.begin[at[runs]].tolist(), self.end[at[last]].tolist(), strict=True)])
            more = np.repeat(gain[segments] - best_left[self.dim[at]], size[segments])
            bound = best_left.sum() + np.bincount(rows, more, n)
            if known == -math.inf and others.sum() >= k:  # k real scores, to prove against
                first = np.flatnonzero(others)
                first = first[np.argpartition(-bound[first], k - 1)[:k]]
                known = float(self.exact(first, query).min())
            able = int(((bound >= known - room) & others).sum())
            target = 2 * int(total[read - 1])
            if able * len(query) <= min(target, int(total[-1])) - int(total[read - 1]):
                break
        return np.flatnonzero((bound >= known - room) & others)

    def best(self, query: np.ndarray, known: float, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows by score, then by id, of those that reach `known`."""
        query = query[: self.vectors.shape[1]]
        rows = self.possible(query, known, own_id, k)
        scores = self.exact(rows, query)
        keep = scores >= known
        rows, scores = rows[keep], scores[keep]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (floor of the scaled components) and copies of each distinct row that takes part."""

    def scaled(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < 2**31, F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component is beyond 32 bits")).cast("long"))

    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return own.select("vec_id", F.transform("embedding", scaled).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def _build(table: pa.Table) -> pa.Table:
    lists = table["v"].combine_chunks()
    offsets = lists.offsets.to_numpy()
    sizes, n = np.diff(offsets), len(lists)
    vectors = np.zeros((n, int(sizes.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(n), sizes)
    vectors[rows, np.arange(offsets[0], offsets[-1]) - offsets[rows]] = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    shard = Shard.build(table["vec_id"].to_numpy(), table["copies"].to_numpy(), vectors)
    segments = np.stack([shard.dim, shard.begin, shard.end, shard.least, shard.most], 1)
    parts = [shard.ids.astype("<i8"), shard.copies.astype("<i8"), vectors.astype("<i4"), shard.postings.astype("<i4"), segments.astype("<i8")]
    row = [[table["shard"][0].as_py()], [n], [vectors.shape[1]], *([x.tobytes()] for x in parts)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.table([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["shard", "n", "dims", "ids", "copies", "vectors", "postings", "segments"])


def shard_of(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards))


def build_index(vectors: DataFrame, n_shards: int) -> DataFrame:
    """A row for each shard of `whole_vectors`."""
    light_batches(vectors)
    return vectors.withColumn("shard", shard_of(n_shards)).groupBy("shard").applyInArrow(_build, _INDEX)


def _searched(k: int):
    """Rows of one (shard, part) follow each other, the shard's own row first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, limit = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if not batch["is_query"][i].as_py():
                    n, dims = batch["n"][i].as_py(), batch["dims"][i].as_py()
                    read = lambda name, kind: np.frombuffer(batch[name][i].as_py(), kind)  # noqa: B023, E731
                    shard = Shard(read("ids", "<i8"), read("copies", "<i8"), read("vectors", "<i4").reshape(n, dims), read("postings", "<i4"), read("segments", "<i8").reshape(-1, 5))
                    now = batch["shard"][i].as_py()
                    limit = int(np.abs(shard.vectors.astype(np.int64)).max(initial=0)) * max(1, dims)
                    continue
                query = np.array(batch["q"][i].as_py(), np.int64)
                if limit * int(np.abs(query).max(initial=0)) >= 2**63:
                    raise OverflowError("scores might not fit 64 bits")
                if now != batch["shard"][i].as_py():
                    continue  # no row fell to this shard
                known = batch["known"][i].as_py()
                rows, scores = shard.best(query, -math.inf if known is None else known, batch["query_id"][i].as_py(), k)
                head = tuple(batch[c][i].as_py() for c in ("query_id", "query_key", "own"))
                out += [(*head, int(shard.ids[r]), int(shard.copies[r]), int(s)) for r, s in zip(rows, scores, strict=True)]
            columns = [pa.array([r[c] for r in out], pa.int64()) for c in range(6)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_key", "own", "vec_id", "copies", "score"])

    return tidy(task)


def _meet(index: DataFrame, queries: DataFrame, n_parts: int, k: int) -> DataFrame:
    """Answers of each query (query_id, query_key, own, q, known) in the shard that its row names."""
    part = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part")
    shards = index.select("*", part).withColumn("is_query", F.lit(False))
    asked = queries.withColumn("part", F.pmod("query_key", F.lit(n_parts)).cast("int")).withColumn("is_query", F.lit(True))
    rows = shards.unionByName(asked, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", "is_query")
    return rows.mapInArrow(_searched(k), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row for which `is_query` (a condition on vec_id) holds."""
    vectors = written(whole_vectors(rows, scale), "vectors")
    sizes = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    n_shards, n_parts = (max(1, -(-n // each)) for n, each in zip(sizes, (shard_rows, query_rows), strict=True))
    index = written(build_index(vectors, n_shards), "index")
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("v", F.lit(n_shards)).alias("query_key"), shard_of(n_shards).alias("own"), F.col("v").alias("q"))

    first = written(_meet(index, queries.select("*", F.col("own").alias("shard"), F.lit(None).cast("double").alias("known")), n_parts, k), "found")
    known = _ranked(first, k).where(F.col("rank") == k).select("query_id", "query_key", F.col("score").cast("double").alias("known"))
    elsewhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard")
    asked = queries.join(known, ["query_id", "query_key"], "left").select("*", elsewhere).where("shard <> own")
    found = first.unionByName(_meet(index, asked, n_parts, k)) if n_shards > 1 else first
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
