import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelloom.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, rank int, shard long"


def brute(rows, is_query, k):
    use = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, e in {(i, tuple(e)) for i, e in use if is_query(i)}:
        scores = sorted((-int(np.dot(c[: len(e)], e[: len(c)])), i) for i, c in use if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, is_query, k=5, **kw):
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k.search(df, is_query(F.col("vec_id")), k, **kw).collect()))


@pytest.mark.parametrize(("shard_rows", "query_rows", "centre"), [(8192, 1024, 0.0), (70, 3, 0.0), (64, 5, 0.3)])
def test_equals_brute_force(spark, shard_rows, query_rows, centre):
    rng = np.random.default_rng(shard_rows)
    rows = [(int(i), (rng.standard_normal(24) * 0.1 + centre).astype(np.float32).tolist()) for i in rng.permutation(600)]
    assert found(spark, rows, lambda i: i % 20 == 0, shard_rows=shard_rows, query_rows=query_rows) == brute(rows, lambda i: i % 20 == 0, 5)


def test_edges(spark):
    half = [0.5, 0.0, -0.25]
    rows = [(50, half), (50, half), (1, half), (1, half), (2, half), (3, None), (4, [0.1, None, 1.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (None, half), (7, []), (8, [9.0]), (100, [0.0, 0.0, 0.0]), (150, [-1.0, 2.0])]
    for k, shard_rows in ((5, 8192), (2, 1), (50, 2)):
        assert found(spark, rows, lambda i: i % 50 == 0, k, shard_rows=shard_rows, query_rows=1) == brute(rows, lambda i: i % 50 == 0, k)
    assert found(spark, [], lambda i: i % 50 == 0) == []
    assert found(spark, [(50, half)], lambda i: i % 50 == 0) == []


def test_many_copies_stay_out_of_the_shards(spark):
    rng = random.Random(2)
    rows = [(i, [0.25, 0.5]) for i in range(1, 400)] + [(7, [0.25, 0.5])] * 400 + [(i, [rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2)]) for i in range(400, 500)]
    assert found(spark, rows, lambda i: i % 50 == 0, shard_rows=100) == brute(rows, lambda i: i % 50 == 0, 5)
    vectors = top_k.whole_vectors(spark.createDataFrame([(i, v, 3, 4) for i, v in rows], SCHEMA))
    assert vectors.count() == 499 and vectors.where("vec_id = 7").first()["copies"] == 401


def test_reading_stops_on_proof():
    rng = np.random.default_rng(5)
    values = (rng.standard_normal((4000, 32)) * 30).astype(np.int64)
    shard = top_k.Shard.build(np.arange(4000), np.ones(4000, np.int64), values)
    for q in range(20):
        scores = values @ values[q]
        kth = np.sort(scores[np.arange(4000) != q])[-5]
        possible = shard.possible(values[q], -math.inf, q, 5)
        assert set(np.flatnonzero(scores >= kth)) - {q} <= set(possible) and len(possible) < 3000
        assert set(np.flatnonzero(scores >= kth)) - {q} <= set(shard.possible(values[q], float(kth), q, 5))


def test_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="32 bits"):
        found(spark, [(50, [1e30]), (1, [1.0])], lambda i: i % 50 == 0)
