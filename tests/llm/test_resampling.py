import hashlib
import math
import random
import zlib

import pytest
from voxelloom.llm import resampling as R

from tests.llm import helpers as H

NAMES = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def features(text, max_n=2):
    words = H.ALNUM_WORDS.findall(H.lowered(text))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=25, least=20, buckets=10_000, max_n=2):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for table, texts in ((s, [x for _, x, _ in docs]), (t, target)):
        for text in texts:
            for f in features(text, max_n)[1]:
                table[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc, text, _ in docs:
        words, own = features(text, max_n)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=lambda t: [(x is not None, x) for x in t])


def documents(n, seed=3):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "été", "東京", "x9", "a-b", "Kİ", "don't", "_u_"]
    return [(i, rnd.choice([" ", "\n", ", "]).join(rnd.choices(words, k=rnd.randint(0, 60))), 7) for i in range(n)]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_equals_plain_python(spark, max_n):
    docs = documents(500) + H.edge_rows()
    target = [t for _, t, _ in documents(20, 9)] + [None, ""]
    got = R.resample(spark.createDataFrame(docs, "doc_id long, text string, rank long"), spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), max_n=max_n)
    assert H.rows(got, *NAMES) == brute(docs, target, max_n=max_n)


def test_slices_join(monkeypatch):
    text = documents(1, 5)[0][1] * 3 + " " * 50 + "tail end of it"
    want = sorted(zlib.crc32(f.encode()) for f in features(text, 3)[1])
    for size in (1, 7, 40, 10_000):
        monkeypatch.setattr(R, "SLICE_BYTES", size)
        parts = list(R.feature_hashes(text.encode(), 3))
        assert sorted(h for _, hs in parts for h in hs) == want and sum(n for n, _ in parts) == len(features(text)[0])


def test_copies_of_one_row_are_ranked_apart(spark):
    docs = documents(200) + [(500, "the same words again " * 8, 1)] * 300
    got = R.resample(spark.createDataFrame(docs, "doc_id long, text string, x int").repartition(7), spark.createDataFrame([("the same words",)], "text string"))
    assert H.rows(got, *NAMES) == brute(docs, ["the same words"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert R.resample(H.empty_docs(spark), none).count() == 0
    docs = documents(30)
    assert H.rows(R.resample(spark.createDataFrame(docs, "doc_id long, text string, x int"), none), *NAMES) == brute(docs, [])
