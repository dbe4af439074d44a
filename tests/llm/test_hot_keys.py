"""The ways for hot keys give the same rows as the plain ones, with limits low enough for small tables."""

import random

import pytest
from pyspark.sql import functions as F
from voxelloom.llm import components, jaccard, skew

from tests.llm import helpers as H
from tests.llm.test_jaccard import brute, copies, found


@pytest.fixture
def low_limits(monkeypatch):
    for name in ("HOT_TOKEN", "HOT_CLASS", "HOT_COPIES"):
        monkeypatch.setattr(jaccard, name, 2)
    monkeypatch.setattr(components, "HOT_NODE", 2)


def test_hot_shingles_classes_and_copies(spark, low_limits):
    table = copies(70, 40, 9) + [(500 + k, "one text that very many rows repeat word for word") for k in range(40)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert found(df, 3, 80) == brute(table, 3, 80)


def test_keep_one_with_hot_rows(spark, low_limits):
    text = "a text of some words that is said again and again"
    table = [(1, text)] * 5 + [(2, text)] * 4 + [(None, text)] * 3 + [(1, "another text under the same id with other words")] * 3 + [(3, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(*r, 7, 8) for r in table], "doc_id long, text string, piece int, _id int")
    got = H.rows(jaccard.keep_one(df), "doc_id", "text")
    want = [(1, text), (1, "another text under the same id with other words"), (3, None), (3, ""), (3, "")] + [(None, text)] * 3
    assert got == sorted(want, key=lambda t: [(x is not None, x) for x in t])


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_NODE", 3)
    rnd = random.Random(2)
    edges = [(0, k) for k in range(1, 40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(45)] + [(7, 7), (None, 3), (5, None)]
    label = {n: n for e in edges if None not in e for n in e}
    for _ in label:
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: m for n, m in label.items() if n != m}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dealt_join_is_a_join(spark):
    rows = spark.createDataFrame([(k % 4 if k % 9 else None, k) for k in range(200)], "key long, n long")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "key long, name string")
    hot = skew.hot_keys(rows.groupBy("key").agg(F.count("*").alias("c")), ["key"], "c", 200, 10)
    for how in ("inner", "left", "left_anti"):
        got = skew.dealt_join(rows, table, ["key"], hot, F.col("n"), how)
        want = rows.join(table, "key", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
