"""Every registered query against its SQL in DuckDB, and against itself with other partitions."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.queries() if entry.queries()[n].__module__.startswith("voxelloom.plans"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = Path(SF, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == ordered(tuple(map(plain, r)) for r in result.fetchall())
    assert got


@pytest.mark.parametrize("name", ["v9_train_forest", "w6_voxel_normals", "v7_ring_samples", "v14_greedy_accept"])
def test_same_rows_whatever_the_partitions(spark, name):
    q = entry.queries()[name]
    first = ordered(tuple(map(plain, r)) for r in q(spark, SF).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert ordered(tuple(map(plain, r)) for r in q(spark, SF).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_scores_every_scene(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= (r["iou"] or 0) <= 1 for r in rows)
