"""Joins whose keys may hold any share of the rows.

A key with more than `least` rows, and more than one in MAX_HOT of all rows, is hot; there can be at most
MAX_HOT of these, so their list is small enough to broadcast whatever the input. Rows of a hot key are dealt
over pieces by another column, and the one row of the other side is copied to each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT = 10_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int, least: int) -> DataFrame:
    """Keys of `counts` (one row a key, `n` rows each) that are hot, and the `pieces` that each is dealt over."""
    limit = max(least, -(-total // MAX_HOT))
    return counts.where(F.col(n) > limit).select(*keys, (F.col(n) / limit + 1).cast("int").alias("pieces"))


def dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, by: Column, how: str = "inner") -> DataFrame:
    """`rows` joined with `table`, which has one row for each of `keys` and no other column of theirs in common.

    `by` says which piece of a hot key a row is in. Null keys match nothing, as in any join. Without hot keys (`hot` is
    None) it is a plain join, which can keep the way that `table` is already dealt over tasks.
    """
    if hot is None:
        return rows.join(table, keys, how)
    shared = F.broadcast(hot)
    left = rows.join(shared, keys, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64(by), F.col("pieces")).cast("int"), F.lit(0))).drop("pieces")
    right = table.join(shared, keys, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1))).drop("pieces")
    return left.join(right, [*keys, "piece"], how).drop("piece")


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, by: Column) -> DataFrame:
    """`dealt_join` for a `table` of wide rows that is dealt by `keys` already: only what hot keys have is dealt anew."""
    if hot is None:
        return rows.join(table, keys)
    shared = F.broadcast(hot)
    cold = rows.join(shared, keys, "left_anti").join(table, keys)
    # An inner join stays above what made the table, so that both ways read one shuffle of it.
    return cold.unionByName(dealt_join(rows.join(shared, keys, "left_semi"), table.join(shared.select(*keys), keys), keys, hot, by))
