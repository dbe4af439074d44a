"""Scores of predicted grids and the tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.grid import CELL


def confusion(prediction: DataFrame, truth: DataFrame, region: DataFrame, mu: float, keys: list[str] | None = None) -> DataFrame:
    """Counts and IoU, precision, recall by `keys` over the region.

    Solid is v < 0. Unknown truth is solid, unknown prediction empty. IoU of two empty sets is NULL, precision and
    recall without a denominator are 0.
    """
    keys = keys or ["scene_id"]
    truth_values = truth.select(*CELL, F.coalesce("v", F.lit(-mu)).alias("t"))
    predicted = prediction.select(*dict.fromkeys([*keys, *CELL]), F.coalesce("v", F.lit(mu)).alias("p"))
    tests = prediction.select(*keys).distinct()
    wanted = region.select(*CELL).join(tests, "scene_id").join(truth_values, CELL)
    joined = wanted.join(predicted, list(dict.fromkeys([*keys, *CELL])), "left").withColumn("p", F.coalesce("p", F.lit(mu)))
    return _counted(joined, keys)


def confusion_within(prediction: DataFrame, truth: DataFrame, mu: float, keys: list[str] | None = None) -> DataFrame:
    """`confusion` where the rows of the prediction are the region, so that only the truth is joined."""
    truth_values = truth.select(*CELL, F.coalesce("v", F.lit(-mu)).alias("t"))
    joined = prediction.withColumn("p", F.coalesce("v", F.lit(mu))).join(truth_values, CELL)
    return _counted(joined, keys or ["scene_id"])


def _counted(joined: DataFrame, keys: list[str]) -> DataFrame:
    p, t = F.col("p") < 0, F.col("t") < 0
    counts = joined.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select("*", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def mean_scores(scores: DataFrame, n_scenes: int) -> DataFrame:
    """Means a test; NULL unless all `n_scenes` scenes have a score."""
    means = scores.groupBy("test").agg(F.count("iou").alias("n"), *(F.avg(c).alias(c) for c in ("iou", "precision", "recall")))
    whole = F.col("n") >= n_scenes
    return means.select("test", "n", *(F.when(whole, F.col(c)).alias(c) for c in ("iou", "precision", "recall")))


def rankings(scores: DataFrame, baseline: str) -> DataFrame:
    """Rank of each scene by IoU in its test, and the ratio to the baseline test's IoU on that scene."""
    ranked = scores.where("iou IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("test").orderBy(F.desc("iou"), "scene_id")))
    base = scores.where(F.col("test") == baseline).select("scene_id", F.col("iou").alias("base_iou"))
    return ranked.join(base, "scene_id", "left").select("test", "scene_id", "iou", "rank", F.try_divide(F.col("iou"), F.col("base_iou")).alias("ratio"))


def with_external(scores: DataFrame, external: DataFrame, scenes: DataFrame, name: str) -> DataFrame:
    """All results, with an external baseline's; scenes it lacks have NULL scores."""
    other = scenes.join(external, "scene_id", "left").withColumn("test", F.lit(name))
    return scores.unionByName(other, allowMissingColumns=True)


def usage_counts(predictions: DataFrame) -> DataFrame:
    """How often a training example was used by each model."""
    return predictions.groupBy("model", "medoid_id").agg(F.count("*").alias("n"))


def empty_fraction(values: str, level: float = 0.0):
    """Share of an array's values above `level`."""
    return F.size(F.filter(values, lambda x: x > level)) / F.size(values)


def l2_difference(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def histogram(values: DataFrame, column: str, bins: int = 100, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts in equal bins from `low` to `high` (the data's own ends if not given), the last bin closed."""
    v = F.col(column).cast("double")
    ends = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi")) if low is None else values.sparkSession.range(1).select(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    placed = values.where(v.isNotNull()).join(F.broadcast(ends))  # one row
    at = F.coalesce(F.least(F.floor(F.try_divide((v - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1)), F.lit(0))
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
