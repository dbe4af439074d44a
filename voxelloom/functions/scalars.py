"""Scalar rules: decoding, weights, fill policies."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def decode_depth(raw: Column, scaling: Column | float) -> Column:
    """16-bit raster value to depth; 0 is unknown."""
    return F.when(raw != 0, raw * scaling / 65536.0)


def decode_depth_tenth_mm(raw: Column) -> Column:
    return F.when(raw != 0, raw / 10000.0)


def known(c: Column) -> Column:
    """NaN to NULL, which is how the tables store unknown."""
    return F.when(~F.isnan(c), c)


def confidence(min_dist: Column, rate: float) -> Column:
    return F.exp(-rate * min_dist)


def mask_weight(mask: Column, predicted: Column) -> Column:
    """1 - mask, halved where the prediction is empty."""
    return (1 - mask) * F.when(predicted > 0, F.lit(0.5)).otherwise(1.0)


def fill_array(values: Column, constant: float) -> Column:
    return F.transform(values, lambda x: F.coalesce(x, F.lit(constant)))


def unknown_mask(values: Column) -> Column:
    return F.transform(values, lambda x: x.isNull().cast("int"))


def fill_with_scene_max(v: Column, scene: str) -> Column:
    """The policy used when transforming; `fill_array` with mu is the one used when fitting."""
    return F.coalesce(v, F.max(v).over(Window.partitionBy(scene)))


def binarised(v: Column) -> Column:
    return F.when(v > 0, 1.0).when(v.isNotNull(), 0.0)


def with_ground(v: Column, k: Column, ground: Column, mu: float) -> Column:
    """Solid below the ground index, empty at it."""
    return F.when(k < ground, -mu).when(k == ground, mu).otherwise(v)


def floor_height(folder: Column) -> Column:
    return F.when(folder.endswith("_0/"), 5).when(folder.endswith("_1/") | folder.endswith("_2/"), 7).otherwise(0)


def in_decimation(p: int, *idx: Column) -> Column:
    out = F.lit(True)
    for c in idx:
        out = out & (c % p == 0)
    return out


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the key only, so on no partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / float(1 << 52)


def lcg(key: Column, seed: int, modulus: int = 1_000_003) -> Column:
    """A congruential hash that SQL engines share, as an integer below the modulus."""
    return F.pmod(key * 48_271 + F.lit(seed * 16_807 + 11), F.lit(modulus))
