"""Geometry as column arithmetic: points are three columns, matrices are row-major array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


def columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def mat3_apply(m: Column, p: Point) -> list[Column]:
    return [m[3 * r] * p[0] + m[3 * r + 1] * p[1] + m[3 * r + 2] * p[2] for r in range(3)]


def mat3_apply_transposed(m: Column, p: Point) -> list[Column]:
    """For a rotation, the inverse."""
    return [m[r] * p[0] + m[3 + r] * p[1] + m[6 + r] * p[2] for r in range(3)]


def mat4_apply(m: Column, p: Point) -> list[Column]:
    """Homogeneous transform with division by w; NULL where w is 0."""
    x, y, z, w = (m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(4))
    return [F.try_divide(c, w) for c in (x, y, z)]


def inverse3(m: Column) -> list[Column]:
    """The nine entries of the inverse, by cofactors; NULL if the matrix is singular."""
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    cofactors = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return [F.try_divide(x, det) for x in cofactors]


def inverse_pose(h: Column) -> Column:
    """World-to-camera rows of a camera-to-world pose, as an array of 12 (three rows of four)."""
    inner = inverse3(F.array(*(h[4 * r + c] for r in range(3) for c in range(3))))
    rows = []
    for r in range(3):
        rows += [*inner[3 * r : 3 * r + 3], -(inner[3 * r] * h[3] + inner[3 * r + 1] * h[7] + inner[3 * r + 2] * h[11])]
    return F.array(*rows)


def idx_to_world(idx: Point, vox_size: Column, rot: Column, origin: Column) -> list[Column]:
    """Centre of a cell."""
    turned = mat3_apply(rot, [(c + 0.5) * vox_size for c in idx])
    return [t + origin[k] for k, t in enumerate(turned)]


def world_to_idx(p: Point, vox_size: Column, rot: Column, origin: Column) -> list[Column]:
    """Cell that holds a point."""
    local = mat3_apply_transposed(rot, [(c - origin[k]) / vox_size for k, c in enumerate(p)])
    return [F.floor(c).cast("int") for c in local]


def idx_to_world_matrix(vox_size: Column, rot: Column, origin: Column) -> Column:
    """4x4 matrix from index to world, without the half-cell offset."""
    out = []
    for r in range(3):
        out += [rot[3 * r + c] * vox_size for c in range(3)] + [origin[r]]
    return F.array(*out, *(F.lit(float(x)) for x in (0, 0, 0, 1)))


def to_camera(p: Point, view: Column) -> list[Column]:
    return [view[4 * r] * p[0] + view[4 * r + 1] * p[1] + view[4 * r + 2] * p[2] + view[4 * r + 3] for r in range(3)]


def project(p: Point, k: Column, world_to_camera: Column) -> list[Column]:
    """(u, v, z) of a world point; u and v are NULL where z is 0. Points behind the camera are projected too."""
    u, v, z = mat3_apply(k, to_camera(p, world_to_camera))
    return [F.try_divide(u, z), F.try_divide(v, z), z]


def unproject_camera(u: Column, v: Column, depth: Column, k: Column) -> list[Column]:
    """Pixel and depth to camera space, for intrinsics without skew."""
    return [(u - k[2]) * depth / k[0], (v - k[5]) * depth / k[4], depth]


def camera_to_world(p: Point, h: Column) -> list[Column]:
    return [h[4 * r] * p[0] + h[4 * r + 1] * p[1] + h[4 * r + 2] * p[2] + h[4 * r + 3] for r in range(3)]


def rotate_to_world(n: Point, h: Column) -> list[Column]:
    """A direction by the pose's rotation alone."""
    return [h[4 * r] * n[0] + h[4 * r + 1] * n[1] + h[4 * r + 2] * n[2] for r in range(3)]


def cross(a: Point, b: Point) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(p: Point) -> Column:
    return F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])


def unit(p: Point) -> list[Column]:
    """NULL for a vector of length 0."""
    return [F.try_divide(c, norm(p)) for c in p]


def ray_length(p: Point) -> Column:
    """Length of the ray to a point given in millimetres, in metres."""
    return norm(p) / 1000


def snapped(c: Column) -> Column:
    """Nearest pixel, halves to even; NULL instead of numbers that are no pixel anywhere."""
    r = F.rint(c)
    return F.when(F.abs(r) < 1e9, r.cast("int"))


def inside_image(u: Column, v: Column, w: Column, h: Column) -> Column:
    return (u >= 0) & (v >= 0) & (u < w) & (v < h)


def in_bounds(idx: Point, shape: Point) -> Column:
    out = F.lit(True)
    for c, n in zip(idx, shape, strict=True):
        out = out & (c >= 0) & (c < n)
    return out


def truncate(d: Column, mu: float) -> Column:
    return F.least(F.greatest(d, F.lit(-mu)), F.lit(mu))


def block_frame(p: Point, n: Point, shape: Sequence[int], size: float, relative_centre: Sequence[float], tall: bool, tall_height: float | None = None) -> tuple[Column, Column]:
    """Rotation (its columns are up x n, up x that, up) and origin of an upright block at a surface point.

    A tall block stands on z = 0: its centre and its anchor share the height. NULL where n is parallel to up.
    """
    flat = F.sqrt(n[0] * n[0] + n[1] * n[1])
    a, b = F.try_divide(F.lit(0.0) - n[1], flat), F.try_divide(n[0], flat)
    zero, one = F.lit(0.0), F.lit(1.0)
    rot = F.array(a, zero - b, zero, b, a, zero, zero, zero, one)
    centre = [float(s * size * c) for s, c in zip(shape, relative_centre, strict=True)]
    height = p[2]
    if tall:
        centre[2] = float(tall_height)
        height = F.lit(centre[2])
    origin = F.array(p[0] - (a * centre[0] - b * centre[1]), p[1] - (b * centre[0] + a * centre[1]), height - F.lit(centre[2]))
    known = flat > 0
    return F.when(known, rot), F.when(known, origin)


def scaled_intrinsics(k: Column, scale: float) -> Column:
    """Intrinsics of the image resized by `scale`; the last row stays."""
    return F.transform(k, lambda x, i: F.when(i.isin(0, 2, 4, 5), x * scale).otherwise(x))


def intrinsics(fx: float, fy: float, cx: float, cy: float) -> Column:
    return F.array(*(F.lit(float(x)) for x in (fx, 0, cx, 0, fy, cy, 0, 0, 1)))


def focal_length(pixels: Column, extent: Column, depth: Column) -> Column:
    """Focal length in pixels of something `extent` wide at `depth` that covers `pixels`."""
    return F.try_divide(pixels * depth, extent)


def upright_footprint(i: Column, j: Column, shape: Point) -> Column:
    return (i >= 0) & (j >= 0) & (i < shape[0]) & (j < shape[1])
