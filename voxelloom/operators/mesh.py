"""Meshes as tables: vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, v0, v1, v2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import geometry as G
from voxelloom.operators import tiles as L

_XYZ = ("x", "y", "z")


def centred(vertices: DataFrame) -> DataFrame:
    mean = vertices.groupBy("mesh_id").agg(*(F.avg(c).alias(f"m{c}") for c in _XYZ))
    return vertices.join(mean, "mesh_id").select("mesh_id", "vid", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in _XYZ))


def scaled(vertices: DataFrame, factor: float) -> DataFrame:
    return vertices.withColumns({c: F.col(c) * factor for c in _XYZ})


def extents(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("mesh_id").agg(*((F.max(c) - F.min(c)).alias(f"range_{c}") for c in _XYZ))


def transformed(vertices: DataFrame, m) -> DataFrame:
    """4x4 transform (an array column) with division by w."""
    return vertices.select("mesh_id", "vid", *(c.alias(n) for c, n in zip(G.mat4_apply(m, G.columns(*_XYZ)), _XYZ, strict=True)))


def corner_points(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    out = faces
    for n in range(3):
        v = vertices.select("mesh_id", F.col("vid").alias(f"v{n}"), *(F.col(c).alias(f"{c}{n}") for c in _XYZ))
        out = out.join(v, ["mesh_id", f"v{n}"])
    return out


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit normals of faces, summed at each of their vertices and made unit again."""
    p = corner_points(vertices, faces)
    side = lambda n: [F.col(f"{c}{n}") - F.col(f"{c}0") for c in _XYZ]
    normal = G.unit(G.cross(side(1), side(2)))
    flat = p.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *(c.alias(n) for c, n in zip(normal, ("nx", "ny", "nz"), strict=True)))
    sums = flat.groupBy("mesh_id", "vid").agg(*(F.sum(n).alias(n) for n in ("nx", "ny", "nz")))
    return sums.select("mesh_id", "vid", *(c.alias(n) for c, n in zip(G.unit(G.columns("nx", "ny", "nz")), ("nx", "ny", "nz"), strict=True)))


def without_unknown_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces none of whose vertices is unknown."""
    bad = vertices.where("x IS NULL OR y IS NULL OR z IS NULL").select("mesh_id", "vid")
    touched = faces.select("mesh_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).join(bad, ["mesh_id", "vid"], "left_semi").select("mesh_id", "fid").distinct()
    return faces.join(touched, ["mesh_id", "fid"], "left_anti")


# The six tetrahedra of a cell around its main diagonal, by corner (di, dj, dk).
_TETRAHEDRA = [[(0, 0, 0), a, tuple(x + y for x, y in zip(a, b, strict=True)), (1, 1, 1)] for a in ((1, 0, 0), (0, 1, 0), (0, 0, 1)) for b in ((1, 0, 0), (0, 1, 0), (0, 0, 1)) if a != b]


def crossed_cubes(voxels: DataFrame, level: float, tile: int = L.TILE) -> DataFrame:
    """(scene_id, i, j, k, c0 to c7): the cubes between a cell and its seven upper neighbours, all known, that the level surface
    crosses, with the corners' values less the level.

    A cell is a row of its tile, and of those below that need it as an upper neighbour; tiles are arrays, some in a call.
    """
    scene, wide = voxels.schema["scene_id"].dataType.simpleString(), tile + 1
    cells = voxels.where("v IS NOT NULL").select("scene_id", "i", "j", "k", (F.col("v").cast("double") - level).alias("v"))
    for a, b in zip("ijk", L.BOX[1:], strict=True):
        cells = cells.select("*", F.explode(F.sequence(F.floor((F.col(a) - 1) / tile).cast("int"), F.floor(F.col(a) / tile).cast("int"))).alias(b))
    held = [F.col(a) - F.col(b) * tile for a, b in zip("ijk", L.BOX[1:], strict=True)]
    rows = cells.select(*L.BOX, ((held[0] * wide + held[1]) * wide + held[2]).cast("int").alias("lin"), "v", F.xxhash64(*L.BOX).alias("run"))
    ordered = rows.repartition(*L.BOX).sortWithinPartitions("run", *L.BOX)
    corners = np.array([(a * wide + b) * wide + c for a in (0, 1) for b in (0, 1) for c in (0, 1)])

    def found(batch: pa.RecordBatch, of: np.ndarray, n: int) -> pa.RecordBatch:
        lin, v = batch["lin"].to_numpy(), batch["v"].to_numpy()
        vals = np.full(n * wide**3, np.nan)
        vals[of * wide**3 + lin] = v
        place = np.stack([lin // (wide * wide), lin // wide % wide, lin % wide])
        base = np.flatnonzero((place < tile).all(0))
        near = vals[(of[base] * wide**3 + lin[base])[:, None] + corners]
        crossed = (near.min(1) < 0) & (near.max(1) >= 0)  # not so with an unknown corner
        base, near = base[crossed], near[crossed]
        own = batch.take(pa.array(base))
        ijk = [own[b].to_numpy() * tile + x.astype(np.int32) for b, x in zip(L.BOX[1:], place[:, base], strict=True)]
        return pa.RecordBatch.from_arrays([own["scene_id"], *(pa.array(x.astype(np.int32)) for x in ijk), *(pa.array(np.ascontiguousarray(c)) for c in near.T)], ["scene_id", *"ijk", *(f"c{n}" for n in range(8))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in L.whole_runs(batches):
            starts = L.runs(*(batch[c].to_numpy(zero_copy_only=False) for c in L.BOX))
            ends = np.append(starts[1:], batch.num_rows)
            for first in range(0, len(starts), L.SOME_TILES):
                own, end = starts[first : first + L.SOME_TILES], ends[first : first + L.SOME_TILES]
                yield found(batch.slice(own[0], end[-1] - own[0]), np.repeat(np.arange(len(own)), end - own), len(own))

    return ordered.mapInArrow(task, f"scene_id {scene}, i int, j int, k int, " + ", ".join(f"c{n} double" for n in range(8)))


def iso_triangles(voxels: DataFrame, grids: DataFrame, level: float = 0.0) -> DataFrame:
    """Triangles of the level surface by marching tetrahedra: scene_id and three world points.

    Each cell joins its seven upper neighbours; a tetrahedron with one corner on its own side of the level gives a
    triangle, with two a quadrilateral, cut in two. Corners of unknown cells give none. Grids are shuffled, not broadcast, and
    meet cubes, of which there are fewer than triangles.
    """
    cubes = crossed_cubes(voxels, level).join(grids.select("scene_id", F.struct("vox_size", "rot", "origin").alias("grid")).hint("merge"), "scene_id")
    points = lambda t: F.array(*(F.struct(F.col(f"c{a * 4 + b * 2 + c}").alias("v"), (F.col("i") + a).cast("double").alias("x"), (F.col("j") + b).cast("double").alias("y"), (F.col("k") + c).cast("double").alias("z")) for a, b, c in t))
    tetra = cubes.select("scene_id", "grid", F.explode(F.array(*(points(t) for t in _TETRAHEDRA))).alias("t"))
    split = tetra.select("scene_id", "grid", F.filter("t", lambda p: p.v < 0).alias("neg"), F.filter("t", lambda p: p.v >= 0).alias("pos")).where(F.size("neg").between(1, 3))

    def cut(p, q):
        t = p.v / (p.v - q.v)
        return F.struct(*((p[c] + t * (q[c] - p[c])).alias(c) for c in _XYZ))

    # Crossed edges (negative corner, positive corner) of each triangle, by the number of negative corners.
    cases = {1: [[(0, 0), (0, 1), (0, 2)]], 2: [[(0, 0), (0, 1), (1, 1)], [(0, 0), (1, 1), (1, 0)]], 3: [[(0, 0), (1, 0), (2, 0)]]}
    literal = {n: F.expr("array(" + ", ".join("array(" + ", ".join(f"struct({a} AS n, {b} AS p)" for a, b in tri) + ")" for tri in tris) + ")") for n, tris in cases.items()}
    edges = F.when(F.size("neg") == 1, literal[1]).when(F.size("neg") == 2, literal[2]).otherwise(literal[3])
    each = split.select("scene_id", "grid", "neg", "pos", F.explode(edges).alias("edges"))
    placed = each.select("scene_id", "grid", F.transform("edges", lambda e: cut(F.get("neg", e.n), F.get("pos", e.p))).alias("tri"))
    world = lambda q: G.idx_to_world([q[c] for c in _XYZ], F.col("grid.vox_size"), F.col("grid.rot"), F.col("grid.origin"))
    out = [c.alias(f"{name}{k}") for k in range(3) for c, name in zip(world(F.col("tri")[k]), _XYZ, strict=True)]
    return placed.select("scene_id", *out)


def indexed(triangles: DataFrame, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """Vertex and face tables of triangles: equal points (to `digits` places) are one vertex, named by its hash."""
    keyed = triangles.select(F.col("scene_id").alias("mesh_id"), F.xxhash64(*triangles.columns).alias("fid"), *(F.struct(*(F.round(f"{c}{k}", digits).alias(c) for c in _XYZ)).alias(f"p{k}") for k in range(3)))
    faces = keyed.select("mesh_id", "fid", *(F.xxhash64(f"p{k}.x", f"p{k}.y", f"p{k}.z").alias(f"v{k}") for k in range(3)))
    points = keyed.select("mesh_id", F.explode(F.array("p0", "p1", "p2")).alias("p"))
    return points.select("mesh_id", F.xxhash64("p.x", "p.y", "p.z").alias("vid"), "p.x", "p.y", "p.z").distinct(), faces
