"""PCA, the structured forest and nearest neighbours, as Spark jobs with small array helpers."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.store import written
from voxelloom.operators.tiles import lists, runs

#: Rows of a partial product that travel together.
BAND = 256

NODES = "model string, tree_id int, node_id long, is_leaf boolean, dim int, thresh double, impurity double, num_exs long, medoid_id long"


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _mean(rows: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Mean of the vectors and their number: a task adds its rows, only sums are shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + _vectors(batch[column], len(batch[column][0])).sum(0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], ["dim", "total", "n"])

    sums = rows.select(column).mapInArrow(task, "dim int, total double, n long").groupBy("dim").agg((F.sum("total") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    stats = sums.orderBy("dim").toPandas()
    return stats["m"].to_numpy(float), int(stats["n"].iloc[0])


def fit_pca(rows: DataFrame, column: str, components: int, oversample: int = 10, rounds: int = 2, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading components (rows) by a randomized range finder.

    The rows stay distributed: each round every partition of them makes one (dims x (components + oversample)) matrix, whose
    bands of BAND rows are shuffled and added band by band; the driver holds one matrix of that size. Signs are fixed by
    each component's largest loading.
    """
    mean, n = _mean(rows, column)
    size = min(components + oversample, len(mean), n)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(mean), size)))[0]

    def product(q: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast((mean, q))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, b = shared.value
            total = np.zeros((len(m), b.shape[1]))
            for batch in batches:
                centred = _vectors(batch[column], len(m)) - m
                total += centred.T @ (centred @ b)
            bands = range(0, len(m), BAND)
            yield pa.RecordBatch.from_arrays([pa.array(bands, pa.int32()), pa.array([total[k : k + BAND].tobytes() for k in bands], pa.binary())], ["band", "total"])

        def add(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for pdf in it:
                for band, raw in zip(pdf["band"], pdf["total"], strict=True):
                    sums[band] = sums.get(band, 0) + np.frombuffer(raw)
            yield pd.DataFrame({"band": list(sums), "total": [x.tobytes() for x in sums.values()]})

        parts = rows.select(column).mapInArrow(partial, "band int, total binary").repartition("band").mapInPandas(add, "band int, total binary")
        out = np.zeros((len(mean), q.shape[1]))
        for r in parts.collect():
            out[r["band"] : r["band"] + BAND] += np.frombuffer(r["total"]).reshape(-1, q.shape[1])
        return out

    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    found = (basis @ vectors[:, np.argsort(-values)[:components]]).T
    signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(1)])
    return mean, found * signs[:, None]


def pca_table(spark, name: str, mean: np.ndarray, parts: np.ndarray) -> DataFrame:
    rows = [(name, -1, mean.tolist())] + [(name, k, v.tolist()) for k, v in enumerate(parts)]
    return spark.createDataFrame(rows, "model string, component int, vec array<double>")


def _mapped(rows: DataFrame, column: str, into: str, dims: int, f) -> DataFrame:
    schema = rows.select("*", F.array(F.lit(0.0)).alias(into)).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(f(_vectors(batch[column], dims)))], [*batch.schema.names, into])

    return rows.mapInArrow(task, schema)


def pca_transform(rows: DataFrame, column: str, into: str, mean: np.ndarray, parts: np.ndarray) -> DataFrame:
    """Equal vectors have equal codes to the last bit, wherever they stand in a batch; a matrix product doesn't promise that."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, parts))
    return _mapped(rows, column, into, len(mean), lambda x: np.einsum("nd,kd->nk", x - shared.value[0], shared.value[1]))


def pca_inverse(rows: DataFrame, column: str, into: str, mean: np.ndarray, parts: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((mean, parts))
    return _mapped(rows, column, into, len(parts), lambda x: x @ shared.value[1] + shared.value[0])


def medoid(y: np.ndarray, ids: np.ndarray) -> int:
    """Id of the row nearest to the mean, ties to the smallest id."""
    d = ((y - y.mean(0)) ** 2).sum(1)
    return int(ids[d <= d.min()].min())


def target_bits(y: np.ndarray, rng: np.random.Generator, dims: int, rows: int) -> np.ndarray:
    """Sign of the first principal component of some target dimensions, fitted on some rows."""
    some = y[:, rng.permutation(y.shape[1])[:dims]]
    fit = some[rng.permutation(len(some))[:rows]]
    centre = fit.mean(0)
    _, _, axes = np.linalg.svd(fit - centre, full_matrices=False)
    axis = axes[0] * np.sign(axes[0][np.abs(axes[0]).argmax()])
    return (some - centre) @ axis > 0


def gini(bits: np.ndarray) -> float:
    p = bits.mean() if len(bits) else 0.0
    return float(1 - p * p - (1 - p) ** 2)


def grow_tree(x: np.ndarray, y: np.ndarray, ids: np.ndarray, seed: int, tests: int, least: int, depth: int, pca_dims: int, pca_rows: int) -> list[tuple]:
    """Nodes of one tree, (id, is_leaf, dim, thresh, impurity, rows, medoid); the stack replaces recursion.

    A random test sends x[dim] < thresh to the right child 2n + 2. Of the tests that leave `least` rows on both sides the
    smallest weighted Gini impurity of the target bits wins, the first on ties.
    """
    rng = np.random.default_rng(seed)
    out, stack = [], [(0, np.arange(len(x)), 0.5, 0)]
    while stack:
        node, rows, impurity, medoid_id = stack.pop()
        best = None
        if node < 2**depth - 1 and impurity > 0 and len(rows) >= 2 * least:
            bits = target_bits(y[rows], rng, pca_dims, pca_rows)
            for start in range(0, tests, 256):
                dims = rng.integers(0, x.shape[1], min(256, tests - start))
                values = x[rows][:, dims]
                low, high = values.min(0), values.max(0)
                right = values < low + rng.random(len(dims)) * (high - low)
                n_right = right.sum(0)
                ok = (n_right >= least) & (len(rows) - n_right >= least)
                ones = (right & bits[:, None]).sum(0)
                p_r = ones / np.maximum(n_right, 1)
                p_l = (bits.sum() - ones) / np.maximum(len(rows) - n_right, 1)
                score = (n_right * 2 * p_r * (1 - p_r) + (len(rows) - n_right) * 2 * p_l * (1 - p_l)) / len(rows)
                score[~ok] = np.inf
                k = int(score.argmin())
                if np.isfinite(score[k]) and (best is None or score[k] < best[0]):
                    thresh = values[right[:, k], k].max()
                    above = values[~right[:, k], k].min()
                    best = (score[k], int(dims[k]), float((thresh + above) / 2), right[:, k], bits)
        if best is None:
            out.append((node, True, None, None, impurity, len(rows), medoid_id))
            continue
        _, dim, thresh, right, bits = best
        out.append((node, False, dim, thresh, impurity, len(rows), medoid_id))
        for child, own in ((2 * node + 1, ~right), (2 * node + 2, right)):
            stack.append((child, rows[own], gini(bits[own]), medoid(y[rows[own]], ids[rows[own]])))
    return sorted(out)


def train_forest(bags: DataFrame, model: str, seed: int = 1, tests: int = 200, least: int = 5, depth: int = 30, pca_dims: int = 100, pca_rows: int = 100) -> DataFrame:
    """One tree a task, from (tree_id, example_id, x, y); a bag is capped, so a task's rows are bounded."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("example_id")
        t = int(pdf["tree_id"].iloc[0])
        nodes = grow_tree(matrix(pdf["x"]), matrix(pdf["y"]), pdf["example_id"].to_numpy(), seed * 1000 + t, tests, least, depth, pca_dims, pca_rows)
        out = pd.DataFrame(nodes, columns=["node_id", "is_leaf", "dim", "thresh", "impurity", "num_exs", "medoid_id"])
        return out.assign(model=model, tree_id=t, dim=out["dim"].astype("Int32"))[["model", "tree_id", "node_id", "is_leaf", "dim", "thresh", "impurity", "num_exs", "medoid_id"]]

    return bags.select("tree_id", "example_id", "x", "y").groupBy("tree_id").applyInPandas(tree, NODES)


def apply_forest(rows: DataFrame, nodes: DataFrame, key: str, features: str, max_depth: int | None = None) -> DataFrame:
    """(key, tree_id, node_id, medoid_id): the leaf that each tree leads a row to.

    The nodes are broadcast: at most trees * 2 * bag / least of them, whatever the rows.
    """
    found = nodes.orderBy("tree_id", "node_id").toPandas()
    trees = {}
    for t, g in found.groupby("tree_id"):
        ids = g["node_id"].to_numpy(np.int64)  # in order, so a child's place is found by halving
        child = lambda n, ids=ids: np.minimum(np.searchsorted(ids, 2 * ids + n), len(ids) - 1)
        trees[int(t)] = (ids, child(1), child(2), g["is_leaf"].to_numpy(bool), g["dim"].fillna(0).to_numpy(int), g["thresh"].fillna(0).to_numpy(float), g["medoid_id"].to_numpy(int))
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    limit = max_depth if max_depth is not None else 1 << 30

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch[features], len(batch[features][0]) if batch.num_rows else 0)
            for t, (ids, left, right, leaf, dim, thresh, medoids) in shared.value.items():
                at, level = np.zeros(len(x), int), 0
                while len(x) and level < limit and not leaf[at].all():
                    go = x[np.arange(len(x)), dim[at]] < thresh[at]
                    at = np.where(leaf[at], at, np.where(go, right[at], left[at]))
                    level += 1
                yield pa.RecordBatch.from_arrays([batch[key], pa.array(np.full(len(x), t, np.int32)), pa.array(ids[at]), pa.array(medoids[at])], [key, "tree_id", "node_id", "medoid_id"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, features).mapInArrow(task, f"{key} {kind}, tree_id int, node_id long, medoid_id long")


def apply_forest_joins(rows: DataFrame, nodes: DataFrame, key: str, features: str, depth: int) -> DataFrame:
    """The same by `depth` joins on the node, for forests too large to broadcast."""
    n = nodes.select("tree_id", "node_id", "is_leaf", "dim", "thresh", "medoid_id")
    at = rows.select(key, F.col(features).alias("_x")).crossJoin(F.broadcast(n.where("node_id = 0").select("tree_id", "node_id")))  # one root a tree
    for _ in range(depth):
        step = at.join(n, ["tree_id", "node_id"])
        child = F.col("node_id") * 2 + F.when(F.get("_x", F.col("dim")) < F.col("thresh"), 2).otherwise(1)
        at = step.select(key, "_x", "tree_id", F.when(F.col("is_leaf"), F.col("node_id")).otherwise(child).alias("node_id"))
    return at.join(n, ["tree_id", "node_id"]).select(key, "tree_id", "node_id", "medoid_id")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf")


def measured(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """`nodes` with the rows that reach them, from (tree_id, node_id, bit), and the Gini impurity of their bits."""
    p = F.avg(F.col("bit").cast("double"))
    found = reached.groupBy("tree_id", "node_id").agg(F.count("*").alias("num_exs"), (1 - p * p - (1 - p) * (1 - p)).alias("impurity"))
    return nodes.drop("num_exs", "impurity").join(found, ["tree_id", "node_id"])


def importance(nodes: DataFrame) -> DataFrame:
    """Share of each dimension in the impurity removed, over nodes whose children both split; mean over trees."""
    n = nodes.select("tree_id", "node_id", "is_leaf", "dim", "impurity", "num_exs")
    loss = (F.col("impurity") * F.col("num_exs")).alias
    child = lambda name, k: n.where((F.col("node_id") > 0) & (F.col("node_id") % 2 == k % 2)).select("tree_id", F.floor((F.col("node_id") - k) / 2).alias("node_id"), F.col("is_leaf").alias(f"{name}_leaf"), loss(f"{name}_loss"))
    both = n.where("NOT is_leaf").join(child("l", 1), ["tree_id", "node_id"]).join(child("r", 2), ["tree_id", "node_id"]).where("NOT l_leaf AND NOT r_leaf")
    gain = both.groupBy("tree_id", "dim").agg(F.sum(F.col("impurity") * F.col("num_exs") - F.col("l_loss") - F.col("r_loss")).alias("gain"))
    share = gain.withColumn("share", F.try_divide("gain", F.sum("gain").over(Window.partitionBy("tree_id"))))
    trees = nodes.agg(F.count_distinct("tree_id").alias("trees"))
    return share.groupBy("dim").agg(F.sum("share").alias("total")).crossJoin(F.broadcast(trees)).select("dim", (F.col("total") / F.col("trees")).alias("importance"))  # one row


def split_scores(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Weighted Gini impurity of each test (test_id, dim, thresh) on rows (x, bit)."""
    each = rows.select("x", "bit").crossJoin(F.broadcast(tests))  # the tests are a stated, small set
    right = F.get("x", F.col("dim")) < F.col("thresh")
    c = each.groupBy("test_id").agg(F.count("*").alias("n"), F.count_if(right).alias("n_r"), F.count_if(right & F.col("bit")).alias("ones_r"), F.count_if(~right & F.col("bit")).alias("ones_l"))
    g = lambda ones, n: 1 - F.pow(F.try_divide(ones, n), 2) - F.pow(1 - F.try_divide(ones, n), 2)
    n_l = F.col("n") - F.col("n_r")
    score = (F.col("n_r") * F.coalesce(g(F.col("ones_r"), F.col("n_r")), F.lit(0.0)) + n_l * F.coalesce(g(F.col("ones_l"), n_l), F.lit(0.0))) / F.col("n")
    return c.select("test_id", "n", "n_r", score.alias("score"))


def group_medoids(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Row of each group nearest to its mean, ties to the smallest key."""
    long = rows.select(group, key, F.posexplode(vector).alias("d", "x"))
    means = long.groupBy(group, "d").agg(F.avg("x").alias("m"))
    dist = long.join(means, [group, "d"]).groupBy(group, key).agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("dist"))
    return dist.groupBy(group).agg(F.min_by(key, F.struct(F.round("dist", 9), key)).alias("medoid_id"))


def oob_r2(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """1 - residual / total sum of squares a tree, over rows (tree_id, example_id, pred) outside its bag."""
    p = predictions.select("tree_id", "example_id", F.posexplode("pred").alias("d", "p"))
    t = truth.select("example_id", F.posexplode("y").alias("d", "t"))
    j = p.join(t, ["example_id", "d"]).withColumn("m", F.avg("t").over(Window.partitionBy("tree_id", "d")))
    return j.groupBy("tree_id").agg((1 - F.try_divide(F.sum((F.col("p") - F.col("t")) ** 2), F.sum((F.col("t") - F.col("m")) ** 2))).alias("r2"))


#: Cells at most, whose boxes every task holds, and training rows for each of them while they are fewer; rows looked at for each
#: to find the planes between cells, and consecutive cells with a box round all of them.
MAX_PIVOTS, ROWS_A_PIVOT, ROWS_TO_SPLIT, CELLS_A_BOX = 4096, 512, 16, 64
_SLACK = 1e-9
#: Rows that tell whether boxes tell rows apart: not where more than this share of cells may hold a row as near.
FEW_ROWS, MOST_CELLS = 16, 0.8
#: Shelves, about, where there are many rows, so that a query travels at most so often; rows of a shelf at most; and pairs of a
#: shelf and a part of its queries, about, that tasks take, so that they are many whatever the number of shelves.
COPIES, MOST_ROWS, UNITS = 16, 400_000, 96


class Boxes:
    """Training rows by the cells of a k-d tree: how many there are and the box that they fill, and what that says of a query.

    The planes halve a sample in its widest direction; neighbouring cells have neighbouring numbers. `pivots` are the means of
    the sample's rows of each cell.
    """

    def __init__(self, sample: np.ndarray, wanted: int):
        nodes, leaves, heap = [], 0, [(-len(sample), 0, np.arange(len(sample)))]
        nodes.append(heap[0][2])
        self.dim, self.plane, self.low_child, self.high_child = [-1], [0.0], [0], [0]
        while heap and leaves + len(heap) < wanted:
            _, node, rows = heapq.heappop(heap)
            x = sample[rows]
            dim = int(x.var(0).argmax())
            plane = float(np.median(x[:, dim]))
            high = x[:, dim] > plane
            if not high.any():  # more than half are the largest
                below = x[x[:, dim] < plane, dim]
                if not len(below):
                    leaves += 1  # all rows are equal
                    continue
                plane = float(below.max())
                high = x[:, dim] > plane
            self.dim[node], self.plane[node] = dim, plane
            for side, children in ((~high, self.low_child), (high, self.high_child)):
                children[node] = len(nodes)
                heapq.heappush(heap, (-int(side.sum()), len(nodes), rows[side]))
                nodes.append(rows[side])
                for column, value in ((self.dim, -1), (self.plane, 0.0), (self.low_child, 0), (self.high_child, 0)):
                    column.append(value)
        self.dim, self.plane, self.low_child, self.high_child = (np.array(c) for c in (self.dim, self.plane, self.low_child, self.high_child))
        order, stack = [], [0]
        while stack:  # from low to high
            node = stack.pop()
            if self.dim[node] < 0:
                order.append(node)
            else:
                stack += [int(self.high_child[node]), int(self.low_child[node])]
        self.cell = np.full(len(nodes), -1)
        self.cell[order] = np.arange(len(order))
        self.pivots = np.stack([sample[nodes[k]].mean(0) for k in order])
        self.count = np.zeros(len(order), np.int64)
        self.low, self.high = np.full(self.pivots.shape, np.inf), np.full(self.pivots.shape, -np.inf)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell in which each row lies."""
        at = np.zeros(len(x), int)
        while len(x) and (self.dim[at] >= 0).any():
            dim = self.dim[at]
            at = np.where(dim < 0, at, np.where(x[np.arange(len(x)), dim] > self.plane[at], self.high_child[at], self.low_child[at]))
        return self.cell[at]

    @staticmethod
    def _square(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Square of how far each row is from each box, as boxes x rows."""
        square, below, above = (np.zeros((len(low), len(x))) for _ in range(3))
        for d, own in enumerate(np.ascontiguousarray(x.T)):
            np.subtract(low[:, d, None], own, out=below)
            np.subtract(own, high[:, d, None], out=above)
            np.maximum(below, above, out=below)
            np.maximum(below, 0, out=below)
            np.multiply(below, below, out=below)
            square += below
        return square

    def near(self, x: np.ndarray, limit: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """Whether each of the cells from `first` to `end` may hold a training row within `limit` of each row: not so where its box,
        or the one round its neighbours too, is farther, nor where it is empty. Where boxes hardly tell some rows apart, all may."""
        end = len(self.count) if end is None else end
        full, square = self.count[first:end] > 0, limit**2
        some = self._square(x[:FEW_ROWS], self.low[first:end], self.high[first:end]) <= square[:FEW_ROWS]
        asks = np.ones((end - first, len(x)), bool)
        if len(x) <= FEW_ROWS:
            asks = some
        elif not full.any() or some[full].mean() < MOST_CELLS:
            asks[:] = False
            for a in range(first, end, CELLS_A_BOX):
                own = slice(a, min(a + CELLS_A_BOX, end))
                row = np.flatnonzero(self._square(x, self.low[own].min(0)[None], self.high[own].max(0)[None])[0] <= square)
                for at in range(0, len(row), 256):
                    part = row[at : at + 256]
                    asks[a - first : own.stop - first, part] = self._square(x[part], self.low[own], self.high[own]) <= square[part]
        return (asks & full[:, None]).T

    def outside(self, x: np.ndarray, limit: np.ndarray, cell: int) -> np.ndarray:
        """Whether each row is farther than `limit` from one cell's box."""
        away = np.clip(x, self.low[cell], self.high[cell]) - x
        return np.einsum("nd,nd->n", away, away) > limit**2

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's own cell, and how near a training row of each cell can be at the least. Empty cells are infinitely far."""
        return self.home(x), np.sqrt(self._square(x, self.low, self.high)).T


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def voronoi(training: DataFrame, target: str, vector: str, rows_a_pivot: int = ROWS_A_PIVOT, max_pivots: int = MAX_PIVOTS) -> tuple[DataFrame, Boxes | None]:
    """`training` as (id, x, cell) with its cells' sizes and boxes; None where there are no rows.

    The planes between cells come from the training rows of some hashes, a bounded sample that only decides the cost: answers are exact.
    """
    rows = training.select(F.col(target).alias("id"), F.col(vector).alias("x"))
    n = rows.count()
    wanted = min(max_pivots, -(-n // rows_a_pivot))
    if not wanted:
        return rows, None
    one_in = max(1, n // (wanted * ROWS_TO_SPLIT))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("x").toArrow()["x"].combine_chunks() if one_in > 1 else None
    if some is None or len(some) < wanted:
        some = rows.select("x").limit(2 * wanted * ROWS_TO_SPLIT).toArrow()["x"].combine_chunks()
    cells = Boxes(_vectors(some, len(some[0])), wanted)
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    dims = cells.pivots.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], batch["x"], pa.array(shared.value.home(_vectors(batch["x"], dims)).astype(np.int32))], ["id", "x", "cell"])

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(len(shared.value.count), dims)
        for batch in batches:
            x, cell = _vectors(batch["x"], dims), batch["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            first = runs(cell[order])
            held.add(cell[order][first], np.diff(np.append(first, len(cell))), np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first))
        yield held.batch()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(len(shared.value.count), dims)
        for batch in batches:
            low, high = (np.frombuffer(b"".join(batch[c].to_pylist())).reshape(-1, dims) for c in ("low", "high"))
            for k, cell in enumerate(batch["cell"].to_numpy()):  # a cell comes once a task
                held.add(cell, batch["n"][k].as_py(), low[k], high[k])
        yield held.batch()

    placed = written(rows.mapInArrow(task, rows.select("*", F.lit(0).alias("cell")).schema))
    kind = "cell int, n long, low binary, high binary"
    for r in placed.select("x", "cell").mapInArrow(boxes, kind).repartition("cell").mapInArrow(added, kind).toLocalIterator():  # a row a cell
        cells.count[r["cell"]], cells.low[r["cell"]], cells.high[r["cell"]] = r["n"], np.frombuffer(r["low"]), np.frombuffer(r["high"])
    return placed, cells


class _Held:
    """How many rows some cells hold, and their boxes."""

    def __init__(self, n: int, dims: int):
        self.n, self.low, self.high = np.zeros(n, np.int64), np.full((n, dims), np.inf), np.full((n, dims), -np.inf)

    def add(self, cell, n, low: np.ndarray, high: np.ndarray) -> None:
        self.n[cell] += n
        self.low[cell], self.high[cell] = np.minimum(self.low[cell], low), np.maximum(self.high[cell], high)

    def batch(self) -> pa.RecordBatch:
        cell = np.flatnonzero(self.n)
        raw = [pa.array([v.tobytes() for v in x[cell]], pa.binary()) for x in (self.low, self.high)]
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(self.n[cell]), *raw], ["cell", "n", "low", "high"])


def _room(known: np.ndarray) -> np.ndarray:
    """A distance with room for its rounding."""
    return known * (1 + _SLACK) + 1e-6


def _asks(places: Boxes, part: pa.RecordBatch, own: bool) -> np.ndarray:
    """Whether each of some queries asks each cell: its own one, or every other that may hold a row as near as `known`."""
    x = _vectors(part["x"], places.pivots.shape[1])
    at_home = np.arange(len(places.count)) == places.home(x)[:, None]
    return at_home if own else places.near(x, _room(part["known"].fill_null(np.inf).to_numpy())) & ~at_home


def asked_cells(queries: DataFrame, cells: Boxes, own: bool) -> DataFrame:
    """(key, x, known, cell): each query in its own cell, or in every other cell that may hold a row as near as `known`."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, cell = np.nonzero(_asks(shared.value, part, own))
                some = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32))], [*some.schema.names, "cell"])

    return queries.mapInArrow(task, queries.select("*", F.lit(0).alias("cell")).schema)


def shelves(count: np.ndarray, max_rows: int) -> np.ndarray:
    """First cell of each shelf: consecutive cells of about `max_rows` rows together, a larger cell alone."""
    first, held = [0], 0
    for cell, n in enumerate(count.tolist()):
        if held and held + n > max_rows:
            first.append(cell)
            held = 0
        held += n
    return np.array(first)


def asked_shelves(queries: DataFrame, cells: Boxes, own: bool, first: np.ndarray) -> DataFrame:
    """(key, x, known, shelf, cells): each query in the shelf of its own cell, or once in every other shelf with a cell that may hold
    a row as near as `known`, and a bit for each cell of the shelf that is asked."""
    shared = queries.sparkSession.sparkContext.broadcast((cells, first))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, starts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _vectors(part["x"], places.pivots.shape[1])
                home = places.home(x)
                shelf_of = np.searchsorted(starts, home, "right") - 1
                known = None if own else _room(part["known"].fill_null(np.inf).to_numpy())
                for shelf, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(places.count)], strict=True)):
                    row = np.flatnonzero((shelf_of == shelf) == own)
                    if not len(row):
                        continue
                    bits = np.arange(a, b) == home[row, None] if own else places.near(x[row], known[row], a, b)
                    asks = bits.any(1)
                    row, bits = row[asks], bits[asks]
                    if len(row):
                        some = part.take(pa.array(row))
                        packed = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(row), shelf, np.int32)), packed], [*some.schema.names, "shelf", "cells"])

    return queries.mapInArrow(task, queries.select("*", F.lit(0).alias("shelf"), F.lit(b"").alias("cells")).schema)


class _Search:
    """The nearest rows of a shelf's cells to some queries, as far as they are found.

    Products of single precision, with a bound of their error, tell which rows can be as near as what is known; only for these
    exact distances are made, which alone decide.
    """

    def __init__(self, x: np.ndarray, known: np.ndarray, names: np.ndarray | None):
        self.x, self.known, self.names = x, known.copy(), names
        self.square, self.ids = np.full(len(x), np.inf), np.full(len(x), -1)
        self.rough = None

    def towards(self, centre: np.ndarray, top: float) -> None:
        """Prepares the products with rows whose differences from `centre` are at most `top` long."""
        own = self.x - centre
        self.length = (own**2).sum(1)
        far = np.sqrt(self.length) + top
        kind = np.float32 if 1e-10 < far.max(initial=1) < 1e15 else np.float64
        self.error = (own.shape[1] + 16) * float(np.finfo(kind).eps) * far**2
        self.rough = np.concatenate([-2 * own, np.ones((len(own), 1))], 1).astype(kind)

    def meet(self, rows: np.ndarray | None, ids: np.ndarray, data: np.ndarray, flat: np.ndarray) -> None:
        """Queries `rows`, or all, meet some training rows: `flat` are their differences from the centre and the squares of these."""
        for at in range(0, len(self.x) if rows is None else len(rows), 1024):
            some = slice(at, at + 1024) if rows is None else rows[at : at + 1024]
            rough = self.rough[some] @ flat.T
            if self.names is not None:
                rough[self.names[some][:, None] == ids[None, :]] = np.inf
            least = rough.min(1)
            limit = _room(self.known[some]) ** 2 - self.length[some] + 2 * self.error[some]
            open_rows = np.flatnonzero((least <= limit) & np.isfinite(least))
            if not len(open_rows):
                continue
            limit = np.minimum(limit[open_rows], least[open_rows] + 2 * self.error[some][open_rows])
            row, col = np.nonzero(rough[open_rows] <= limit[:, None])
            row = open_rows[row] + at if rows is None else some[open_rows[row]]
            d = ((data[col] - self.x[row]) ** 2).sum(1)
            order = np.lexsort((ids[col], d, row))
            found, first = np.unique(row[order], return_index=True)
            d, own = d[order[first]], ids[col[order[first]]]
            better = (d < self.square[found]) | ((d == self.square[found]) & (own < self.ids[found]))
            found, d = found[better], d[better]
            self.square[found], self.ids[found] = d, own[better]
            self.known[found] = np.minimum(self.known[found], np.sqrt(d))


class _Shelf:
    """Some rows of a shelf, by cell, as arrays."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        cell, ids, data = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(cell, kind="stable")
        cell, ids, data = cell[order], ids[order], data[order]
        self.centre = data.mean(0)
        own = data - self.centre
        length = (own**2).sum(1)
        self.top = float(np.sqrt(length.max()))
        flat = np.concatenate([own, length[:, None]], 1)
        single = flat.astype(np.float32) if self.top < 1e15 else flat
        self.all = ids, data, single
        cuts = runs(cell).tolist()
        self.cells = {int(cell[p]): (ids[p:q], data[p:q], single[p:q]) for p, q in zip(cuts, [*cuts[1:], len(cell)], strict=True)}

    def search(self, places: Boxes, x: np.ndarray, known: np.ndarray, asks: np.ndarray, low: int, names: np.ndarray | None, own: bool) -> _Search:
        """Queries search the cells that they ask (bits from cell `low` on), less those that what is found meanwhile rules out; with
        `own` these are their own cells, and the others of the shelf follow."""
        found = _Search(x, known, names)
        found.towards(self.centre, self.top)
        for again in range(2 if own else 1):
            if again:
                asks = places.near(x, _room(found.known), low, low + asks.shape[1]) & ~asks
            if asks.mean() > MOST_CELLS:  # all of them: those that aren't asked can't change the answer
                for at in range(0, len(self.all[0]), 1024):
                    found.meet(None, *(c[at : at + 1024] for c in self.all))
                continue
            for n in np.flatnonzero(asks.any(0)).tolist():
                row = np.flatnonzero(asks[:, n])
                if low + n not in self.cells:
                    continue
                if again or not own:
                    row = row[~places.outside(x[row], _room(found.known[row]), low + n)]
                if len(row):
                    found.meet(row, *self.cells[low + n])
        return found


def _meet(asked: DataFrame, training: DataFrame, cells: Boxes, first: np.ndarray, max_rows: int, max_queries: int, others: bool, own: bool, key_type: str) -> DataFrame:
    """(key, nn_id, dist) of the queries in the shelves, and there in the cells, that they ask; with `own` also in the shelf's others.

    A shelf's rows come first in a task, at most about `max_rows` of them, and its queries follow, a batch at a time; large
    cells are dealt over pieces and many queries of one shelf over parts.
    """
    spark = asked.sparkSession
    sizes = {r["shelf"]: r["n"] for r in asked.groupBy("shelf").agg(F.count("*").alias("n")).collect()}  # a row a shelf
    held = np.add.reduceat(cells.count, first)
    a_part = max(max_queries, sum(sizes.values()) // UNITS)
    plan = [(s, max(1, -(-int(held[s]) // (2 * max_rows))), -(-n // a_part)) for s, n in sizes.items() if held[s]]
    table = F.broadcast(spark.createDataFrame(plan, "shelf int, pieces int, parts int"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda of, c: F.pmod(F.xxhash64(of), F.col(c)).cast("int")
    own_shelf = F.broadcast(spark.createDataFrame([(c, int(s)) for c, s in enumerate(np.searchsorted(first, np.arange(len(cells.count)), "right") - 1)], "cell int, shelf int"))
    rows = training.join(own_shelf, "cell").join(table, "shelf").select("id", "x", "cell", "shelf", dealt("id", "pieces").alias("piece"), span("parts").alias("part"), F.lit(False).alias("is_query"))
    queries = asked.join(table, "shelf").select("key", "x", "known", "cells", "shelf", dealt("key", "parts").alias("part"), span("pieces").alias("piece"), F.lit(True).alias("is_query"))
    keys = ["shelf", "piece", "part"]
    units = min(sum(pieces * parts for _, pieces, parts in plan), UNITS)  # twice as many partitions, so that few hold two
    both = rows.unionByName(queries, allowMissingColumns=True).repartition(max(1, 2 * units), *keys).sortWithinPartitions(*keys, "is_query")
    shared = spark.sparkContext.broadcast(cells)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, now, held, shelf = shared.value, None, [], None
        ends = np.append(first, len(places.count))
        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in (*keys, "is_query")]
            starts = runs(*columns).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part, place = batch.slice(a, b - a), tuple(int(c[a]) for c in columns[:3])
                if place != now:
                    now, held, shelf = place, [], None
                x = _vectors(part["x"], places.pivots.shape[1])
                if not columns[3][a]:
                    held.append((part["cell"].to_numpy(), part["id"].to_numpy(), x))
                    continue
                if held:
                    shelf, held = _Shelf(held), []
                if shelf is None:
                    continue
                low, high = ends[place[0]], ends[place[0] + 1]
                asks = np.unpackbits(np.frombuffer(b"".join(part["cells"].to_pylist()), np.uint8).reshape(len(x), -1), axis=1, count=high - low).astype(bool)
                found = shelf.search(places, x, part["known"].fill_null(np.inf).to_numpy(), asks, int(low), part["key"].to_numpy(zero_copy_only=False) if others else None, own)
                use = np.flatnonzero(np.isfinite(found.square))
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(use)), pa.array(found.ids[use]), pa.array(np.sqrt(found.square[use]))], ["key", "nn_id", "dist"])

    return both.mapInArrow(task, f"key {key_type}, nn_id long, dist double")


def _named(rows: DataFrame) -> DataFrame:
    """`rows` (key, x) with `same`, a digest of the vector, and -0 as 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch["x"], len(batch["x"][0]) if batch.num_rows else 0) + 0.0
            same = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["key"], lists(x), same], ["key", "x", "same"])

    return rows.mapInArrow(task, rows.select("key", "x", F.lit(b"").alias("same")).schema)


def nearest(queries: DataFrame, training: DataFrame, key: str, target: str, vector: str, max_rows: int = 20_000, others: bool = False, max_queries: int = 20_000, rows_a_pivot: int = ROWS_A_PIVOT) -> DataFrame:
    """(key, nn_id, dist): nearest training row of each query, ties to the smallest id; with `others`, not the query's own id.

    Equal vectors are searched once, and among equal training rows only the smallest id can be the answer (not so with `others`,
    where each row is searched). Training rows are dealt to the cells of a k-d tree, some cells to a shelf. A query first searches
    its own cell and what of its shelf can hold a row as near; then only the cells of other shelves whose boxes are near enough.
    Cells that no box rules out are searched whole: exact. A query travels once for each shelf of cells, not for each cell.
    Queries without a training row to compare with are left out.
    """
    kind = queries.schema[key].dataType.simpleString()
    own = queries.select(F.col(key).alias("key"), F.col(vector).alias("x"))
    rows = training.select(F.col(target).alias("id"), F.col(vector).alias("x"))
    if not others:
        named = written(_named(own))
        own = written(named.groupBy("same").agg(F.min(F.struct("key", "x")).alias("m")).select("same", "m.key", "m.x"))
        rows = written(_named(rows.withColumnRenamed("id", "key")).groupBy("same").agg(F.min(F.struct("key", "x")).alias("m")).select(F.col("m.key").alias("id"), "m.x"))
    placed, cells = voronoi(rows, "id", "x", rows_a_pivot)
    if cells is None:
        return own.where("false").select(F.col("key").alias(key), F.lit(0).cast("long").alias("nn_id"), F.lit(0.0).alias("dist"))
    max_rows = min(max(max_rows, int(cells.count.sum()) // COPIES), MOST_ROWS)
    first, asking = shelves(cells.count, max_rows), own.select("key", "x")
    home = written(asked_shelves(asking.withColumn("known", F.lit(None).cast("double")), cells, True, first))
    found = written(_meet(home, placed, cells, first, max_rows, max_queries, others, True, kind))
    best = lambda found: found.groupBy("key").agg(F.min(F.struct("dist", "nn_id")).alias("m")).select("key", "m.nn_id", "m.dist")
    known = asking.join(best(found).select("key", F.col("dist").alias("known")), "key", "left")
    known = known.repartition(min(UNITS, 1 + home.count() // 8192), "key")  # boxes take more time than these rows' bytes tell
    asked = written(asked_shelves(known, cells, False, first))
    found = best(found.unionByName(_meet(asked, placed, cells, first, max_rows, max_queries, others, False, kind)))
    if not others:
        found = named.select("key", "same").join(own.select("same", F.col("key").alias("_first")).join(found.withColumnRenamed("key", "_first"), "_first"), "same")
    return found.select(F.col("key").alias(key), "nn_id", "dist")
