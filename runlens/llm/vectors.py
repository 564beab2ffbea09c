"""Embedding near-duplicates: all pairs with a cosine of at least a threshold, by PCA-ordered tiles.

Vectors are turned into the axes of the principal components, largest variance first. For unit vectors the products of the
leading axes plus the product of what is left of both norms bound the cosine, so most pairs are given up after a few axes.
Tiles are cut at medians along the leading axes. Each has a box: its extent on the first BOX_AXES axes and in what is left of
the norm. A vector goes only to those tiles whose box can hold a partner of it.
Copies take part once, with their number. A tile pair gives sums of links per vector and a forest of its links, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common, graph

TILE, STRIP = 8192, 1024  # vectors that are shuffled as one, and compared as one
CUT_AXES, BOX_AXES = 8, 32  # leading axes along which tiles are cut, and on which their extent is known
MOST_CELLS = 1 << 15  # bounds what is broadcast (about 35 MB of boxes); in tables beyond it, a cell is several tiles, cut by a hash
SHARES = (0.2, 0.6)  # of the variance that the leading axes hold when pairs may be given up
SLACK = 1e-4  # more than single precision loses; what passes is computed in double precision


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """One row per vector, shorter ones filled up with zeros."""
    length = column.value_lengths().to_numpy()
    out = np.zeros((len(column), size))
    flat = column.flatten().to_numpy()
    start = np.cumsum(length) - length
    out[np.repeat(np.arange(len(column)), length), np.arange(len(flat)) - np.repeat(start, length)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither huge nor tiny components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes as columns, largest variance first, and the mean square of the vectors along each. Each task gives the sums of its products; they are added by cell, so the
    driver gets size * size numbers."""
    def products(batches):
        total = np.zeros((size + 1, size))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), size)) if batch.num_rows else np.zeros((0, size))
            total[:size] += x.T @ x
            total[size] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    sums = vectors.select("vector").mapInArrow(products, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((size + 1) * size)
    total[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    total, n = total.reshape(size + 1, size), vectors.count()
    mean = total[size] / max(1, n)
    variance, axes = np.linalg.eigh(total[:size] / max(1, n) - np.outer(mean, mean))
    # Bounds are on products, not on differences from the mean: what an axis holds is its second moment.
    return axes[:, ::-1], variance[::-1] + (mean @ axes[:, ::-1]) ** 2


class Turned:
    """Unit vectors on the principal axes in single precision, with what is left of their norms after each step."""

    def __init__(self, unit: np.ndarray, axes: np.ndarray, steps: list[int]):
        exact = unit @ axes
        self.x, self.first = exact.astype(np.float32), exact[:, 0]
        squares = np.cumsum(exact * exact, axis=1)
        self.left = {k: np.sqrt(np.maximum(0.0, 1.0 - squares[:, k - 1])).astype(np.float32) for k in steps}


def steps_of(variance: np.ndarray) -> list[int]:
    """Numbers of leading axes that hold the SHARES of the variance."""
    held = np.cumsum(np.maximum(variance, 0.0))
    return sorted({min(len(held), int(np.searchsorted(held, s * held[-1])) + 1) for s in SHARES})


def _near(x: Turned, a: np.ndarray, b: np.ndarray, unit: np.ndarray, steps: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b whose cosine reaches `least`. Products of the axes are added up step by step; after each one
    the strip is given up if no pair can still reach it. The pairs that can after the last step are computed exactly."""
    total, done = np.float32(0), 0
    for k in steps:
        total = total + x.x[a, done:k] @ x.x[b, done:k].T
        open_ = total + np.outer(x.left[k][a], x.left[k][b]) >= least - SLACK
        done = k
        if not open_.any():
            return a[:0], b[:0]
    i, j = np.nonzero(open_)
    i, j = a[i], b[j]
    exact = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 18):
        part = slice(s, s + (1 << 18))
        exact[part] = (unit[i[part]] * unit[j[part]]).sum(axis=1) >= least
    return i[exact], j[exact]


class Cells:
    """A tree of cuts: each node has an axis and a cut with two nodes behind it, or is a cell."""

    def __init__(self):
        self.axis, self.cut, self.child = [0], [0.0], [-1]

    def split(self, node: int, axis: int, cut: float) -> tuple[int, int]:
        self.axis[node], self.cut[node], self.child[node] = axis, cut, len(self.axis)
        self.axis += [0, 0]
        self.cut += [0.0, 0.0]
        self.child += [-1, -1]
        return self.child[node], self.child[node] + 1

    def find(self, x: np.ndarray) -> np.ndarray:
        axis, cut, child = np.array(self.axis), np.array(self.cut), np.array(self.child)
        at, going = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(going := going[child[at[going]] >= 0]):
            node = at[going]
            at[going] = child[node] + (x[going, axis[node]] > cut[node])
        return at


def cells_of(leads: DataFrame, width: int, target: int) -> Cells:
    """Cuts at the median of the axis that spreads a cell most, until cells hold about `target` vectors. A cell whose
    vectors agree on the axes stays whole. One aggregate per level; the driver gets some numbers per cell."""
    cells, open_ = Cells(), {0}
    axes = min(CUT_AXES, width)
    while open_:
        def located(batches, cells=cells, open_=np.array(sorted(open_))):
            for batch in batches:
                x = _matrix(batch.column(0), width)[:, :axes]
                cell = cells.find(x)
                mine = np.isin(cell, open_)
                yield pa.RecordBatch.from_arrays([pa.array(cell[mine]), *(pa.array(c) for c in x[mine].T)], names=["cell", *(f"x{k}" for k in range(axes))])

        rows = leads.select("lead").mapInArrow(located, "cell long, " + ", ".join(f"x{k} double" for k in range(axes)))
        figures = [f(f"x{k}") for k in range(axes) for f in (F.stddev_pop, lambda c: F.percentile_approx(c, 0.5, 1000), F.max)]
        found = rows.groupBy("cell").agg(F.count("*"), *figures).collect()
        open_ = set()
        for cell, n, *rest in sorted(found):
            spread = [(sd, k, median) for k, (sd, median, most) in enumerate(zip(rest[::3], rest[1::3], rest[2::3])) if median < most]
            if n > target and spread:
                _, k, median = max(spread)
                halves = cells.split(cell, k, median)
                open_.update(halves if n > 2 * target else ())
    return cells


class Boxes:
    """Extent of each cell on the leading axes and in what is left of the norm (the last column), with its tiles."""

    def __init__(self, low: np.ndarray, high: np.ndarray, tiles: np.ndarray, least: float):
        self.low, self.high, self.tiles, self.least = low, high, tiles, least
        self.first = np.cumsum(tiles) - tiles
        self.apart = max(0.0, 2 - 2 * least) + SLACK

    def near(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Cells that are no further from this box than a linked pair can be."""
        gap = np.maximum(0.0, np.maximum(self.low - high, low - self.high))
        return np.flatnonzero(((gap * gap).sum(axis=1) <= self.apart) & (self.tiles > 0))

    def reached(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of x and a cell that can hold a vector linked to it, by distance and by product."""
        rows, found = [], []
        for c in cells:
            low, high = self.low[c], self.high[c]
            gap = np.maximum(0.0, np.maximum(low - x, x - high))
            product = np.maximum(x * low, x * high).sum(axis=1)
            at = np.flatnonzero(((gap * gap).sum(axis=1) <= self.apart) & (product >= self.least - SLACK))
            rows.append(at), found.append(np.full(len(at), c))
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def paired(distinct: DataFrame, total: int, axes: np.ndarray, least: float) -> DataFrame:
    """a, b (a pair of tiles, or one with itself), left (the row is in a), node, copies, vector: each vector once for every
    tile that can hold a partner of it. `distinct` has `total` rows of node, copies and vector; give it a written table."""
    size, width = len(axes), min(BOX_AXES, len(axes))
    kind = distinct.schema["vector"].dataType.simpleString()

    def turn(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(2), size)) @ axes[:, :width] if batch.num_rows else np.zeros((0, width))
            left = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))
            lead = np.column_stack([x, left]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(len(lead) + 1, dtype=np.int32) * (width + 1), lead.ravel())], names=["node", "copies", "vector", "lead"])

    turned = common.saved(distinct.select("node", "copies", "vector").mapInArrow(turn, f"node long, copies long, vector {kind}, lead array<float>"), "turned")
    cells = cells_of(turned, width + 1, max(TILE, -(-total // MOST_CELLS)))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.find(_matrix(batch.column(3), width + 1)))], names=[*batch.schema.names, "cell"])

    placed = turned.mapInArrow(place, f"node long, copies long, vector {kind}, lead array<float>, cell long")
    placed = common.saved(placed.repartitionByRange("cell", "node"), "placed")

    def extents(batches):
        for batch in batches:
            x, cell = _matrix(batch.column(0), width + 1), batch.column(1).to_numpy()
            order = np.argsort(cell, kind="stable")
            each, start, n = np.unique(cell[order], return_index=True, return_counts=True)
            low, high = (f.reduceat(x[order], start, axis=0) if len(each) else x for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(each, width + 1)), pa.array(np.tile(np.arange(width + 1), len(each))), pa.array(low.ravel()), pa.array(high.ravel()),
                                              pa.array(np.repeat(n, width + 1))], names=["cell", "axis", "low", "high", "n"])

    found = placed.select("lead", "cell").mapInArrow(extents, "cell long, axis long, low double, high double, n long")
    found = found.groupBy("cell", "axis").agg(F.min("low"), F.max("high"), F.sum("n")).toArrow()  # some BOX_AXES numbers for each cell
    cell, axis, lowest, highest, n = (c.to_numpy() for c in found.columns)
    low, high = (np.zeros((len(cells.axis), width + 1), np.float32) for _ in range(2))  # exact: the table holds single precision
    tiles = np.zeros(len(cells.axis), np.int64)
    low[cell, axis], high[cell, axis], tiles[cell] = lowest, highest, -(-n // TILE)
    shared = distinct.sparkSession.sparkContext.broadcast(Boxes(low, high, tiles, least))

    def replicate(batches):
        boxes = shared.value
        for batch in batches:
            x, node, cell = _matrix(batch.column(3), width + 1), batch.column(0).to_numpy(), batch.column(4).to_numpy()
            tile = boxes.first[cell] + (node ^ (node >> 33)) % np.maximum(boxes.tiles[cell], 1)  # a cell that ties make large is cut by a hash
            for c in np.unique(cell):
                mine = np.flatnonzero(cell == c)
                at, other = boxes.reached(x[mine], boxes.near(x[mine].min(axis=0), x[mine].max(axis=0)))
                n = boxes.tiles[other]
                at = mine[np.repeat(at, n)]
                other = np.repeat(boxes.first[other] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for s in range(0, len(at), 1 << 15):
                    rows, t, u = at[s : s + (1 << 15)], tile[at[s : s + (1 << 15)]], other[s : s + (1 << 15)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(t, u)), pa.array(np.maximum(t, u)), pa.array(t <= u), *(batch.column(k).take(pa.array(rows)) for k in (0, 1, 2))],
                                                     names=["a", "b", "left", "node", "copies", "vector"])

    return placed.mapInArrow(replicate, f"a long, b long, left boolean, node long, copies long, vector {kind}")


def compared(table: pa.Table, axes: np.ndarray, steps: list[int], least: float) -> pa.Table:
    """Of one pair of tiles: node, n (weighted links of it) and other (a node of its group here, or null)."""
    left = table.column("left").to_numpy()
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    unit = _unit(_matrix(table.column("vector").combine_chunks(), len(axes)))
    turned = Turned(unit, axes, steps)
    alone = table.column("a")[0] == table.column("b")[0]
    sides = [np.flatnonzero(left)] * 2 if alone else [np.flatnonzero(left), np.flatnonzero(~left)]
    sides = [s[np.argsort(turned.first[s], kind="stable")] for s in sides]
    apart = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    n, froms, tos = np.zeros(len(node), np.int64), [], []
    for p in range(0, len(sides[0]), STRIP):
        a = sides[0][p : p + STRIP]
        for q in range(p if alone else 0, len(sides[1]), STRIP):
            b = sides[1][q : q + STRIP]
            if turned.first[b[0]] - turned.first[a[-1]] > apart or turned.first[a[0]] - turned.first[b[-1]] > apart:
                continue
            i, j = _near(turned, a, b, unit, steps, least)
            if alone:  # a strip with itself gives each pair twice, and each vector with itself
                once = i < j if p == q else np.ones(len(i), bool)
                i, j = i[once], j[once]
            n += np.bincount(i, copies[j], len(n)).astype(np.int64) + np.bincount(j, copies[i], len(n)).astype(np.int64)
            if len(i):
                u, v = graph.forest(i, j)
                froms.append(u), tos.append(v)
    other = np.full(len(node), -1)
    if froms:
        u, v = graph.forest(np.concatenate(froms), np.concatenate(tos))
        other[u] = v
    hit = np.flatnonzero((n > 0) | (other >= 0))
    return pa.table({"node": node[hit], "n": n[hit], "other": pa.array(node[other[hit]], mask=other[hit] < 0)})


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """Key, n_links (other rows linked directly), component_id (smallest key reachable), kept (the key is it) of every row.

    Rows whose vector is null, empty, zero or holds a null or non-finite component link with nothing. A shorter vector
    counts as filled up with zeros. Repeated rows and equal vectors are rows of their own and linked. A null key is never
    smallest and never kept. An empty table gives an empty result.
    """
    exact = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"  # as given, which halves the shuffle
    v = F.transform(F.col(vector), lambda x: x.cast(exact))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(key), F.when(F.coalesce(fit, F.lit(False)), v).alias("vector"))
    base = base.withColumn("h1", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector")))
    own = common.saved(base, "vectors")
    distinct = own.where("vector is not null").groupBy("h1", "h2").agg(F.min(key).alias("smallest"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    distinct = common.saved(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    size, total = distinct.agg(F.max(F.size("vector")), F.count("*")).first()
    if not total:
        return own.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.col(key).isNotNull().alias("kept"))
    axes, variance = principal_axes(distinct, size)
    steps = steps_of(variance)
    pairs = paired(distinct, total, axes, least)
    found = pairs.groupBy("a", "b").applyInArrow(lambda t: compared(t, axes, steps, least), "node long, n long, other long")
    found = common.saved(found, "found")
    linked = found.groupBy("node").agg(F.sum("n").alias("n")).select(F.col("node").alias("_n"), "n")
    root = graph.components(found.where("other is not null").select("node", "other"), "node", "other").withColumnRenamed("node", "_m")
    nodes = distinct.select("node", "h1", "h2", "smallest", "copies").join(linked, F.col("node") == F.col("_n"), "left").join(root, F.col("node") == F.col("_m"), "left")
    least_of = nodes.where("root is not null").groupBy("root").agg(F.min("smallest").alias("_least")).withColumnRenamed("root", "_root")
    nodes = nodes.join(least_of, F.col("root") == F.col("_root"), "left").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("_least", "smallest").alias("_component"))
    out = own.join(nodes, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.when(F.col("vector").isNull(), F.col(key)).otherwise(F.col("_component"))
    return out.select(key, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
