"""Nearest neighbours by inner product: stable projections, kd-trees and a chi-square stopping test.

Largest inner product becomes least distance by one more component: a vector x
gets sqrt(M^2 - |x|^2), M being the greatest length, and a query gets 0. A normal
(2-stable) random matrix projects to ``DIMENSIONS``; a projected distance over the
true one, squared, follows the chi-square law of that many degrees of freedom.

A search visits the leaves of a kd-tree over the projections by rising distance
to the query, and verifies their vectors exactly. With t the distance of the last
of the neighbours found so far, it stops at a leaf of projected distance d once
the law says that a neighbour nearer than t would have been met before with
probability ``STOP``: cdf(d^2 / t^2) >= STOP.

The top of the tree, fitted on a bounded sample, deals all vectors to cells, one
task each. A query first searches the cell it falls into, and then the others
that pass the same test. Equal vectors are one, with their least ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._shared import materialize

DIMENSIONS = 8
STOP = 0.5
NEIGHBOURS = 20
SEED = 20
#: Vectors and components that the cells are fitted on, at most; there are at most a quarter as many cells as vectors.
SAMPLE, SAMPLE_VALUES = 16_384, 1 << 21
VECTORS_IN_CELL = 8_192
LEAF = 256
#: Query vectors that one task searches a cell for, about.
QUERIES_IN_TASK = 16_384
#: Inner products this near, or by this share of the squared lengths, may be equal: the last digits of matrix products are not final.
_NEAR, _NEAR_SHARE = 1e-9, 1e-12


def chi_square_cdf(x: np.ndarray) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    total = term = np.ones_like(half)
    for i in range(1, DIMENSIONS // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def stopping_ratio(stop: float = STOP) -> float:
    """The squared ratio of distances at which the law reaches ``stop``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float(chi_square_cdf(mid)) < stop else (low, mid)
    return high


def matrix(width: int) -> np.ndarray:
    """The same everywhere: it follows from the seed."""
    return np.random.default_rng(SEED).standard_normal((width + 1, DIMENSIONS))


def project(x: np.ndarray, greatest: float | None) -> np.ndarray:
    """Of vectors, or where ``greatest`` is None of queries."""
    more = np.zeros(len(x)) if greatest is None else np.sqrt(np.maximum(0.0, greatest * greatest - (x * x).sum(axis=1)))
    return np.column_stack([x, more]) @ matrix(x.shape[1])


class Boxes:
    """The leaves of a kd-tree as boxes: rows of ``low`` and ``high``, and for a fitted set ``members``."""

    def __init__(self, points: np.ndarray, leaves: int | None = None):
        """Split at medians along the widest side, down to ``LEAF`` points or to so many leaves; the boxes then cover the whole space."""
        self.splits: list[tuple[int, float, int, int]] = []
        self.members: list[np.ndarray] = []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        depth = None if leaves is None else max(0, math.ceil(math.log2(max(1, leaves))))
        wide = np.full(points.shape[1], np.inf)

        def grow(own: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
            sides = np.ptp(points[own], axis=0) if len(own) else np.zeros(points.shape[1])
            at = int(sides.argmax())
            if (len(own) <= LEAF if depth is None else level >= depth or len(own) < 2) or sides[at] == 0:
                boxes.append((points[own].min(axis=0), points[own].max(axis=0)) if depth is None and len(own) else (low, high))
                self.members.append(own)
                return -len(boxes)
            cut = float(np.median(points[own, at]))
            left = points[own, at] < cut
            if not left.any():  # more than half have the least value
                cut = float(np.nextafter(cut, np.inf))
                left = points[own, at] < cut
            here = len(self.splits)
            self.splits.append((at, cut, 0, 0))
            up, down = high.copy(), low.copy()
            up[at] = down[at] = cut
            self.splits[here] = (at, cut, grow(own[left], low, up, level + 1), grow(own[~left], down, high, level + 1))
            return here

        self.root = grow(np.arange(len(points)), -wide, wide, 0)
        self.low, self.high = (np.array(b) for b in zip(*boxes))

    def find(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.empty(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        for node, own in todo:
            if node < 0:
                out[own] = -node - 1
            else:
                at, cut, left, right = self.splits[node]
                below = points[own, at] < cut
                todo += [(left, own[below]), (right, own[~below])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared, from a point to each box."""
        gap = np.maximum(0.0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Cell:
    """Vectors side by side with the other ones of their leaf, for searching."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], greatest: float):
        self.tree, self.greatest = Boxes(project(vectors, greatest)), greatest
        order = np.concatenate(self.tree.members)
        self.vectors, self.ids = np.ascontiguousarray(vectors[order]), [ids[i] for i in order]
        self.weight = np.array([len(i) for i in self.ids])
        self.ends = np.cumsum([len(m) for m in self.tree.members])
        self.starts = self.ends - [len(m) for m in self.tree.members]

    def search(self, query: np.ndarray, near: np.ndarray, bound: float, ratio: float, most: int) -> tuple[list[tuple[int, float]], int]:
        """The ``most`` best (id, inner product), ties to smaller ids, and how many vectors were verified.

        near: squared projected distances of the query to the leaves; bound: a
        squared distance known to hold ``most`` neighbours, of any cell.
        """
        length = float(query @ query) + self.greatest * self.greatest
        at, product = np.array([], np.int64), np.array([])
        last, seen = bound, 0
        # what an inner product must reach to come within the bound
        slack = max(_NEAR, _NEAR_SHARE * length)
        least = (length - last) / 2 - slack
        for j in np.argsort(near, kind="stable"):
            if near[j] >= ratio * last:
                break
            start = self.starts[j]
            found = self.vectors[start : self.ends[j]] @ query
            seen += len(found)
            good = np.flatnonzero(found >= least)
            if not len(good):
                continue
            at, product = np.append(at, start + good), np.append(product, found[good])
            best = np.argsort(-product, kind="stable")
            at, product = at[best], product[best]
            enough = int(np.searchsorted(np.cumsum(self.weight[at]), most))
            if enough < len(product):
                last = min(last, max(0.0, length - 2 * float(product[enough])))
                least = (length - last) / 2 - slack
                # all that may tie with the last one, however many: ids decide among them
                close = product >= product[enough] - slack
                at, product = at[close], product[close]
        exact = np.cumsum(self.vectors[at] * query, axis=1)[:, -1] if len(at) else product
        named = sorted((-s, i) for s, k in zip(exact.tolist(), at) for i in self.ids[k])[:most]
        return [(i, -s) for s, i in named], seen


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, embedding array<double>)`` of those that take part, once each.

    Left out: null ids, null, empty and zero vectors, those with null or
    non-finite components, and those that haven't the most frequent length.
    """
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & whole).distinct()
    width = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("embedding") == (width.n if width else 0))


def nearest(rows: DataFrame, every: int = 20, neighbours: int = NEIGHBOURS, stop: float = STOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose vec_id ``every`` divides, its nearest among all other ids.

    Ranks from 1, nearest first, ties to smaller ids; all candidates if there
    are fewer. See :func:`usable` for the rows that take part; a row repeated in
    full counts once; no queries give no rows.
    """
    spark, most = rows.sparkSession, neighbours + 1
    base = materialize(usable(rows).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}), "usable")
    # of equal vectors no query can need more than its neighbours and itself
    least = base.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("n") <= most)
    vectors = least.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = materialize(vectors, "vectors")
    asked = base.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)).alias("square"), F.max(F.size("embedding")).alias("width")).first()
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    if not stats.n:
        return empty
    greatest, ratio = math.sqrt(stats.square), stopping_ratio(stop)
    sample = np.array([r.embedding for r in vectors.select("embedding", "h1").orderBy("h1").limit(max(256, min(SAMPLE, SAMPLE_VALUES // stats.width))).collect()])
    cells = Boxes(project(sample, greatest), min(len(sample) // 4, -(-stats.n // VECTORS_IN_CELL)))
    cells.members = []

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                x["cell"] = cells.find(project(np.stack(x["embedding"].to_list()), greatest))
                yield x[["cell", "ids", "embedding"]]

    queries = asked.select("h1", "h2").distinct().join(vectors, ["h1", "h2"]).select("h1", "h2", "embedding")
    placed = vectors.select("ids", "embedding").mapInPandas(to_cells, "cell long, ids array<long>, embedding array<double>")
    placed = materialize(placed, "placed")

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                x["cell"], x["bound"] = cells.find(project(np.stack(x["embedding"].to_list()), None)), np.inf
                yield x[["h1", "h2", "cell", "bound", "embedding"]]

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            points = project(np.stack(x["embedding"].to_list()), None)
            own, bounds = cells.find(points), x["bound"].to_numpy()
            at, to = [], []
            for k in range(len(x)):
                far = np.flatnonzero(cells.distances(points[k]) < ratio * bounds[k])
                far = far[far != own[k]]
                at.append(np.full(len(far), k))
                to.append(far)
            rows = x.iloc[np.concatenate(at)].copy()
            rows["cell"] = np.concatenate(to)
            yield rows[["h1", "h2", "cell", "bound", "embedding"]]

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"h1": [], "h2": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            cell = Cell(np.stack(left["embedding"].to_list()), [list(i) for i in left["ids"]], greatest)
            asked = np.stack(right["embedding"].to_list())
            points = project(asked, None)
            for k, r in enumerate(right[["h1", "h2", "bound"]].itertuples(index=False)):
                found, _ = cell.search(asked[k], cell.tree.distances(points[k]), r.bound, ratio, most)
                out["h1"] += [r.h1] * len(found)
                out["h2"] += [r.h2] * len(found)
                out["vec_id"] += [i for i, _ in found]
                out["score"] += [s for _, s in found]
        return pd.DataFrame(out).astype({"h1": "int64", "h2": "int64", "vec_id": "int64", "score": "float64"})

    routed = "h1 long, h2 long, cell long, bound double, embedding array<double>"

    def visited(to: DataFrame) -> DataFrame:
        # a cell's vectors go to as many tasks as the queries that were sent to it need, and nowhere if none was
        to = materialize(to, "routed")
        blocks = materialize(to.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_IN_TASK).cast("int").alias("blocks")), "blocks")
        to = to.join(blocks, "cell").withColumn("block", F.pmod(F.col("h2"), F.col("blocks")).cast("int")).drop("blocks")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        held = placed.join(blocks, "cell").select("cell", every, "ids", "embedding")
        return held.groupBy("cell", "block").cogroup(to.groupBy("cell", "block")).applyInPandas(visit, "h1 long, h2 long, vec_id long, score double")

    first = materialize(visited(queries.mapInPandas(home, routed)), "home")
    # the last of a full list bounds what the other cells must offer
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    last = first.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bound = F.when(F.col("n") >= most, F.greatest(F.lit(0.0), square + F.lit(greatest * greatest) - 2 * F.col("low"))).otherwise(F.lit(float("inf")))
    rest = queries.join(last, ["h1", "h2"], "left").select("h1", "h2", bound.alias("bound"), "embedding")
    found = first.unionByName(visited(rest.mapInPandas(others, routed)))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= most).drop("n")
    each = asked.join(best, ["h1", "h2"]).where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
