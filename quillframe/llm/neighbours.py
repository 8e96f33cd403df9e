"""Approximate nearest neighbours: stable random projections in kd-trees, verified until a chi-square test holds.

Every vector is projected to a few dimensions by one Gaussian matrix. A squared
projected distance, by the true squared distance, is then chi-square with as
many degrees of freedom. A kd-tree over a bounded sample of projections cuts
the projected space into cells; every row is routed to its cell, and a cell's
rows are a kd-tree of their own (several, where a cell has too many rows). A
query takes a cell's points in order of projected distance and verifies each by
its true distance; it stops when a point as near as the k-th nearest so far
would have come this early but for a small chance. It first searches its own
cell, then those cells whose box the same test can't rule out. Equal vectors
are one query, and the first k + 1 of them are candidates: no answer needs more.

Defined results: vectors that are null, zero, or hold a null or a non-finite
number take no part, as queries or as candidates, nor do rows of a null vec_id;
vectors of different widths have no distance, so a query's candidates are those
of its own width; a row is never its own neighbour, but another row of the same
vec_id is; fewer candidates than k give all of them; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, join_spread, materialise, sampled, table

K = 10
DIMENSIONS = 12
#: Chance that a true neighbour is passed over by the stopping test in a block.
MISS = 0.01
LEAF = 64
#: Rows of a cell, or of a part of one, about, and queries that go to it at once.
BLOCK_ROWS = 4_096
QUERY_ROWS = 2_048
#: Projections that the cells are cut by, about, and how many of them a cell has at least.
SAMPLE_ROWS = 131_072
CELL_SAMPLE = 8


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of degrees stays under with chance p."""
    half = degrees // 2

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, half):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Points in leaves of a kd-tree, with each leaf's box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            ids = stack.pop()
            if len(ids) <= leaf:
                self.order.append(ids)
                continue
            part = points[ids]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            cut = len(ids) // 2
            split = np.argpartition(part[:, axis], cut)
            stack += [ids[split[cut:]], ids[split[:cut]]]
        self.low = np.stack([points[i].min(axis=0) for i in self.order])
        self.high = np.stack([points[i].max(axis=0) for i in self.order])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each leaf's box."""
        gap = np.maximum(0.0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(axis=1)


class Cells:
    """The projected space, cut into at most `most` boxes, each split at a median of the points."""

    def __init__(self, points: np.ndarray, most: int):
        self.splits: list[tuple[int, float, int, int] | int] = []
        low, high = [], []
        least = max(CELL_SAMPLE, -(-len(points) // most))
        stack = [(points, np.full(DIMENSIONS, -np.inf), np.full(DIMENSIONS, np.inf), None)]
        while stack:
            part, lo, hi, above = stack.pop()
            here = len(self.splits)
            if above is not None:
                axis, value, left, _ = self.splits[above]
                self.splits[above] = (axis, value, here, -1) if left < 0 else (axis, value, left, here)
            spread = part.max(axis=0) - part.min(axis=0) if len(part) >= 2 * least else np.zeros(1)
            if not spread.max() > 0:
                self.splits.append(len(low))
                low.append(lo)
                high.append(hi)
                continue
            axis = int(np.argmax(spread))
            x = part[:, axis]
            value = float(np.median(x))
            if not (x < value).any():
                value = float(x[x > value].min())
            below = x < value
            cut_hi, cut_lo = hi.copy(), lo.copy()
            cut_hi[axis] = cut_lo[axis] = value
            self.splits.append((axis, value, -1, -1))
            stack += [(part[~below], cut_lo, hi, here), (part[below], lo, cut_hi, here)]
        self.low, self.high = np.stack(low), np.stack(high)

    def route(self, points: np.ndarray) -> np.ndarray:
        """The number of each point's cell."""
        out = np.zeros(len(points), np.int32)
        stack = [(0, np.arange(len(points)))]
        while stack:
            here, at = stack.pop()
            split = self.splits[here]
            if isinstance(split, int):
                out[at] = split
            elif len(at):
                axis, value, left, right = split
                below = points[at, axis] < value
                stack += [(left, at[below]), (right, at[~below])]
        return out

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each cell."""
        gap = np.maximum(0.0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(axis=1)


@functools.lru_cache(16)
def projection(width: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((width, DIMENSIONS))


def by_width(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, matrix) of the vectors of a column, for each width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(widths) - widths
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield int(width), at, flat[starts[at][:, None] + np.arange(width)]


def search(vectors: np.ndarray, projected: np.ndarray, ids: np.ndarray, rows: np.ndarray, tree: KdTree, q: np.ndarray, q_low: np.ndarray, bound: float, k: int, quantile: float) -> list[tuple[float, int, int]]:
    """The nearest k of the block that the incremental search verifies: (distance, vec_id, row)."""
    leaves = tree.bounds(q_low)
    best: list[tuple[float, int, int]] = []
    limit = bound
    pool_ids, pool_d = np.zeros(0, np.int64), np.zeros(0)
    order = np.argsort(leaves)
    at = 0
    while True:
        # A candidate is next in line once every unopened box is farther.
        if at < len(order):
            if leaves[order[at]] >= quantile * limit * limit:
                reach, last = np.inf, True
            else:
                new = tree.order[order[at]]
                d = projected[new] - q_low
                pool_ids, pool_d = np.concatenate([pool_ids, new]), np.concatenate([pool_d, (d * d).sum(axis=1)])
                at += 1
                last = at == len(order)
                reach = np.inf if last else leaves[order[at]]
        else:
            reach, last = np.inf, True
        ready = pool_d <= min(reach, quantile * limit * limit)
        if ready.any():
            now = pool_ids[ready]
            pool_ids, pool_d = pool_ids[~ready], pool_d[~ready]
            diff = vectors[now] - q
            dist = np.sqrt((diff * diff).sum(axis=1))
            near = dist <= limit
            if near.any():
                best = sorted([*best, *zip(dist[near].tolist(), ids[now[near]].tolist(), rows[now[near]].tolist())])[:k]
                if len(best) == k:
                    limit = min(limit, best[-1][0])
        if last:
            return best


def usable(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v) of the rows that take part; v in double precision."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return kept.filter(finite & F.exists("v", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id())


def _cells(rows: DataFrame) -> dict[int, Cells]:
    """Cells for each width of over BLOCK_ROWS rows (v, width, row)."""
    counts = {r.width: r.n for r in rows.groupBy("width").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_ROWS).collect()}
    if not counts:
        return {}

    def project(batches):
        for batch in batches:
            for width, _, m in by_width(batch.column("v")):
                low = pa.FixedSizeListArray.from_arrays(pa.array((m @ projection(width)).ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), width, np.int32)), low], names=["width", "low"])

    some = rows.filter(F.col("width").isin(list(counts))).filter(sampled(F.xxhash64("row"), sum(counts.values()), SAMPLE_ROWS))
    sample = some.select("v").mapInArrow(project, "width int, low array<double>").toArrow()
    widths = sample.column("width").to_numpy()
    low = np.array(sample.column("low").to_pylist()).reshape(-1, DIMENSIONS)
    return {w: Cells(low[widths == w], -(-n // BLOCK_ROWS)) for w, n in counts.items()}


def _visit(points: DataFrame, asked: DataFrame, k: int, quantile: float) -> DataFrame:
    """(q, c_row, vec_id, score) of the nearest k that each question (q, v, bound, width, cell) finds in each part of its cell."""
    cell = ["width", "cell"]
    # Both are a row for each cell at most.
    parts = points.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    chunks = asked.groupBy(*cell).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    plan = materialise(parts.join(chunks, cell), "ann-plan")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    dealt = points.join(plan, cell).select("row", "vec_id", "v", *cell, own("row", "parts").alias("part"), every("chunks").alias("chunk"))
    questions = asked.join(plan, cell).select("q", "v", "bound", *cell, own("q", "chunks").alias("chunk"), every("parts").alias("part"))

    def meet(here: pa.Table, questions: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(here) and len(questions):
            [(width, _, v)] = by_width(here.column("v"))
            [(_, _, qv)] = by_width(questions.column("v"))
            ids, row = here.column("vec_id").to_numpy(), here.column("row").to_numpy()
            low, q_low = v @ projection(width), qv @ projection(width)
            tree = KdTree(low)
            for x, x_low, q, b in zip(qv, q_low, questions.column("q").to_pylist(), questions.column("bound").to_pylist()):
                found += [(q, c_row, c, d) for d, c, c_row in search(v, low, ids, row, tree, x, x_low, b, k, quantile)]
        cols = list(zip(*found)) or [()] * 4
        names = ["q", "c_row", "vec_id", "score"]
        return pa.table([pa.array(c, pa.float64() if n == "score" else pa.int64()) for c, n in zip(cols, names)], names=names)

    key = [*cell, "part", "chunk"]
    met = dealt.groupBy(*key).cogroup(questions.groupBy(*key)).applyInArrow(meet, "q long, c_row long, vec_id long, score double")
    found = materialise(met, "ann-found")
    forget(plan)
    return found


def nearest(embeddings: DataFrame, is_query, k: int = K, miss: float = MISS) -> DataFrame:
    """For each row that is_query (a Column of vec_id) picks: query_id, rank, vec_id and score of its nearest."""
    # A row may be among its own nearest, so one more is searched for.
    most, quantile = k + 1, chi_square_quantile(1 - miss, DIMENSIONS)
    rows = materialise(usable(embeddings).withColumn("width", F.size("v")), "ann-rows")
    alike = Window.partitionBy("width", "v").orderBy("vec_id", "row")
    points = rows.withColumn("copy", F.row_number().over(alike)).filter(F.col("copy") <= most).drop("copy")
    points = materialise(points, "ann-candidates")
    cells = _cells(points)
    whole = Cells(np.zeros((0, DIMENSIONS)), 1)

    def route(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for width, at, m in by_width(batch.column("v")):
                cell[at] = cells.get(width, whole).route(m @ projection(width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    def reach(batches):
        for batch in batches:
            cell, bound = batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
            found: list[np.ndarray] = [np.zeros(0, np.int32)] * batch.num_rows
            for width, at, m in by_width(batch.column("v")):
                for i, low in zip(at, m @ projection(width)):
                    near = np.flatnonzero(cells.get(width, whole).bounds(low) < quantile * bound[i] * bound[i])
                    found[i] = near[near != cell[i]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    old, points = points, materialise(points.select("row", "vec_id", "v", "width").mapInArrow(route, "row long, vec_id long, v array<double>, width int, cell int"), "ann-cells")
    forget(old)
    members = rows.filter(is_query(F.col("vec_id"))).select("row", "vec_id", "v", "width")
    queries = members.groupBy("v", "width").agg(F.min("row").alias("q"), F.count("*").alias("n"))
    queries = materialise(queries.mapInArrow(route, "v array<double>, width int, q long, n long, cell int"), "ann-queries")
    first = _visit(points, queries.withColumn("bound", F.lit(math.inf)), most, quantile)
    # The first bound of a query is its last distance in its own cell, if that has enough rows.
    ranked = first.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id", "c_row"))).filter(F.col("at") <= most)
    bounds = ranked.groupBy("q").agg(F.when(F.count("*") == most, F.max("score")).otherwise(F.lit(math.inf)).alias("bound"))
    asked = queries.join(bounds, "q").select("q", "v", "width", "cell", "bound").mapInArrow(reach, "q long, v array<double>, width int, cell int, bound double, cells array<int>")
    asked = materialise(asked.select("q", "v", "width", "bound", F.explode("cells").alias("cell")), "ann-asked")
    then = _visit(points, asked, most, quantile)
    ranked = first.union(then).withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id", "c_row"))).filter(F.col("at") <= most)
    best = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "c_row"))).alias("best"))
    answers = materialise(queries.select("q", "v", "width", "n").join(best, "q").drop("q"), "ann-answers")
    forget(points, queries, first, asked, then)
    found = join_spread(members, answers, ["v", "width"], "n")
    others = F.slice(F.filter("best", lambda x: x.c_row != F.col("row")), 1, k)
    ranked = found.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
