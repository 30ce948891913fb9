"""Approximate nearest neighbours by stable projections and kd-trees with a chi-square stopping test.

Unit vectors are projected on DIMS Gaussian (2-stable) directions. For vectors at distance d, the squared projected
distance over d**2 is chi-square with DIMS degrees of freedom. Neighbours are taken in the order of projected distance
and verified on the original vectors, until a vector nearer than the k-th found would have shown up so far with
probability CONFIDENCE.

Projected space is cut into cells by a kd-tree over a bounded sample; every vector is in one cell, and a cell over
CELL vectors in several parts. A query searches its own cell first, which bounds its k-th distance, then the other
cells that the test does not rule out. Equal vectors are one entry with their least ids.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import keep

DIMS, LEAF, CELL = 8, 64, 8192
CONFIDENCE = 0.98
SAMPLE = 20_000
QUERIES = 4096  # of a part that are searched in one task


def chi_square_cdf(x: float) -> float:
    """For DIMS (even) degrees of freedom."""
    half = x / 2
    term, total = 1.0, 1.0
    for i in range(1, DIMS // 2):
        term *= half / i
        total += term
    return 1 - np.exp(-half) * total


def _stop_ratio() -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle) < CONFIDENCE else (low, middle)
    return high


STOP = _stop_ratio()  # the test holds where projected distance**2 >= STOP * (k-th distance)**2


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of float64, each scaled by a power of two to a largest component in 0.5 to 1: cosines stay
    as they are to the last bit, and no square overflows or vanishes."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, initial=0))[1][:, None])


def project(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ np.random.default_rng(vectors.shape[1]).normal(size=(vectors.shape[1], DIMS))


class Cells:
    """A kd-tree of few cells over a sample: splits by the widest dimension at its median."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.low, self.high, self.nodes = [], [], []
        box = np.full(DIMS, np.inf)
        self.root = self._split(points, cells, -box, box)

    def _split(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        if cells > 1 and len(points) > 1:
            axis = int(np.ptp(points, axis=0).argmax())
            at = float(np.median(points[:, axis]))
            side = points[:, axis] <= at
            if side.any() and not side.all():
                left, right = high.copy(), low.copy()
                left[axis] = right[axis] = at
                node = (axis, at, self._split(points[side], cells // 2, low, left), self._split(points[~side], cells - cells // 2, right, high))
                self.nodes.append(node)
                return len(self.nodes) - 1
        self.low.append(low)
        self.high.append(high)
        return -len(self.low)

    def find(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, at, left, right = self.nodes[node]
            side = points[rows, axis] <= at
            stack += [(left, rows[side]), (right, rows[~side])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance of a point to each cell's box."""
        off = np.maximum(np.maximum(np.array(self.low) - point, point - np.array(self.high)), 0)
        return (off**2).sum(axis=1)


class KdTree:
    """Bounding boxes over leaves of LEAF points; ``search`` yields leaves in the order of projected distance."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.low, self.high, self.below, self.rows = points, [], [], [], []
        self.root = self._build(np.arange(len(points)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        node = len(self.low)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.below.append(())
        self.rows.append(rows if len(rows) <= LEAF else None)
        if len(rows) > LEAF:
            order = rows[np.argpartition(own[:, int(np.ptp(own, axis=0).argmax())], len(rows) // 2)]
            self.below[node] = (self._build(order[: len(rows) // 2]), self._build(order[len(rows) // 2 :]))
        return node

    def search(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        far = (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(axis=1)
        heap = [(float(far[self.root]), self.root)]
        while heap:
            distance, node = heapq.heappop(heap)
            if self.rows[node] is not None:
                yield distance, self.rows[node]
            for child in self.below[node]:
                heapq.heappush(heap, (float(far[child]), child))


def nearest(tree: KdTree, vectors: np.ndarray, norms: np.ndarray, times: np.ndarray, query: np.ndarray, shown: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cosines of the entries verified that are at least as near as the k-th; ``bound`` is a k-th cosine known."""
    best = np.full(k, bound)
    rows, scores, norm = [], [], np.sqrt(query @ query)
    for distance, leaf in tree.search(shown):
        if distance >= STOP * (2 - 2 * best[-1] + 1e-12):
            break
        cosine = vectors[leaf] @ query / (norms[leaf] * norm)
        near = cosine >= best[-1]
        if near.any():
            rows.append(leaf[near])
            scores.append(cosine[near])
            best = -np.sort(-np.concatenate([best, np.repeat(cosine[near], times[leaf[near]])]))[:k]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0)
    rows, scores = np.concatenate(rows), np.concatenate(scores)
    return rows[scores >= best[-1]], scores[scores >= best[-1]]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        entry = group.column("query_id").is_null().to_numpy()
        held, asked = group.filter(pa.array(entry)), group.filter(pa.array(~entry))
        found: list[tuple[int, int, float]] = []
        if held.num_rows and asked.num_rows:
            vectors = matrix(held.column("embedding").combine_chunks())
            norms, ids = np.sqrt((vectors**2).sum(axis=1)), held.column("ids").to_pylist()
            times = np.array([max(len(i), 1) for i in ids])
            tree, queries = KdTree(project(vectors)), matrix(asked.column("embedding").combine_chunks())
            for q, query, shown, bound in zip(asked.column("query_id").to_pylist(), queries, project(queries), asked.column("bound").to_pylist(), strict=True):
                own = np.flatnonzero((vectors == query).all(axis=1))  # its own entry holds one candidate less
                less = times.copy()
                less[own] = [sum(i != q for i in ids[e]) for e in own]
                rows, scores = nearest(tree, vectors, norms, less, query, shown, k, -2.0 if bound is None else bound)
                found += sorted(((q, i, s) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for i in ids[r] if i != q), key=lambda x: (-x[2], x[1]))[:k]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)] if found else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def _locate(cells: Cells, parts: np.ndarray):
    """Adds the cell of each vector and its part of the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells.find(project(matrix(batch.column("embedding")))) if batch.num_rows else np.zeros(0, np.int64)
            part = np.array([hash(i[0]) for i in batch.column("ids").to_pylist()], np.int64) % parts[at] if batch.num_rows else at
            yield batch.append_column("cell", pa.array(at)).append_column("part", pa.array(part))

    return run


def _route(cells: Cells, parts: np.ndarray, home: bool):
    """One row of a query for each part of each cell that it has to search; ``home`` is its own cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                shown = project(matrix(batch.column("embedding")))
                own, bounds = cells.find(shown), batch.column("bound").to_pylist()
                take, cell, part = [], [], []
                for i in range(batch.num_rows):
                    off = cells.distances(shown[i])
                    kth = np.inf if bounds[i] is None else 2 - 2 * bounds[i] + 1e-12
                    for c in [own[i]] if home else np.flatnonzero((off < STOP * kth) & (np.arange(len(off)) != own[i])):
                        for p in range(parts[c]):
                            take.append(i)
                            cell.append(c)
                            part.append(p)
                yield batch.take(pa.array(take, pa.int64())).append_column("cell", pa.array(cell, pa.int64())).append_column("part", pa.array(part, pa.int64()))

    return run


def neighbours(vectors: DataFrame, query_ids: Column, k: int = 5) -> DataFrame:
    """The k nearest vectors by cosine of each query; ``vectors`` is (vec_id, embedding array), ``query_ids`` a condition.

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id, a query's own id left
    out; fewer rows where there are fewer candidates. Vectors that are null, empty, zero or hold null or non-finite
    components, and null ids, take no part. Vectors of different lengths have no cosine, so each length is searched by
    itself. Ids that repeat with the same vector count once. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), query_ids.alias("asks")).where("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0)).distinct()
    lengths = [r["n"] for r in rows.where("asks").select(F.size("embedding").alias("n")).distinct().orderBy("n").toLocalIterator()]
    nothing = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_of_one_length(rows.where(F.size("embedding") == n), k) for n in lengths]
    return functools.reduce(DataFrame.union, found) if found else nothing


def _of_one_length(rows: DataFrame, k: int) -> DataFrame:
    """The same for (vec_id, embedding, asks) of one length."""
    # the least k + 1 ids of equal vectors: row_number() <= k + 1 is applied before the shuffle too
    order = Window.partitionBy("embedding").orderBy("vec_id")
    entries = keep(rows.select("vec_id", "embedding").distinct().withColumn("nth", F.row_number().over(order)).where(f"nth <= {k + 1}").groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    some = entries.orderBy(F.xxhash64(F.get("ids", F.lit(0)))).limit(SAMPLE).select("embedding").toArrow()
    cells = Cells(project(matrix(some.column("embedding").combine_chunks())), max(1, -(-n // CELL)))
    one = np.ones(len(cells.low), np.int64)
    located = "embedding array<double>, ids array<long>, cell long, part long"
    sizes = {r["cell"]: r["count"] for r in entries.mapInArrow(_locate(cells, one), located).groupBy("cell").count().collect()}  # a row a cell
    parts = np.array([max(1, -(-sizes.get(c, 0) // (2 * CELL))) for c in range(len(one))])
    points = keep(entries.mapInArrow(_locate(cells, parts), located))

    asked = keep(rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding", F.lit(None).cast("double").alias("bound")).distinct())
    routed = "query_id long, embedding array<double>, bound double, cell long, part long"

    def search(queries: DataFrame) -> DataFrame:
        # a part that many queries ask is searched by several tasks, each with its share of the queries
        queries = keep(queries)
        turns = queries.groupBy("cell", "part").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("turns"))
        dealt = queries.join(turns, ["cell", "part"]).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns"))).withColumn("ids", F.lit(None).cast("array<long>"))
        held = points.join(turns, ["cell", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
        held = held.withColumn("query_id", F.lit(None).cast("long")).withColumn("bound", F.lit(None).cast("double"))
        columns = ["query_id", "embedding", "bound", "cell", "part", "turn", "ids"]
        return held.select(columns).union(dealt.select(columns)).groupBy("cell", "part", "turn").applyInArrow(_search(k), "query_id long, vec_id long, score double")

    def first(found: DataFrame) -> DataFrame:
        nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(nearest_first)).where(f"rank <= {k}")

    at_home = keep(first(search(asked.mapInArrow(_route(cells, parts, True), routed))))
    kth = at_home.where(f"rank = {k}").select(F.col("query_id").alias("q"), F.col("score").alias("known"))
    bounded = asked.join(kth, F.col("query_id") == F.col("q"), "left").select("query_id", "embedding", F.col("known").alias("bound"))
    away = search(bounded.mapInArrow(_route(cells, parts, False), routed))
    return first(at_home.drop("rank").union(away)).select("query_id", "rank", "vec_id", "score")
