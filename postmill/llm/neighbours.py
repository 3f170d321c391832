"""Operator 12: approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors get one more component that makes all of them equally long, so that the largest inner product is the smallest
distance. A few Gaussian (2-stable) projections follow: for a row at distance d, the squared projected distance over d^2 is a
chi-square variable of ``PROJECTIONS`` degrees of freedom. Neighbours in the projections come in shells of growing radius r from
kd-trees and are verified on the whole vectors; with d_k the distance of the k-th best verified, a query stops once the
chi-square distribution puts ``CONFIDENCE`` or more below r^2 / d_k^2. A true neighbour is missed with a probability of at most
1 - ``CONFIDENCE``, whatever the data.

All rows are indexed. The upper levels of the tree are fitted on at most about ``SAMPLE`` rows and cut the projections into at
most 2^``LEVELS`` cells; cells of more than ``CELL_ROWS`` rows are dealt to parts by hash. A task holds one part, builds the lower levels of
the tree and answers one block of queries of the same home cell (``BLOCK_ROWS`` at most). A query visits a part of its home cell
first, and then only the cells whose box (least and greatest projections of its rows) lies within the radius at which it stops.
Only the tree and the boxes are broadcast: at most 2^``LEVELS`` rows.

Scores are sums of products in double precision in the order of the components, ties go to smaller ids. Rows with a null id, a
null or empty vector, a vector of zeros or a component that is null or not finite take no part; vectors of different dimensions
raise an error. Rows of the query's own id are not its neighbours; equal rows of other ids are. Equal query rows count once,
queries that share an id but not a vector are answered apart. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import cut_lineage
from postmill.llm.ranking import best_of, matrix, ranked, usable

PROJECTIONS = 10
CONFIDENCE = 0.96
NEAREST = 20
SAMPLE = 16384
LEVELS = 12
CELL_ROWS = 8192
BLOCK_ROWS = 1024
LEAF = 128
SHELLS = (0.4, 0.6, 0.8, 1.0)
PAIRS = 1 << 16
SLACK = 1e-9

FOUND = "key long, query_id long, vec_id long, score double"
_FOUND = pa.schema([("key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def chi_square_at(degrees: int, share: float) -> float:
    """The value below which a chi-square variable lies with probability ``share``: bisection on the distribution's series."""

    def below(x: float) -> float:
        a, half = degrees / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(a * math.log(half) - half - math.lgamma(a))

    low, high = 1e-9, degrees + 40 * math.sqrt(degrees)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return high


class Projection:
    """Rows made equally long by one more component and projected; ``longest`` is the greatest squared length."""

    def __init__(self, width: int, longest: float, m: int = PROJECTIONS, seed: int = 7):
        self.width, self.longest = width, longest
        self.table = np.random.default_rng(seed).standard_normal((width + 1, m))

    def of(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest - (rows * rows).sum(axis=1)))
        return rows @ self.table[:-1] + rest[:, None] * self.table[-1]

    def of_queries(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.table[:-1]

    def squared_distance(self, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (queries * queries).sum(axis=1) + self.longest - 2 * score)


class Tree:
    """Upper levels of the kd-tree: at each node the widest projection is cut at its median. Nodes stand as in a heap."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.at = np.zeros(1 << levels, np.int64), np.full(1 << levels, np.inf)
        stack = [(1, points)]
        while stack:
            node, own = stack.pop()
            if node >= 1 << levels or len(own) < 2:
                continue
            axis = int(np.ptp(own, axis=0).argmax())
            at = float(np.median(own[:, axis]))
            self.axis[node], self.at[node] = axis, at
            right = own[:, axis] > at
            stack += [(2 * node, own[~right]), (2 * node + 1, own[right])]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (1 << self.levels)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point (rows) to each box (columns)."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        gap = np.maximum(0.0, np.maximum(low[None, :, j] - points[:, None, j], points[:, None, j] - high[None, :, j]))
        out += gap * gap
    return out


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Lower levels of the kd-tree: rows cut at medians of the widest projection until ``size`` or fewer are left."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= size:
            out.append(own)
            continue
        axis = int(np.ptp(points[own], axis=0).argmax())
        half = len(own) // 2
        order = own[np.argpartition(points[own, axis], half)]
        stack += [order[half:], order[:half]]
    return out


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of pairs (q, r), summed in the order of the components: the same for equal vectors wherever they stand."""
    out = np.zeros(len(q))
    for cut in range(0, len(q), PAIRS):
        some = slice(cut, cut + PAIRS)
        a, b, total = queries[q[some]], rows[r[some]], out[some]
        for j in range(queries.shape[1]):
            total += a[:, j] * b[:, j]
    return out


class Best:
    """The k best verified rows of each query so far, and what a further row needs to be among them."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, floor: np.ndarray, k: int):
        self.queries, self.ids, self.rows, self.row_ids, self.k = queries, ids, rows, row_ids, k
        self.need = floor.copy()
        self.slack = SLACK * (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1)).max())
        self.owner, self.at, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def verify(self, own: np.ndarray, some: np.ndarray, wanted: np.ndarray | None = None) -> None:
        """Score queries ``own`` against rows ``some``, where ``wanted``, and keep what can be among the best."""
        products = self.queries[own] @ self.rows[some].T
        hit = (products >= (self.need - self.slack)[own][:, None]) & (self.ids[own][:, None] != self.row_ids[some][None, :])
        if wanted is not None:
            hit &= wanted
        q, r = np.nonzero(hit)
        if len(q):
            self.owner, self.at = np.concatenate((self.owner, own[q])), np.concatenate((self.at, some[r]))
            self.score = np.concatenate((self.score, exact(self.queries, self.rows, own[q], some[r])))
            if len(self.owner) > 4 * self.k * len(self.ids):
                self.trim()

    def trim(self) -> None:
        best = best_of(self.owner, self.score, self.row_ids[self.at], self.k)
        self.owner, self.at, self.score = self.owner[best], self.at[best], self.score[best]
        full, count = np.unique(self.owner, return_counts=True)
        full = full[count == self.k]
        self.need[full] = np.maximum(self.need[full], self.score[np.searchsorted(self.owner, full, "right") - 1])


def search_part(best: Best, projection: Projection, zq: np.ndarray, z: np.ndarray, limit: float) -> None:
    """Incremental search of one part: shells of projected neighbours, until the stopping test holds for every query.

    ``limit`` is the chi-square value of the test: a query is done at the squared radius ``limit * d_k^2``.
    """
    cut = leaves(z)
    low, high = (np.array([f(z[own], axis=0) for own in cut]) for f in (np.min, np.max))
    near = box_distance(zq, low, high)
    home = near.argmin(axis=1)
    for leaf in np.unique(home):  # a first k-th best
        best.verify(np.flatnonzero(home == leaf), cut[leaf])
    best.trim()
    zq2, z2 = (zq * zq).sum(axis=1), (z * z).sum(axis=1)
    done = np.full(len(zq), -1.0)
    for shell in SHELLS:
        stop = np.where(np.isneginf(best.need), np.inf, limit * projection.squared_distance(best.queries, best.need))
        radius = shell * stop
        for leaf, some in enumerate(cut):
            own = np.flatnonzero((near[:, leaf] <= radius) & (radius > done) & (home != leaf))
            if not len(own):
                continue
            apart = np.maximum(0.0, zq2[own][:, None] + z2[some][None, :] - 2 * zq[own] @ z[some].T)
            wanted = (apart <= radius[own][:, None]) & (apart > done[own][:, None])
            hits = wanted.any(axis=1)
            if hits.any():
                best.verify(own[hits], some, wanted[hits])
        best.trim()
        done = np.maximum(done, radius)


def _part(projection: Projection, k: int, limit: float):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        q, x = matrix(queries.column("vector"), projection.width), matrix(rows.column("vector"), projection.width)
        keys, ids, row_ids = queries.column("key").to_numpy(), queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        best = Best(q, ids, x, row_ids, queries.column("floor").to_numpy(), k)
        search_part(best, projection, projection.of_queries(q), projection.of(x), limit)
        return pa.table([keys[best.owner], ids[best.owner], row_ids[best.at], best.score], schema=_FOUND)

    return run


def _placer(projection: Projection, shared):
    """Adds to rows the cell of their projections, and these."""

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                z = projection.of(matrix(batch.column("vector"), projection.width))
                own = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.cell(z).astype(np.int32)), own], [*batch.schema.names, "cell", "z"])

    return place


def _router(projection: Projection, shared, limit: float):
    """Adds to queries the cells whose boxes lie within the radius at which they stop, and its home cell (the nearest box)."""

    def route(batches):
        cells, low, high = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("vector"), projection.width)
            near = box_distance(projection.of_queries(q), low, high)
            floor = batch.column("floor").to_numpy()
            stop = np.where(np.isneginf(floor), np.inf, limit * projection.squared_distance(q, floor))
            hit = near <= stop[:, None] * (1 + SLACK)
            ends = np.concatenate(([0], np.cumsum(hit.sum(axis=1)))).astype(np.int32)
            to = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells[np.nonzero(hit)[1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[near.argmin(axis=1)]), to], [*batch.schema.names, "home", "cells"])

    return route


def nearest(
    vectors: DataFrame, query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST, projections: int = PROJECTIONS,
    confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row that ``query`` picks, the ``k`` rows of largest inner product found."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"), query.alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("vector", zero=False)).withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    squared = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    n, shortest, width, longest = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector")), F.max(squared)).first()
    if shortest != width:
        raise ValueError("vectors of different dimensions")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    projection, limit = Projection(width, longest * (1 + SLACK), projections), chi_square_at(projections, confidence)
    levels = min(LEVELS, max(0, math.ceil(math.log2(n / cell_rows))))
    fitted = rows.filter(F.pmod("deal", F.lit(-(-n // sample))) == 0).limit(2 * sample).select("vector").toArrow()
    tree = Tree(projection.of(matrix(fitted.column("vector"), width)), levels)
    placed = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("z", T.ArrayType(T.DoubleType()))])
    rows = cut_lineage(rows.mapInArrow(_placer(projection, spark.sparkContext.broadcast(tree)), placed))
    edges = [f(F.get("z", F.lit(j))) for f in (F.min, F.max) for j in range(projections)]
    boxes = sorted(tuple(r) for r in rows.groupBy("cell").agg(F.count(F.lit(1)), *edges).collect())  # a row a cell
    low, high = np.array([b[2 : 2 + projections] for b in boxes]), np.array([b[2 + projections :] for b in boxes])
    shared = spark.sparkContext.broadcast((np.array([b[0] for b in boxes], np.int32), low, high))
    parts = [1] * (1 << levels)
    for cell, size, *_ in boxes:
        parts[cell] = -(-size // cell_rows)
    n_parts = F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1) if len(parts) > 1 else F.lit(parts[0])
    rows = rows.select("vec_id", "vector", "cell", F.pmod("deal", n_parts).cast("int").alias("part"), "is_query")
    asked = rows.filter("is_query").select(F.xxhash64("vec_id", "vector").alias("key"), "vec_id", "vector").dropDuplicates(["key", "vec_id"])
    asked = asked.withColumn("floor", F.lit(float("-inf")))
    routed = T.StructType([*asked.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    asked = cut_lineage(asked.mapInArrow(_router(projection, shared, limit), routed).drop("cells"))
    per_home = {r[0]: -(-r[1] // block_rows) for r in asked.groupBy("home").count().collect()}  # a row a cell
    splits = [per_home.get(c, 1) for c in range(1 << levels)]
    n_splits = F.element_at(F.array(*map(F.lit, splits)), F.col("home") + 1) if len(splits) > 1 else F.lit(splits[0])
    asked = asked.withColumn("split", F.pmod("key", n_splits).cast("int"))
    run, rows = _part(projection, k, limit), rows.drop("is_query")

    def visited(queries: DataFrame) -> DataFrame:
        """``queries`` (cell, part, home, split) against the rows of their parts; a part goes to each block of queries that asks for it."""
        group = ["cell", "part", "home", "split"]
        blocks = queries.select(*[F.col(c).alias(f"to_{c}") for c in group]).distinct()
        sent = rows.join(blocks, (F.col("cell") == F.col("to_cell")) & (F.col("part") == F.col("to_part"))).drop("cell", "part")
        return queries.groupBy(*group).cogroup(sent.groupBy(*[f"to_{c}" for c in group])).applyInArrow(run, FOUND)

    order = [F.desc("score"), F.asc("vec_id")]
    first = cut_lineage(visited(asked.withColumn("cell", F.col("home")).withColumn("part", F.lit(0))))
    if n <= cell_rows:
        return _result(ranked(first, ["key", "query_id"], order, k))
    floors = first.groupBy("key", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    floored = asked.join(floors.select("key", F.col("query_id").alias("vec_id"), "least"), ["key", "vec_id"], "left")
    floored = floored.select("key", "vec_id", "vector", F.coalesce("least", "floor").alias("floor"), "split")
    later = floored.mapInArrow(_router(projection, shared, limit), T.StructType([*floored.schema.fields, *routed.fields[-2:]]))
    later = later.withColumn("cell", F.explode("cells")).drop("cells").withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    later = visited(later.filter("cell <> home or part <> 0"))
    return _result(ranked(first.unionAll(later), ["key", "query_id"], order, k))


def _result(best: DataFrame) -> DataFrame:
    return best.select("query_id", "rank", "vec_id", "score")


def op12_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
