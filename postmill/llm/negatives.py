"""Operator 11: hard negatives from anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster, a candidate's angular upper bound is its length times the cosine of its
angle to the centroid less the widest angle of a member: no member of length 1 can score higher. Candidates are sorted by that
bound once, and every member walks the list in steps until its certificate holds: the bound of the next candidate, times the
member's length, is below what the member still needs. Everything walked is scored exactly, so results are exact.

Two walks go over the lists: for positives (the best rows of the anchor's own label) and, once they are known, for negatives
(the best rows of other labels in each positive's window of scores). A list is dealt by hash to parts of ``PART_ROWS``
candidates, and anchors to groups of ``GROUP_ROWS``, both through the shuffle, so a task holds one part and one group and
nothing is broadcast but centroids (256 at most). One part of every list is walked first; what it gives each member is a floor
for the rest, and a candidate whose bound is below the floors of a whole cluster isn't sent there: that stretch of the list is
certified without a task.

Centroids are fitted on at most about ``SAMPLE`` anchors; they steer the order of work only. Where directions are spread evenly
over many dimensions no angular bound separates rows, and lists are walked to their ends.

Rows with a null id, label or vector, an empty vector, or a component that is null or not finite take no part. Vectors of
different dimensions raise an error, as do scores beyond 2^53. Ties go to smaller ids. Equal anchor rows count once;
anchors that share an id but not the row are mined apart; candidates of the anchor's own id are never its partners; equal
candidate rows are candidates each. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import cut_lineage
from postmill.llm.ranking import best_of, matrix, ranked, usable

PART_ROWS = 8192
GROUP_ROWS = 4096
SAMPLE = 4096
MEMBERS = 64
CLUSTERS = 256
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95
STEP, CELLS = 512, 1 << 21
SLACK = 1e-7

FOUND = "key long, anchor_id long, win int, vec_id long, score long"
_FOUND = pa.schema([("key", pa.int64()), ("anchor_id", pa.int64()), ("win", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole(column, width: int) -> np.ndarray:
    """Vectors with each component x as floor(256 * x), in doubles: their products are exact below 2^53."""
    return np.floor(SCALE * matrix(column, width))


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def units(rows: np.ndarray) -> np.ndarray:
    norm = lengths(rows)[:, None]
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def fit_centroids(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: ``k`` unit vectors at most."""
    rows = units(rows)
    rows = rows[rows.any(axis=1)]
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    centres = rows[np.random.default_rng(1).permutation(len(rows))[:k]]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = units(sums)[np.bincount(own, minlength=len(centres)) > 0]
    return centres


class Lists:
    """What all tasks know of the shared lists: a centroid, the widest angle of a member, and the groups of each cluster."""

    def __init__(self, centres: np.ndarray, widest: dict[int, float], sizes: dict[int, int], group_rows: int):
        self.centres = centres
        self.widest = np.array([widest.get(c, 0.0) for c in range(len(centres))])
        self.first, self.splits = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
        group, room = -1, 0
        for c in range(len(centres)):
            n = sizes.get(c, 0)
            if n > room:
                self.splits[c] = max(1, -(-n // group_rows))
                self.first[c] = group + 1
                group, room = group + int(self.splits[c]), group_rows - n if n <= group_rows else 0
            else:
                self.first[c], room = max(group, 0), room - n
        self.groups = max(group + 1, 1)

    def bounds(self, rows: np.ndarray, cluster: int | slice = slice(None)) -> np.ndarray:
        """The most that a member of length 1 can score, for each row (and cluster)."""
        own, products = lengths(rows), rows @ self.centres[cluster].T
        own = own if products.ndim == 1 else own[:, None]
        cosine = np.clip(np.divide(products, own, out=np.ones_like(products), where=own > 0), -1, 1)
        return own * np.cos(np.maximum(0.0, np.arccos(cosine) - self.widest[cluster]))


def step_through(vectors: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, bounds: np.ndarray, k: int, apart=None):
    """Members walk one sorted list; for each member and window the ``k`` best rows of a score from low to high.

    ``apart`` says, for members and rows by their places, which pairs don't count. Returns (member, window, row, score).
    """
    n, wins = low.shape
    need, norms = low.copy(), lengths(vectors)
    owner, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    active, pos, size = np.arange(n), 0, STEP
    while pos < len(rows):
        reach = norms[active] * bounds[pos] * (1 + SLACK) + SLACK
        active = active[reach >= need[active].min(axis=1)]  # the certificate: no later row can matter
        if not len(active):
            break
        end, size = pos + size, min(2 * size, max(STEP, CELLS // len(active)))
        for cut in range(0, len(active), CELLS // STEP):
            own = active[cut : cut + CELLS // STEP]
            products = vectors[own] @ rows[pos:end].T
            out = ids[own][:, None] == row_ids[None, pos:end]
            products[out if apart is None else out | apart(own, slice(pos, end))] = np.nan
            for w in range(wins):
                hit = (products >= need[own, w][:, None]) & (products <= high[own, w][:, None])
                if np.count_nonzero(hit) > 8 * k * len(own) and hit.shape[1] > k:  # most of a first step falls behind its own k best
                    hit &= products >= np.partition(np.where(hit, products, -np.inf), -k, axis=1)[:, -k:][:, :1]
                member, row = np.nonzero(hit)
                if len(member):
                    owner = np.concatenate((owner, own[member] * wins + w))
                    at, score = np.concatenate((at, row + pos)), np.concatenate((score, products[member, row]))
            best = best_of(owner, score, row_ids[at], k)
            owner, at, score = owner[best], at[best], score[best]
            full, count = np.unique(owner, return_counts=True)
            full = full[count == k]
            if len(full):
                last = np.searchsorted(owner, full, "right") - 1
                need.reshape(-1)[full] = np.maximum(need.reshape(-1)[full], score[last])
        pos = end
    return owner // wins, owner % wins, at, score


def _cell(shared, width: int, k: int, same: bool):
    def walk(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not anchors.num_rows or not candidates.num_rows:
            return _FOUND.empty_table()
        lists: Lists = shared.value
        own, rows = whole(anchors.column("vector"), width), whole(candidates.column("vector"), width)
        if lengths(own).max() * lengths(rows).max() >= 2.0**53:
            raise ValueError("components are too large: a score may pass 2^53")
        keys, ids, cluster = (anchors.column(c).to_numpy() for c in ("key", "vec_id", "cluster"))
        low, high = (np.asarray(anchors.column(c).combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1) for c in ("low", "high"))
        row_ids = candidates.column("vec_id").to_numpy()
        labels = np.concatenate((anchors.column("label").to_numpy(zero_copy_only=False), candidates.column("label").to_numpy(zero_copy_only=False)))
        _, labels = np.unique(labels, return_inverse=True)
        label, row_label = labels[: len(ids)], labels[len(ids) :]
        out = []
        for c in np.unique(cluster):
            bounds = lists.bounds(rows, int(c))
            order = np.argsort(-bounds, kind="stable")  # the list of the cluster, sorted once
            mine = np.flatnonzero(cluster == c)
            if same:
                for one in np.unique(label[mine]):
                    member, some = mine[label[mine] == one], order[row_label[order] == one]
                    m, w, r, s = step_through(own[member], ids[member], low[member], high[member], rows[some], row_ids[some], bounds[some], k)
                    out.append((member[m], w, row_ids[some][r], s))
            else:
                apart = lambda m, r, mine=mine, order=order: label[mine[m]][:, None] == row_label[order[r]][None, :]
                m, w, r, s = step_through(own[mine], ids[mine], low[mine], high[mine], rows[order], row_ids[order], bounds[order], k, apart)
                out.append((mine[m], w, row_ids[order][r], s))
        m, w, r, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([keys[m], ids[m], w.astype(np.int32), r, s.astype(np.int64)], schema=_FOUND)

    return walk


def _walks(anchors: DataFrame, rows: DataFrame, shared, width: int, parts: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best by (key, window) of all rows with part, for anchors with windows low and high."""
    left = anchors.select("key", "vec_id", "label", "vector", "cluster", "grp", "low", "high")
    kind, order = _cell(shared, width, k, same), [F.desc("score"), F.asc("vec_id")]

    def walked(members: DataFrame, some: DataFrame) -> DataFrame:
        return members.groupBy("grp", "part").cogroup(some.groupBy("grp", "part")).applyInArrow(kind, FOUND)

    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shared.value.groups - 1)))
    opening = walked(left.withColumn("part", F.lit(0)), rows.filter("part = 0").withColumn("grp", everywhere))
    if parts == 1:
        return cut_lineage(ranked(opening, ["key", "anchor_id", "win"], order, k))
    opening = cut_lineage(opening)
    floors = opening.groupBy("key", "win").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
    floors = floors.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("win", "floor"))).alias("floors"))  # a key has 5 windows at most
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("floors", i).cast("double"), F.lit(float("-inf")))))
    left = cut_lineage(left.join(floors, "key", "left").withColumn("low", raised).drop("floors"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.floor(SCALE * x.cast("double")).cast("double") * F.floor(SCALE * x.cast("double")).cast("double")))
    least = F.when(norm == 0, F.when(F.array_min("low") <= 0, float("-inf")).otherwise(float("inf"))).otherwise(F.array_min("low") / norm)
    needs = {r[0]: r[1] for r in left.groupBy("cluster").agg(F.min(least)).collect()}  # a row a cluster
    rest = rows.filter("part > 0").mapInArrow(_sender(shared, width, needs), T.StructType([*rows.schema.fields, T.StructField("grps", T.ArrayType(T.IntegerType()))]))
    rest = rest.withColumn("grp", F.explode("grps")).drop("grps")
    later = walked(left.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts - 1)))), rest)
    return cut_lineage(ranked(opening.unionAll(later), ["key", "anchor_id", "win"], order, k))


def _sender(shared, width: int, needs: dict[int, float]):
    """Adds to candidates the groups that may need them: those of clusters where the bound reaches the least need."""

    def send(batches):
        lists: Lists = shared.value
        need = np.array([needs.get(c, np.inf) for c in range(len(lists.centres))])
        touched = np.zeros((len(need), lists.groups), bool)
        for c, (first, splits) in enumerate(zip(lists.first, lists.splits, strict=True)):
            touched[c, first : first + splits] = c in needs
        for batch in batches:
            if not batch.num_rows:
                continue
            reached = lists.bounds(whole(batch.column("vector"), width)) * (1 + SLACK) + SLACK >= need[None, :]
            hit = reached.astype(np.float32) @ touched.astype(np.float32) > 0
            ends = np.concatenate(([0], np.cumsum(hit.sum(axis=1)))).astype(np.int32)
            groups = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(hit)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, groups], [*batch.schema.names, "grps"])

    return send


def mine(
    vectors: DataFrame, anchor: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, part_rows: int = PART_ROWS, group_rows: int = GROUP_ROWS, members: int = MEMBERS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` tells which rows are anchors. A negative of a positive of score p scores from ``least`` to ``most`` percent of p.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("vector"), anchor.alias("is_anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector", zero=True))
    rows = cut_lineage(rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    n, shortest, width = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if shortest != width:
        raise ValueError("vectors of different dimensions")
    chosen = rows.filter("is_anchor").select(F.xxhash64("vec_id", "label", "vector").alias("key"), "vec_id", "label", "vector").dropDuplicates(["key", "vec_id"])
    n_anchors = chosen.count() if n else 0
    if not n_anchors:
        return spark.createDataFrame([], schema)
    parts = -(-n // part_rows)
    rows = rows.select("vec_id", "label", "vector", F.pmod("deal", F.lit(parts)).cast("int").alias("part"))
    sample = chosen.filter(F.pmod("key", F.lit(-(-n_anchors // SAMPLE))) == 0).limit(2 * SAMPLE).select("vector").toArrow()
    centres = fit_centroids(whole(sample.column("vector"), width), min(CLUSTERS, max(1, n_anchors // members)))
    dealt = cut_lineage(chosen.mapInArrow(_assigner(spark.sparkContext.broadcast(centres), width), T.StructType([*chosen.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType())])))
    widest, sizes = {}, {}
    for c, angle, size in dealt.groupBy("cluster").agg(F.max("angle"), F.count(F.lit(1))).collect():  # a row a cluster
        widest[c], sizes[c] = angle + SLACK, size
    shared = spark.sparkContext.broadcast(Lists(centres, widest, sizes, group_rows))
    first, splits = (F.array(*map(F.lit, x.tolist())) for x in (shared.value.first, shared.value.splits))
    split = F.pmod("key", F.element_at(splits, F.col("cluster") + 1))
    anchors = dealt.withColumn("grp", (F.element_at(first, F.col("cluster") + 1) + split).cast("int"))
    anything = anchors.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    good = _walks(anything, rows, shared, width, parts, positives, True)
    good = good.select("key", (F.col("rank") - 1).cast("int").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    low = F.expr(f"cast(ceil(cast({least} * positive_score as decimal(38, 0)) / 100) as double)")
    high = F.expr(f"cast(floor(cast({most} * positive_score as decimal(38, 0)) / 100) as double)")
    windows = good.filter("positive_score >= 0").select("key", F.struct("win", low.alias("low"), high.alias("high")).alias("one"))
    windows = windows.groupBy("key").agg(F.array_sort(F.collect_list("one")).alias("all")).select("key", F.col("all.win").alias("wins"), F.col("all.low").alias("low"), F.col("all.high").alias("high"))
    more = F.sequence(F.lit(1), F.lit(positives))  # each anchor has as many windows; those it lacks hold nothing
    fill = lambda c, none: F.transform(more, lambda i: F.coalesce(F.get(c, i - 1), F.lit(none)))
    hunted = anchors.join(windows, "key").withColumn("low", fill(F.col("low"), float("inf"))).withColumn("high", fill(F.col("high"), float("-inf")))
    bad = _walks(hunted, rows, shared, width, parts, negatives, False)
    found = bad.select("key", "anchor_id", "win", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(good, ["key", "win"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _assigner(shared, width: int):
    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cosine = np.clip(units(whole(batch.column("vector"), width)) @ shared.value.T, -1, 1)
                own = cosine.argmax(axis=1)
                angle = np.where(cosine.any(axis=1), np.arccos(cosine[np.arange(len(own)), own]), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cluster", "angle"])

    return assign


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


ORACLE = {
    "op11_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
g AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM p WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT g.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3
""",
}
