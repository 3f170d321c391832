"""Operator 4: SimHash near-duplicates by BK-trees.

Fingerprints: one pass over whole texts, one 64-bit number a document; a long text is hashed a slice at a time. Links:
candidates meet in buckets, every bucket is cut into shards of at most ``SHARD`` fingerprints, each shard gets a
BK-tree, whose children are keyed by their integer Hamming distance to the parent, and the bucket's fingerprints descend
it along edges within the radius of their own distance. Two ways to deal fingerprints to buckets:

* ``near_components`` (fingerprints within 4 bits): two fingerprints within ``radius`` bits agree on at least one choice
  of ``blocks - radius`` of their ``blocks`` blocks, so distinct fingerprints are dealt to buckets by every such choice;
  with more fingerprints there are more blocks and the buckets stay small (the result is the same for any number). A
  bucket of more than ``RECUT`` fingerprints is dealt anew by choices of blocks of its other bits; no link is lost by that.
* ``one_of_each`` (five-word shingles, Jaccard similarity of 0.8 or more): 0.8 is about 10 of 64 bits, and block choices for
  such a radius leave no small buckets. Distinct texts are dealt by min-wise keys of their shingles, ``bands`` keys of ``rows``
  minima each, which two texts of similarity 0.8 share at least one of in 0.987 of cases; trees are searched with radius 14
  (0.96 of pairs of similarity 0.8 to 0.85, all but a few above), and links are checked by the exact Jaccard similarity of
  whole shingle sets: first a spanning forest, nearest links first, which joins most groups; then every pair found of texts that are
  still apart, so a link that fails takes no other's place. These pairs grow with the square of a bucket and leave no task: a first
  search marks the texts that have a pair whose shingles, counted in ``BINS`` bins of their hashes, can reach the similarity (an upper
  bound, so none is lost); a second has the shingle sets of the marked texts, checks pairs where it finds them and returns only
  links that join two groups of its bucket. Measured recall is in the README.

The shard trees are sent to tasks by shuffling (bucket, shard), not by broadcast: together they are as large as the
set of fingerprints, which has no bound. A bucket with several shards sends each pair of shards to a task group by
itself, so no group exceeds two shards. Where links need no further check, only a spanning forest of those that a group found is
kept: no link is lost for the components, and a group of n near copies leaves n - 1 rows.

Nulls: a null text has no words; its fingerprint is zero and links like any other; all texts without words are one group.
A null id is never the smallest of its component unless all are null. Ids may repeat, with equal or other texts. Equal rows
are copies. Very long texts need some 15 times their size at most in a task. Columns of any name may stand beside id and text.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import broadcast_if_small, cut_lineage, ranges, sliced, text_bytes, unclashed
from postmill.llm.components import components

SHINGLE = 4
RADIUS = 4
TEXT_SHINGLE = 5
SIMILARITY = 0.8
TEXT_RADIUS = 14
BANDS, ROWS = 11, 5
BATCH_BYTES = 1 << 20
SLICE = 100_000
SHARD = 4096
RECUT = 1 << 18
BUCKET_TARGET = 64
HOT = 10_000
SALTS = 16
FRONTIER = 1 << 20
BINS, FULL = 64, (1 << 16) - 1
SETS = 1 << 21  # shingles of a group of texts and their sets

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DRAW = np.random.default_rng(20)
_FACTORS = _DRAW.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_line(text: bytes) -> bytes:
    """The lower-cased words with one space between them."""
    at = np.frombuffer(text.translate(_LOWER), np.uint8)
    space = (at == 32) | ((at >= 9) & (at <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space after a word
    return np.where(space, np.uint8(32), at)[keep].tobytes().strip(b" ")


def shingle_hashes(line: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a word line, at most ``SLICE`` at a time."""
    if not line:
        return
    digest = xxhash.xxh64_intdigest
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    if len(ends) <= size:
        yield np.array([digest(line, 42)], np.uint64)
        return
    for k in range(0, len(ends) - size + 1, SLICE):
        stop = ends[k + size - 1 : k + size - 1 + SLICE].tolist()
        start = (ends[k : k + len(stop) - 1] + 1).tolist()
        start.insert(0, int(ends[k - 1]) + 1 if k else 0)
        yield np.array([digest(line[a:b], 42) for a, b in zip(start, stop, strict=True)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """SimHash of each text, as uint64."""
    bits = np.zeros((len(texts), 64), bool)
    for i, t in enumerate(texts):
        n, ones = 0, np.zeros(64, np.int64)
        for h in shingle_hashes(word_line(t), size):
            n += len(h)
            ones += _ones(h)
        bits[i] = 2 * ones > n
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` (default: all but the text) and ``name``, the SimHash as a signed long."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    base = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(base.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches):
        for batch in sliced(batches, "__text", BATCH_BYTES):
            fps = fingerprints_of(text_bytes(batch, "__text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps)], [*keep, name])

    return base.mapInArrow(run, schema)


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of the permuted hashes."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        x = hashes[k : k + 4096] * _FACTORS[:, None]
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    return least


def distinct_hashes(line: bytes, size: int) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(line, size)]))


def signature(text: bytes, size: int = TEXT_SHINGLE) -> tuple[int, int, int, list[int], list[int]]:
    """Two halves of a 128-bit digest of the word line, its SimHash, its min-wise keys (none without words), all signed, and how
    many distinct shingles have each of ``BINS`` remainders, four counts to a long."""
    line = word_line(text)
    n, ones, least = 0, np.zeros(64, np.int64), _minima(np.empty(0, np.uint64))
    parts = list(shingle_hashes(line, size))
    distinct = np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))
    bins = np.minimum(np.bincount((distinct % np.uint64(BINS)).astype(np.int64), minlength=BINS), FULL).astype(np.uint16)
    for h in parts:
        n += len(h)
        ones += _ones(h)
        np.minimum(least, _minima(h), out=least)
    bits = np.packbits(2 * ones > n, bitorder="little").view(np.int64)
    keys = np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    digest = np.frombuffer(xxhash.xxh3_128_digest(line), np.int64)
    return int(digest[0]), int(digest[1]), int(bits[0]), keys.view(np.int64).tolist() if n else [], bins.view(np.int64).tolist()


def signatures(docs: DataFrame, shingle: int = TEXT_SHINGLE) -> DataFrame:
    """(doc_id, raw, hi, lo, fp, keys, bins) of every row of (doc_id, text); raw is a hash of the text as it stands."""
    base = docs.select("doc_id", F.xxhash64("text").alias("raw"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in sliced(batches, "text", BATCH_BYTES):
            hi, lo, fp, keys, bins = zip(*(signature(t, shingle) for t in text_bytes(batch, "text")), strict=True)
            columns = [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(fp, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, bins))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), *columns], ["doc_id", "raw", "hi", "lo", "fp", "keys", "bins"])

    fields = [T.StructField(c, T.LongType()) for c in ("raw", "hi", "lo", "fp")]
    return base.mapInArrow(run, T.StructType([base.schema["doc_id"], *fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("keys", "bins"))]))


class Forest:
    """BK-trees of many shards at once: arrays of nodes, children found by (parent, distance)."""

    def __init__(self, fps: np.ndarray, tree: np.ndarray):
        """``tree`` numbers the shard of each fingerprint, ascending; the first of each is its root."""
        n = len(fps)
        self.fps = fps
        first = np.concatenate(([True], tree[1:] != tree[:-1]))
        self.roots = np.flatnonzero(first)
        at = self.roots[np.cumsum(first) - 1]
        todo = np.flatnonzero(~first)
        keys, nodes = [], []
        while len(todo):  # a level of all trees at a time
            key = at[todo] * 65 + np.bitwise_count(fps[todo] ^ fps[at[todo]])
            _, pos, back = np.unique(key, return_index=True, return_inverse=True)
            child = todo[pos]
            keys.append(key[pos])
            nodes.append(child)
            at[todo] = child[back]
            todo = todo[at[todo] != todo]
        keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], (np.concatenate(nodes)[order] if len(order) else np.empty(0, np.int64))
        assert len(self.nodes) + len(self.roots) == n

    def search(self, fps: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, a bounded part at a time; each query starts at its root."""
        stack = [(np.arange(len(fps)), roots)]
        while stack:
            q, at = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[i : i + FRONTIER], at[i : i + FRONTIER]) for i in range(0, len(q), FRONTIER)]
                continue
            d = np.bitwise_count(fps[q] ^ self.fps[at]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], at[near]
            lo = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), "right")
            if (hi > lo).any():
                stack.append((np.repeat(q, hi - lo), self.nodes[ranges(lo, hi - lo)]))


class Spanning:
    """Union-find over small integers that keeps only the pairs that joined two sets."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out_a, out_b = [], []
        while True:
            la, lb = self.label[a], self.label[b]
            open_ = la != lb
            if not open_.any():
                break
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            hi, lo = np.maximum(la, lb), np.minimum(la, lb)
            order = np.lexsort(((a * 0x9E3779B1 ^ b * 0x85EBCA77) & 0xFFFFFFFF, hi))  # any smaller set, so that no node gets all links
            first = order[np.concatenate(([True], hi[order][1:] != hi[order][:-1]))]  # one smaller set for each set
            out_a.append(a[first])
            out_b.append(b[first])
            self.label[hi[first]] = lo[first]
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up
        empty = np.empty(0, np.int64)
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def blocks_for(n: int, radius: int, target: int = BUCKET_TARGET) -> int:
    """The least number of blocks that leaves about ``target`` of n spread fingerprints in a bucket."""
    blocks = radius + 1
    while blocks < radius + 5 and n / 2 ** (64 * (blocks - radius) / blocks) > target:
        blocks += 1
    return blocks


def bucket_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius blocks, the mask of their bits, as a signed long."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def near_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, blocks: int | None = None, recut: int = RECUT) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of column ``fp`` that connect all within ``radius`` bits."""
    spark = fps.sparkSession
    masks = bucket_masks(blocks or blocks_for(fps.count(), radius), radius)
    choice = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(choice).alias("c")).select(
        F.col("c.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("bits"), "fp", F.col("fp").alias("node"))
    counts = bucket_counts(dealt, ["choice", "bits"])
    links = bucket_links(dealt, counts.filter(F.col("count") <= recut), ["choice", "bits"], (radius,), shard)
    huge = counts.filter(F.col("count") > recut).select("choice", "bits")
    if not huge.isEmpty():
        # Members of a bucket differ in its other bits alone: those are cut into 2 * radius blocks, of which radius agree.
        table = [(i, j, m) for i, taken in enumerate(masks) for j, m in enumerate(_other_masks(taken, radius))]
        other = spark.createDataFrame(table, "choice int, sub int, mask long")  # some thousand rows
        again = dealt.join(huge, ["choice", "bits"]).join(F.broadcast(other), "choice")
        again = again.select("choice", "bits", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("bits2"), "fp", "node")
        keys = ["choice", "bits", "sub", "bits2"]
        links = links.unionAll(bucket_links(again, bucket_counts(again, keys), keys, (radius,), shard))
    return links.distinct()


def _other_masks(taken: int, radius: int) -> list[int]:
    """Masks of the choices of radius out of 2 * radius blocks of the bits that are not in ``taken``."""
    free = [b for b in range(64) if not taken >> b & 1]
    edges = [round(len(free) * i / (2 * radius)) for i in range(2 * radius + 1)]
    parts = [sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def bucket_counts(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """The buckets of two rows or more, with their counts."""
    return cut_lineage(dealt.groupBy(*keys).count().filter(F.col("count") > 1))


def bucket_groups(dealt: DataFrame, counts: DataFrame, keys: list[str], own: list[str], shard: int = SHARD) -> DataFrame:
    """(bucket, i, j, side) and the columns ``own`` of the rows of ``counts``' buckets, dealt to the groups that are searched.

    ``counts`` has the number of shards of a bucket in column ``k``, or its rows in column ``count``.
    """
    key = F.xxhash64(*keys)
    k = F.col("k") if "k" in counts.columns else F.when(F.col("count") <= shard, 1).otherwise(F.ceil(F.col("count") / F.lit(shard / 2)))
    counts = counts.select(*keys, k.cast("int").alias("k"))
    zero = [F.lit(0).alias(c) for c in ("i", "j", "side")]
    groups = dealt.join(counts.filter("k = 1").select(*keys), keys, "left_semi").select(key.alias("bucket"), *zero, *own)
    large = counts.filter("k > 1")
    if not large.isEmpty():
        # Each fingerprint of a large bucket goes to the pairs of shards that hold its own.
        hot = dealt.join(large, keys)
        hot = hot.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int"))
        hot = hot.select(key.alias("bucket"), "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"), *own)
        groups = groups.unionAll(hot.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), *own))
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "fp", "node")


def bucket_links(dealt: DataFrame, counts: DataFrame, keys: list[str], levels: tuple[int, ...], shard: int = SHARD) -> DataFrame:
    """Links (a, b) between nodes of one bucket that connect all whose fp are within the last of ``levels`` bits.

    ``dealt`` has the bucket's keys, fp and node; only the buckets of ``counts`` are searched. Links within the first
    level are taken before those of the next, so a far link stands only where no nearer ones connect its ends.
    """

    def run(batches):
        for batch in _whole_groups(batches):
            yield from _linked(_numbers(batch, "fp", "node"), levels)

    return bucket_groups(dealt, counts, keys, ["fp", "node"], shard).mapInArrow(run, "a long, b long").distinct()


def open_nodes(dealt: DataFrame, counts: DataFrame, keys: list[str], radius: int, similarity: float, shard: int = SHARD) -> DataFrame:
    """(bucket, node) of the nodes that have a pair in the bucket within the radius that differs in column ``joined`` and can be that
    similar by column ``bins``: a row a node and group at most."""

    def run(batches):
        for batch in _whole_groups(batches):
            bins = np.asarray(batch.column("bins").combine_chunks().flatten()).reshape(batch.num_rows, -1)
            rows = _numbers(batch, "fp", "node", "joined")
            marked = rows[:, _open(rows, np.ascontiguousarray(bins).view(np.uint16), radius, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array(marked[0]), pa.array(marked[5])], ["bucket", "node"])

    return bucket_groups(dealt, counts, keys, ["fp", "node", "joined", "bins"], shard).mapInArrow(run, "bucket long, node long").distinct()


def set_links(rows: DataFrame, radius: int, similarity: float, shard: int = SHARD, sets: int = SETS) -> DataFrame:
    """Links (a, b) between values of ``joined`` that connect all nodes of a bucket within the radius whose ``shingles``, distinct
    hashes, have at least that Jaccard similarity. ``rows``: bucket, fp, node, joined, shingles."""
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.sum(F.size("shingles")).alias("total"))
    parts = lambda c, most: F.when(F.col(c) <= most, 1).otherwise(F.ceil(F.col(c) / F.lit(most / 2)))
    counts = cut_lineage(size.filter("count > 1").select(F.col("bucket"), F.greatest(parts("count", shard), parts("total", sets)).alias("k")))

    def run(batches):
        for batch in _whole_groups(batches):
            numbers, shingles = _numbers(batch, "fp", "node", "joined"), batch.column("shingles").combine_chunks()
            ends = shingles.offsets.to_numpy().astype(np.int64)
            first = np.concatenate(([0], np.flatnonzero((numbers[:3, 1:] != numbers[:3, :-1]).any(axis=0)) + 1))
            at = 0
            while at < len(first):  # groups of bounded sets at a time
                stop = max(at + 1, int(np.searchsorted(ends[first], ends[first[at]] + sets, "right")) - 1)
                lo, hi = first[at], first[stop] if stop < len(first) else batch.num_rows
                yield from _similar(numbers[:, lo:hi], shingles.slice(lo, hi - lo), radius, similarity)
                at = stop

    return bucket_groups(rows, counts, ["bucket"], ["fp", "node", "joined", "shingles"]).mapInArrow(run, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut where groups (bucket, i, j) end."""
    held: list[pa.RecordBatch] = []  # of the group that the last batch may not have ended
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "i", "j")])
        new = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        cut = int(new[-1]) if len(new) else 0
        if held and not cut and (group[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = group[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _numbers(batch: pa.Table, *columns: str) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "i", "j", "side", *columns)])


def _searches(rows: np.ndarray) -> tuple[Forest, list[tuple[np.ndarray, np.ndarray]]]:
    """Of whole groups, which stand one after another, the trees and what to search: rows and the root that each starts at. First
    every row against its own shard's tree, then the second shard's against the first's."""
    fps = np.ascontiguousarray(rows[4]).view(np.uint64)
    group = np.concatenate(([0], np.cumsum((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))
    tree = group * 2 + rows[3]
    forest = Forest(fps, tree)
    own = np.searchsorted(tree[forest.roots], tree)
    sets = [(np.arange(len(fps)), forest.roots[own])]
    two = np.flatnonzero(rows[3] == 1)
    if len(two):
        other = np.searchsorted(tree[forest.roots], tree[two] - 1)
        fits = tree[forest.roots[np.minimum(other, len(forest.roots) - 1)]] == tree[two] - 1
        sets.append((two[fits], forest.roots[other[fits]]))
    return forest, sets


def _linked(rows: np.ndarray, levels: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The spanning links of whole groups."""
    node, (forest, sets) = rows[5], _searches(rows)
    joined = Spanning(len(node))
    for radius in levels:
        for q, roots in sets:
            for a, b in forest.search(forest.fps[q], roots, radius):
                a, b = joined.add(q[a], b)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def _pairs(rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of whole groups within the radius that is not joined, a bounded part at a time; pairs of one shard come from its own
    group alone."""
    node, joined, (forest, sets) = rows[5], rows[6], _searches(rows)
    alone = rows[1] == rows[2]
    sets[0] = tuple(x[alone] for x in sets[0])
    for q, roots in sets:
        for a, b in forest.search(forest.fps[q], roots, radius):
            a = q[a]
            apart = (joined[a] != joined[b]) & ((rows[3, a] != rows[3, b]) | (node[a] < node[b]))
            a, b = a[apart], b[apart]
            for k in range(0, len(a), FRONTIER >> 4):
                yield a[k : k + (FRONTIER >> 4)], b[k : k + (FRONTIER >> 4)]


def _open(rows: np.ndarray, bins: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Which rows have a pair that can be that similar."""
    marked = np.zeros(rows.shape[1], bool)
    for a, b in _pairs(rows, radius):
        new = ~(marked[a] & marked[b])
        a, b = a[new], b[new]
        able = can_be(bins[a], bins[b], similarity)
        marked[a[able]] = marked[b[able]] = True
    return marked


def _similar(rows: np.ndarray, shingles: pa.ListArray, radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links between the values of ``joined`` of pairs that are that similar, as far as they join what is apart."""
    size = np.diff(shingles.offsets.to_numpy().astype(np.int64))
    start = np.cumsum(size) - size
    _, word = np.unique(np.asarray(shingles.flatten()), return_inverse=True)
    root, own = np.unique(rows[6], return_inverse=True)
    spanning, mark = Spanning(len(root)), np.zeros(int(word.max(initial=0)) + 1, bool)
    for a, b in _pairs(rows, radius):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))) if len(a) else np.zeros(1, np.int64)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            x, y = a[lo], b[lo:hi]
            near = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
            y = y[near & (spanning.label[own[y]] != spanning.label[own[x]])]
            if not len(y):
                continue
            mark[word[start[x] : start[x] + size[x]]] = True
            found = [y[:0]]
            for part in np.split(y, np.flatnonzero(np.diff(np.cumsum(size[y]) // FRONTIER)) + 1):
                common = np.add.reduceat(mark[word[ranges(start[part], size[part])]], np.cumsum(size[part]) - size[part], dtype=np.int64)
                found.append(part[common >= similarity * (size[x] + size[part] - common)])
            mark[word[start[x] : start[x] + size[x]]] = False
            y = np.concatenate(found)
            p, q = spanning.add(np.full(len(y), own[x]), own[y])
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(root[p]), pa.array(root[q])], ["a", "b"])


def can_be(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these counts in bins, a row each, can have that Jaccard similarity; a full bin tells nothing."""
    full = ((x == FULL) | (y == FULL)).any(axis=1)
    common = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return full | (common >= similarity * (x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64) - common))


def join_groups(rows: DataFrame, table: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """``rows`` joined to ``table``, which has a row a key and the key's number of rows, n.

    Keys of ``hot`` rows or more, of which there are few, are broadcast (if their bytes allow), so that no task gets all
    rows of one. Both inputs should be cheap to read.
    """
    few = table.filter(F.col("n") >= hot)
    if few.isEmpty():
        return rows.join(table, keys)
    rest = rows.join(broadcast_if_small(few.select(*keys)), keys, "left_anti").join(table.filter(F.col("n") < hot), keys)
    columns = rest.columns
    return rest.unionAll(rows.join(broadcast_if_small(few), keys).select(*columns))


def with_least(table: DataFrame, roots: DataFrame, node: str, low: str) -> DataFrame:
    """``table`` (a row a node) with root and component_low, the least ``low`` of all nodes of its component, from the
    (node, root) of linked nodes.

    Nodes without a link answer for themselves; minima of linked ones are joined back to salted rows, so that a
    component of very many nodes is not gathered in a task.
    """
    joined = cut_lineage(table.join(roots.withColumnRenamed("node", node), node, "left"))
    alone = joined.filter("root is null").withColumns({"root": F.col(node), "component_low": F.col(low)})
    linked = joined.filter("root is not null")
    least = linked.groupBy("root").agg(F.min(low).alias("component_low"))
    salted = linked.withColumn("__salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int"))
    least = least.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return alone.unionByName(salted.join(least, ["root", "__salt"]).drop("__salt"))


def near_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id that links reach, for every row of ``docs``."""
    fps = cut_lineage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    least = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(least.select("fp"), radius))
    ids = cut_lineage(with_least(least, roots, "fp", "low").select("fp", "n", F.col("component_low").alias("component_id")))
    return join_groups(fps, ids, ["fp"]).select("doc_id", "fp", "component_id")


def text_components(docs: DataFrame, *, shingle: int = TEXT_SHINGLE, similarity: float = SIMILARITY, radius: int = TEXT_RADIUS) -> DataFrame:
    """(doc_id, raw, root, stays) of every row of (doc_id, text): its group of texts alike, and whether it has the id and text
    that stand for the group (the smallest id; of several texts with that id, one)."""
    rows = cut_lineage(signatures(docs, shingle))
    who = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("raw"))
    texts = rows.groupBy("hi", "lo").agg(F.min(who).alias("low"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("bins").alias("bins"))
    texts = cut_lineage(texts.withColumn("node", F.monotonically_increasing_id()))
    dealt = texts.select("fp", "node", F.explode("keys").alias("key"))
    counts, levels = bucket_counts(dealt, ["key"]), (radius // 2, radius)
    links = cut_lineage(alike(docs, texts, cut_lineage(bucket_links(dealt, counts, ["key"], levels)), shingle, similarity))
    joined = texts.select("node", "fp", "keys").join(components(links).withColumnRenamed("root", "joined"), "node", "left")
    still = joined.select("fp", "node", F.coalesce("joined", "node").alias("joined"), F.explode("keys").alias("key"))
    apart = still.join(counts.select("key"), "key").groupBy("key").agg(F.min("joined").alias("x"), F.max("joined").alias("y")).filter("x <> y")
    still = cut_lineage(still.join(apart.select("key"), "key", "left_semi")).join(texts.select("node", "bins"), "node")
    marked = cut_lineage(open_nodes(still, counts, ["key"], radius, similarity))
    if not marked.isEmpty():
        sets = cut_lineage(shingle_sets(docs, texts, marked.select("node").distinct(), shingle))
        near = marked.join(joined.select("node", "fp", F.coalesce("joined", "node").alias("joined")), "node").join(sets, "node")
        links = links.unionAll(set_links(near, radius, similarity))
    table = with_least(texts.select("node", "hi", "lo", "n", "low"), components(links), "node", "low")
    out = join_groups(rows.select("doc_id", "raw", "hi", "lo"), cut_lineage(table.select("hi", "lo", "n", "root", "component_low")), ["hi", "lo"])
    return out.select("doc_id", "raw", "root", (F.col("doc_id").eqNullSafe(F.col("component_low.doc_id")) & (F.col("raw") == F.col("component_low.raw"))).alias("stays"))


def shingle_sets(docs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles), the distinct hashes of the texts of ``nodes``; texts are read again."""
    wanted = cut_lineage(texts.join(nodes, "node").select("node", F.col("low.doc_id").alias("__id"), F.col("low.raw").alias("__raw")))
    base = docs.withColumn("raw", F.xxhash64("text"))
    base = base.join(broadcast_if_small(wanted), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("raw") == F.col("__raw"))).select("node", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in sliced(batches, "text", BATCH_BYTES):
            found = []
            for t in text_bytes(batch, "text"):
                found.append(distinct_hashes(word_line(t), shingle).view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, np.concatenate(found))], ["node", "shingles"])

    return base.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def alike(docs: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``links`` between texts whose sets of shingles have at least that Jaccard similarity."""
    ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).distinct()
    sets = shingle_sets(docs, texts, ends, shingle)
    both = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return common.filter(F.col("c") >= similarity * (F.col("n") - F.col("c"))).select("a", "b")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = TEXT_SHINGLE,
                similarity: float = SIMILARITY, radius: int = TEXT_RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that with the smallest id; all columns stay.

    Rows without an id stay only for groups that have none with an id. Of equal ids with other texts that stand for the
    same group, one row stays, and each group keeps exactly one row. The (id, text) pairs to drop or to thin out are
    broadcast if their bytes allow, and joined by a shuffle else.
    """
    names = docs.columns
    docs, (doc_id, text) = unclashed(docs, doc_id, text)
    rows = text_components(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle, similarity=similarity, radius=radius)
    pairs = rows.groupBy("doc_id", "raw").agg(F.bool_or("stays").alias("__stays"), F.count(F.lit(1)).alias("n"))
    other = cut_lineage(pairs.filter(~F.col("__stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"), "__stays"))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__raw"))
    kept = docs.join(broadcast_if_small(other), same, "left_anti")
    repeated = other.filter("__stays")
    if repeated.isEmpty():
        return kept.toDF(*names)
    thinned = docs.join(broadcast_if_small(repeated), same).dropDuplicates(["__id", "__raw"]).select(*docs.columns)
    return kept.unionAll(thinned).toDF(*names)


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
