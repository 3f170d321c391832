"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.llm import lexical, negatives, neighbours, queries, ranking
from tests.oracle import assert_same

CLASH = [f"__{c}" for c in ("salt", "rank")] + ["key", "part", "grp", "deal", "cell", "home", "split", "floor", "low", "high", "win", "score", "rank", "vector", "is_anchor", "is_query", "term", "n", "item", "z"]


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# 11, 12
def vectors(n, width, seed, clusters=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, width))
    if clusters:
        x = r.standard_normal((clusters, width))[r.integers(0, clusters, n)] * 4 + x * 0.3
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def embedding_rows(n=600, width=16, clusters=12):
    x = vectors(n, width, 5, clusters).astype(np.float32)
    rows = [(i, [float(c) for c in v], i % 5) for i, v in enumerate(x)]
    rows += [(n + i, rows[3][1], 3) for i in range(40)]  # copies of one vector
    rows += [rows[7], rows[50], (2000, [0.0] * width, 1), (2001, None, 1), (2002, [], 1), (2003, [float("nan")] * width, 1), (2004, [float("inf")] + [0.0] * (width - 1), 1)]
    rows += [(2005, [None] + [0.5] * (width - 1), 1), (None, rows[1][1], 2), (2050, rows[9][1], None), (2100, [v * 4 for v in rows[9][1]], 4), (2020, rows[20][1], 4)]
    return rows


def fine(v, zero):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))


def mined_by_brute_force(rows):
    rows = [(i, np.floor(256 * np.array(v, float)), label) for i, v, label in rows if i is not None and label is not None and fine(v, True)]
    out = []
    for a, v, label in {(i, tuple(v), label) for i, v, label in rows if i % 50 == 0}:
        scored = sorted((-int(np.dot(v, w)), i, other) for i, w, other in rows if i != a)
        for p, i, _ in [x for x in scored if x[2] == label][:5]:
            found = [(j, s) for s, j, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, i, k + 1, j, -p, -s) for k, (j, s) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 70, "group_rows": 4, "members": 2}, {"part_rows": 130, "group_rows": 100, "members": 5}])
def test_hard_negatives(spark, sizes):
    rows = embedding_rows()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))
    got = negatives.mine(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined_by_brute_force(rows)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(df, F.lit(True)).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="dimensions"):
        negatives.mine(one, F.lit(True))


def test_walks_end_early():
    """Members of a tight cluster score a small part of a list, and get what the whole list would give."""
    x = negatives.whole(pa.array(vectors(4000, 8, 2, 20).tolist()), 8)
    ids, own = np.arange(4000), np.flatnonzero((x @ x[0]) > 0.95 * (x[0] @ x[0]))[:20]
    lists = negatives.Lists(negatives.units(x[:1]), {0: float(np.arccos(np.clip(negatives.units(x[own]) @ negatives.units(x[:1])[0], -1, 1)).max())}, {0: len(own)}, 100)
    bounds = lists.bounds(x, 0)
    assert ((x[own] @ x.T) <= negatives.lengths(x[own])[:, None] * bounds[None, :] + 1e-3).all()
    order, read = np.argsort(-bounds), []

    def apart(members, rows):
        read.append(rows.stop)
        return np.zeros((len(members), len(order[rows])), bool)

    inf = np.full((len(own), 1), np.inf)
    m, _, at, score = negatives.step_through(x[own], ids[own], -inf, inf, x[order], ids[order], bounds[order], 5, apart)
    assert max(read) < 4000
    for k in range(len(own)):
        want = sorted((-float(s), int(i)) for i, s in zip(ids, x @ x[own[k]], strict=True) if i != own[k])[:5]
        assert sorted((-float(s), int(ids[order[r]])) for r, s in zip(at[m == k], score[m == k], strict=True)) == want


@pytest.mark.parametrize("clusters", [0, 12])
@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 60, "block_rows": 5, "sample": 100}])
def test_neighbours(spark, sizes, clusters):
    rows = embedding_rows(clusters=clusters)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))
    got = neighbours.nearest(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append(r)
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and fine(v, False)]
    by_id = {i: v for i, v in good}
    assert set(found) == {i for i in by_id if i % 20 == 0}
    right = total = 0
    for q, own in found.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        assert all(r.score == sum(a * b for a, b in zip(by_id[q], by_id[r.vec_id], strict=True)) for r in own)
        want = sorted((-sum(a * b for a, b in zip(by_id[q], v, strict=True)), i) for i, v in good if i != q)[:20]
        right, total = right + len({i for _, i in want} & {r.vec_id for r in own}), total + 20
    assert right >= 0.95 * total


def test_neighbours_of_few_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    assert neighbours.nearest(spark.createDataFrame([], kind), F.lit(True)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (1, [0.5, 0.5])], kind)
    got = sorted(tuple(r) for r in neighbours.nearest(few, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 2, -1.0)]


def test_chi_square():
    assert abs(neighbours.chi_square_at(1, 0.95) - 3.841459) < 1e-5 and abs(neighbours.chi_square_at(10, 0.95) - 18.307038) < 1e-5


def test_stopping_test_skips_rows(spark):
    """In clustered vectors of few dimensions most rows are never verified."""
    x = vectors(4000, 8, 3, 40)
    projection = neighbours.Projection(8, 1.0 + 1e-9)
    own, seen = np.arange(0, 4000, 50), []
    best = neighbours.Best(x[own], own, x, np.arange(4000), np.full(len(own), -np.inf), 20)
    plain = best.verify
    best.verify = lambda q, r, wanted=None: (seen.append(len(q) * len(r) if wanted is None else int(wanted.sum())), plain(q, r, wanted))
    neighbours.search_part(best, projection, projection.of_queries(x[own]), projection.of(x), neighbours.chi_square_at(10, 0.95))
    assert sum(seen) < 0.3 * len(own) * 4000


def test_ranked_of_a_hot_group(spark):
    df = spark.range(20000).selectExpr("1 as g", "id % 1000 as v", "id").repartition(7)
    got = ranking.ranked(df, ["g"], [F.desc("v"), F.asc("id")], 25).orderBy("rank").collect()
    assert [(r.v, r.id) for r in got] == sorted(((i % 1000, i) for i in range(20000)), key=lambda x: (-x[0], x[1]))[:25]


# 13
rnd = random.Random(4)
COMMON = ["the", "of", "and", "ein", "été", "naïve", "Zürich", "x1", "a", "b"]
RARE = [f"w{i}" for i in range(200)]
TEXTS = [None, "", " .,;\n", "the", "THE the The.", "été ÉTÉ Été", "long " * 300_000 + "w7", "x" * 9_000_000 + " w8"]
TEXTS += [" ".join(rnd.choice(COMMON if rnd.random() < 0.8 else RARE) + rnd.choice(["", ",", "!", "-b"]) for _ in range(rnd.randint(1, 120))) for _ in range(400)]
ITEMS = [(1, "the of w7"), (2, None), (3, ""), (4, "the THE été"), (5, "nothing-here"), (6, "w1 w2 w3 w8 and and and"), (1, "the of w7"), (1, "w5"), (None, "ein Zürich"), (7, "w9 " * 50), (8, " ".join(COMMON))]


def best_by_brute_force(docs, items, top=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = [(i, [w.translate(low) for w in word.findall(t or "")]) for i, t in docs]
    counted = [(i, len(w), {x: w.count(x) for x in set(w)}) for i, w in counted if w]
    n, length = len(counted), sum(c for _, c, _ in counted)
    out = []
    for item, text in set(items):
        scores = []
        words = [w.translate(low) for w in word.findall(text or "")]
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in f for _, _, f in counted) + 1))) for t in set(words)}
        for i, own, f in counted:
            m = 100 - 75 + (75 * own * n) // length
            score = sum(weight[t] * ((1_000_000_000 * f[t]) // (1000 * f[t] + 8 * m)) for t in words if t in f)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000}, {"block_bytes": 150}])
def test_lexical_search(spark, sizes, monkeypatch):
    docs = list(enumerate(TEXTS)) + [(9, TEXTS[20]), (9, TEXTS[20]), (None, TEXTS[21])]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = lexical.search(df, items, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best_by_brute_force(docs, ITEMS)


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id string, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical.search(docs.limit(0), items).collect() == lexical.search(docs, items.limit(0)).collect() == []
    same = spark.createDataFrame([("b", "a"), ("a", "a"), (None, "a"), ("c", "z")], "doc_id string, text string")
    assert [r.doc_id for r in lexical.search(same, items).orderBy("rank").collect()] == ["a", "b", None]


def test_walk_skips_and_agrees():
    """Whatever is short or long, the walk finds what sums over all lists give."""
    r = np.random.default_rng(8)
    for _ in range(30):
        n = int(r.integers(50, 20000))
        lists = []
        for _ in range(int(r.integers(1, 12))):
            docs = np.sort(r.choice(n, int(r.integers(1, n)) if r.random() < 0.5 else int(r.integers(1, 50)), replace=False))
            lists.append((docs, r.integers(1, 1000 if r.random() < 0.5 else 20, len(docs))))
        total = np.zeros(n, np.int64)
        for docs, values in lists:
            total[docs] += values
        order = np.lexsort((np.arange(n), -total))[:10]
        order = order[total[order] > 0]
        found, scores = lexical.walk(lists, n, 1, 10)
        assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_hybrid_search"])
def test_matches_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)
