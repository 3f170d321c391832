"""Golden values of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.operators import filters as O
from postmill.operators import ghost as G
from postmill.operators import registry as R
from postmill.operators import scoring as S


def one(spark, column, **values):
    """The column's value over one row."""
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'timestamp' if isinstance(v, dt.datetime) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "title,want",
    [("Sr. Product Manager, AI", "senior product manager ai"), ("TPM (Cloud)", "technical program manager cloud"), (None, ""), ("  PM / Growth ", "product manager growth")],
)
def test_norm_title(spark, title, want):
    assert one(spark, T.norm_title(F.col("t")), t=title) == want


@pytest.mark.parametrize("place,want", [("Remote - US", "remote"), ("Austin, TX, USA", "austin, tx"), ("London, UK", "london"), ("San Francisco, CA", "san francisco"), (None, "")])
def test_norm_location(spark, place, want):
    assert one(spark, T.norm_location(F.col("t")), t=place) == want


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://A.com:443/x/?utm_source=q&b=2&a=1#top", "https://a.com/x?a=1&b=2"),
        ("a.com", "https://a.com/"), ("", ""), (None, ""), ("http://a.com/p?ref=1&empty=", "http://a.com/p"),
    ],
)
def test_norm_url(spark, url, want):
    assert one(spark, T.norm_url(F.col("t")), t=url) == want


@pytest.mark.parametrize("title,want", [("Software Engineer", "engineer"), ("Engineering Manager", None), ("Senior designer, engineer", "engineer"), (None, None)])
def test_blocked_hit(spark, title, want):
    assert one(spark, T.blocked_hit(F.col("t"), ["engineer", "designer"]), t=title) == want


@pytest.mark.parametrize("place,remote,want", [("Bangalore, India", "", "IN"), ("Remote", "", ""), ("Austin, TX", "", "US"), ("Remote - US", "remote", "US"), (None, None, "")])
def test_country(spark, place, remote, want):
    assert one(spark, X.detect_country(F.col("a"), F.col("b")), a=place, b=remote) == want


@pytest.mark.parametrize("text,want", [("15+ years of product management experience and 3 years of sql", 15), ("5 to 10 years", 10), ("3 years here, 2 yrs there", 2), ("since 1999", None)])
def test_required_years(spark, text, want):
    assert one(spark, X.required_years(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("$160K-200K", 180000.0), ("£120k", 152400.0), ("$1.5M", 1500000.0), ("$2026", None), (None, None), ("€140 000", 151200.0)])
def test_salary_usd(spark, text, want):
    got = one(spark, X.salary_usd(F.col("t")), t=text)
    assert got == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("x,want", [(0.49, 0.35), (0.0, 0.0), (1.0, 0.95), (-1.0, 0.0), (0.55, 0.68)])
def test_calibrate(spark, x, want):
    assert one(spark, X.calibrate(F.col("x")), x=x) == pytest.approx(want)


def test_user_level():
    assert X.user_level("", 6) == "senior" and X.user_level("Sr", 0) == "senior" and X.user_level("", 0) == ""


@pytest.mark.parametrize("days,want", [(30, 0.413), (60, 0.784), (14, 0.0), (-3, 0.0)])
def test_ghost_age(spark, days, want):
    now = dt.datetime(2026, 5, 14)
    assert one(spark, G.age_stale(F.col("p"), F.lit("2026-05-14").cast("timestamp")), p=now - dt.timedelta(days=days)) == pytest.approx(want, abs=1e-3)


def test_undated_stays_below_warning(spark):
    rows = spark.createDataFrame([(1, "", "", "", "", None, None, None, "", None, None)], "ingest_seq int, title string, company string, location string, description string, posted_date timestamp, salary_min bigint, salary_max bigint, url string, remote string, technologies array<string>")
    r = G.with_ghost(G.mark_duplicates(rows), F.lit("2026-05-14").cast("timestamp")).first()
    assert r.ghost == 0.29 and r.ghost_raw > 0.29 and not r.suspect


def test_near_dupes_adds_lane(spark):
    old = spark.createDataFrame([(1, "k1", "Acme", "Senior Product Manager Ads", "SF")], "ingest_seq int, key string, company string, title string, location string")
    new = spark.createDataFrame([(2, "Acme", "Senior Product Manager Ads Platform", "SF"), (3, "Acme", "Senior Product Manager Payments", "SF"), (4, "Other", "Senior Product Manager Ads", "SF")], "ingest_seq int, company string, title string, location string")
    assert [(r.ingest_seq, r.key, r.overlap) for r in R.near_dupes(new, old).collect()] == [(2, "k1", 0.8)]


def test_new_rows_meet_the_whole_registry_and_each_other(spark):
    from postmill.plans import registry as plans
    from postmill.plans.derived import postings

    sf = "/root/testdata/sf0.001"
    got = {r.ingest_seq: (r.key, r.overlap, r.in_batch) for r in plans.QUERIES["near_duplicates_whole_registry"](spark, sf).collect()}
    p = postings(spark, sf).select("ingest_seq", "batch_id", F.lower(F.trim(T.text(F.col("company")))).alias("co"), T.norm_location(F.col("location")).alias("loc"), T.title_tokens(F.col("title")).alias("w")).collect()
    like = lambda a, b: len(set(a.w) & set(b.w)) / max(1, len(set(a.w) | set(b.w))) if (a.co, a.loc) == (b.co, b.loc) else 0
    new, want = sorted((r for r in p if r.batch_id == 11), key=lambda r: r.ingest_seq), {}
    for a in new:
        best = min(((-like(a, b), b.ingest_seq) for b in p if b.batch_id < 11), default=(0, 0))
        if -best[0] >= 0.75:
            want[a.ingest_seq] = (str(best[1]), round(-best[0], 6), False)
    left = [a for a in new if a.ingest_seq not in want]
    for k, a in enumerate(left):
        for b in left[:k]:
            if like(a, b) >= 0.75:
                want[a.ingest_seq] = (str(b.ingest_seq), round(like(a, b), 6), True)
                break
    assert got == want
    later = {r.ingest_seq for r in p if 2 <= r.batch_id < 11}
    assert any(not b and int(k) in later for k, _, b in got.values())


def test_new_rows_collapse_to_the_earliest(spark):
    schema = "ingest_seq int, company string, title string, location string"
    new = [(2, "Acme", "Senior Product Manager Ads", "SF"), (3, "Acme", "Senior Product Manager Ads Platform", "SF"), (4, "Acme", "Data Engineer", "SF"), (5, "Acme", "Data Engineer", "SF"), (6, "Else", "Data Engineer", "SF")]
    old = spark.createDataFrame([(1, "k1", "Acme", "Senior Product Manager Payments", "SF"), (0, "k0", "Acme", "Welder", "SF")], "ingest_seq int, key string, company string, title string, location string")
    got = sorted((r.ingest_seq, r.key, r.overlap, r.in_batch) for r in R.collapse_new(spark.createDataFrame(new, schema), old).collect())
    assert got == [(3, "2", 0.8, True), (5, "4", 1.0, True)]


def test_reaction_toggles(spark):
    rows = [("a", 1, 1, "star"), ("a", 2, 2, "star"), ("b", 1, 3, "star"), ("b", 2, 4, "clear"), ("c", 1, 5, "dismiss")]
    got = {r.key: (r.starred, r.dismissed, r.seen) for r in R.fold_reactions(spark.createDataFrame(rows, "key string, ts int, seq int, action string")).collect()}
    assert got == {"a": (False, False, True), "b": (False, False, True), "c": (False, True, True)}  # clear leaves seen


def test_labels_in_blocks_give_whole_results(spark):
    import math
    import random

    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    labels = [(["starred", "dismissed", "seed"][i % 3], [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(50)] + [("rare", [1.0, 0.0, 0.0, 0.0])]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    least = {"starred": 3, "dismissed": 3, "seed": 2, "rare": 2}
    v, l = spark.createDataFrame(rows, "vec_id int, embedding array<double>"), spark.createDataFrame(labels, "state string, embedding array<double>")
    for block_rows in (1, 3, 8192):
        got = {r.vec_id: r for r in S.label_similarity(v, l, least, block_rows, 13).collect()}
        assert len(got) == len(rows)
        for i, e in rows:
            for s in ("starred", "dismissed", "seed"):
                assert got[i][s] == pytest.approx(max(cos(e, x) for t, x in labels if t == s))
            assert got[i]["rare"] is None
    assert S.label_similarity(v, l.limit(0), least).filter("starred is null").count() == len(rows)


def test_cells_of_labels_are_skipped_and_none_is_missed(spark):
    """20 blocks a side of vectors in 15 directions: exact maxima, while most vectors meet few cells."""
    import numpy as np

    from postmill.operators import similarity as Y

    r = np.random.default_rng(3)
    centres = r.standard_normal((15, 8))
    near = lambda n: (centres[r.integers(0, 15, n)] + 0.05 * r.standard_normal((n, 8))).tolist()
    rows = list(enumerate(near(600))) + [(600, [0.0] * 8), (601, None), (602, rows_of_one := near(1)[0]), (602, rows_of_one)]
    labels = [(["starred", "dismissed"][i % 2], e) for i, e in enumerate(near(400))] + [("starred", [0.0] * 8), ("seed", [0.0] * 8), ("seed", None)]
    least = {"starred": 3, "dismissed": 3, "seed": 2}
    v, l = spark.createDataFrame(rows, "vec_id int, embedding array<double>"), spark.createDataFrame(labels, "state string, embedding array<double>")
    got = {x.vec_id: x for x in S.label_similarity(v, l, least, 20, 25).collect()}
    unit = lambda e: Y.unit_rows(__import__("pyarrow").array([e]), 8)[0]
    assert set(got) == set(range(603))
    for i, e in rows:
        for s in least:
            assert got[i][s] == pytest.approx(max(float(unit(e) @ unit(x)) for t, x in labels if t == s), abs=1e-9)
    good = v.filter(Y.has_direction())
    placed, cells = Y.fit_cells(l.filter("state <> 'seed'"), ["starred", "dismissed"], 8, 25, 20)
    first = Y._met(Y.routed(good, cells, 8, False), placed, cells, 8, 20)
    state = F.element_at(F.array(*[F.lit(cells.states[s]) for s in cells.state]), F.col("cell") + 1)
    floors = first.groupBy("vec_id").agg(*[F.max(F.when(state == s, F.col("best"))).alias(s) for s in cells.states])
    met = Y.routed(good.join(floors, "vec_id", "left"), cells, 8, True).count() + 2 * good.count()
    assert met < 0.25 * good.count() * int(cells.parts.sum())


def test_similarity_plans_broadcast_no_vectors(spark, sf):
    from postmill.plans import registry

    plan = registry.QUERIES["profile_similarity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Nested" not in plan


def test_cap_keeps_best(spark):
    rows = spark.createDataFrame([(0, i, 0.6 + i / 100, "match") for i in range(10)], "profile_id int, ingest_seq int, match_score double, tier string")
    got = {r.ingest_seq: (r.tier, r.capped) for r in S.cap_matches(rows, 3).collect()}
    assert [i for i, (t, _) in got.items() if t == "match"] == [7, 8, 9] or sorted(i for i, (t, _) in got.items() if t == "match") == [7, 8, 9]
    assert all(c == (t == "maybe") for t, c in got.values())


def test_seniority_and_years_fit(spark):
    assert one(spark, S.ordinal_fit(F.col("a"), F.col("b")), a="senior", b="director") == 0.15
    assert one(spark, S.years_fit(F.col("a"), F.col("b")), a=5, b="director") == 0.5


def test_qa_and_risk_on_empty_and_null(spark):
    schema = "title string, company string, location string, description string, seniority string, technologies array<string>, salary_text string, url string"
    rows = spark.createDataFrame([(None,) * 8, ("PM", "Acme", "x", "pay upfront", "mid", ["a"], None, "http://bit.ly/x")], schema)
    assert [r.verdict for r in O.with_qa(rows).collect()] == ["fail", "pass"]
    assert [r.risk for r in O.with_risk(rows).collect()] == ["low", "high"]
    assert O.with_risk(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["fired_signals", "ghost_score", "ghost_signals"])
def test_texts_are_not_shuffled_for_duplicates(spark, sf, name):
    from postmill.plans import registry

    plan = registry.QUERIES[name](spark, sf)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    dealt = [part.split("Arguments")[0] for part in plan.split("\n\n") if ") Exchange" in part]
    assert dealt and not any("description" in part for part in dealt)
