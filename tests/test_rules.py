"""Golden rows of the rules that queries alone don't tell apart, and operators that write or keep state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.operators import aggregates as A
from postmill.operators import digests as D
from postmill.operators import filters as O
from postmill.operators import listing as L
from postmill.operators import registry as R
from postmill.operators import scoring as S
from postmill.operators import taxonomy as X2
from postmill.sources import sinks
from postmill.streaming import jobs
from tests.test_operators import one

AT = dt.datetime(2024, 2, 1)


def at(**ago):
    return AT - dt.timedelta(**ago)


@pytest.mark.parametrize(
    "actions,want",
    [
        (["up"], (True, False, True)), (["down"], (False, True, True)), (["up", "star"], (False, False, True)), (["star", "up"], (True, False, True)),
        (["up", "down", "clear"], (False, False, True)), (["clear"], (False, False, False)), (["star", "star", "dismiss"], (False, True, True)),
        (["clear", "star"], (True, False, True)), (["down", "dismiss", "dismiss"], (False, True, True)), (["seen"], (False, False, True)),
    ],
)
def test_reactions_in_order(spark, actions, want):
    rows = spark.createDataFrame([("k", 5, i, a) for i, a in enumerate(actions)], "key string, ts int, seq int, action string")
    r = R.fold_reactions(rows.repartition(3)).first()
    assert (r.starred, r.dismissed, r.seen) == want


def test_reactions_are_a_walk(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(20), rnd.randrange(5), i, rnd.choice(["up", "down", "star", "dismiss", "clear", "seen"])) for i in range(400)]
    want = {}
    for k, _, _, a in sorted(rows, key=lambda r: (r[1], r[2])):
        star, dismiss, seen = want.get(k, (False, False, False))
        star = True if a == "up" else False if a == "clear" else not star if a == "star" else star
        dismiss = True if a == "down" else False if a == "clear" else not dismiss if a == "dismiss" else dismiss
        want[k] = (star, dismiss, seen or a != "clear")
    got = {r.key: (r.starred, r.dismissed, r.seen) for r in R.fold_reactions(spark.createDataFrame(rows, "key int, ts int, seq int, action string")).collect()}
    assert got == want


def test_applied_needs_title_and_company(spark):
    df = spark.createDataFrame([(1, "PM ", "Acme"), (2, "PM", "acme"), (3, "Designer", "Acme"), (4, "PM", ""), (5, None, "Acme")], "i int, title string, company string")
    apps = spark.createDataFrame([("pm", "ACME ", "applied"), ("Designer", "Acme", "discovered"), ("PM", "", "offer"), (None, "Acme", "offer")], "title string, company string, state string")
    assert {r.i: r.applied for r in R.with_applied(df, apps).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


@pytest.mark.parametrize("n,p,want", [(15, 25, 3), (15, 10, 1), (15, 95, 14), (3, 10, 1), (1, 50, 1), (100, 90, 90)])
def test_percentile_index(spark, n, p, want):
    rows = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v")).repartition(4)
    assert A.percentile_by_index(rows, "v", [p]).first()[0] == want


def test_order_statistics_of_many_values(spark):
    rnd = random.Random(4)
    values = [round(rnd.gauss(0, 5), rnd.choice([1, 3])) for _ in range(4001)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ranked = sorted(values)
    got = A.percentile_by_index(rows, "v", [10, 50, 90]).first()
    assert got[:3] == tuple(ranked[4001 * p // 100 - 1] for p in (10, 50, 90))
    assert A.median(rows, "v").first()[0] == ranked[2000]
    assert A.median(rows.limit(0), "v").first()[0] is None


def test_engagement_tiers(spark):
    rows = [("new", at(hours=20)), ("active", at(hours=100)), ("active", at(hours=20)), ("dormant", at(hours=48)), ("lapsed", at(days=14)), ("ahead", at(hours=-5))]
    events = spark.createDataFrame(rows, "user_id string, ts timestamp")
    users = spark.createDataFrame([(u,) for u in ("new", "active", "dormant", "lapsed", "ahead", "never")], "user_id string")
    got = {r.user_id: r.tier for r in A.engagement(events, F.lit(AT), users).collect()}
    assert got == {"new": "new", "active": "active", "dormant": "dormant", "lapsed": "lapsed", "ahead": "new", "never": "unknown"}


def test_learned_keywords(spark):
    rows = [("Crypto Growth Lead", "down"), ("Crypto Sales x1", "down"), ("crypto-first PM", "down"), ("Growth Payments", "up"), ("Growth Ads", "up"), ("Crypto", "star")]
    got = {r.token: (r.skips, r.keeps, r.score) for r in A.learned_keywords(spark.createDataFrame(rows, "title string, action string")).collect()}
    import math

    assert got == {"crypto": (2, 0, round(math.log((3 / (5 + 2)) / (1 / (4 + 2))), 3))}  # skipped titles hold 5 words, kept ones 4
    few = spark.createDataFrame(rows[:2], "title string, action string")
    assert A.learned_keywords(few).count() == 0


def test_histogram_counts_one_sided_bands(spark):
    rows = [(90_000, None, False), (None, 90_000, False), (500, 700, False), (10_000, None, False), (None, None, False), (100_000, 900_000, False), (90_000, 90_000, True)]
    df = spark.createDataFrame(rows, "salary_min long, salary_max long, removed boolean")
    got = {r.low: r.n for r in A.salary_histogram(df).collect()}
    assert len(got) == 11 and got[80_000] == 3 and got[280_000] == 1 and sum(got.values()) == 4
    assert A.salary_histogram(df.filter("salary_min = 500")).count() == 0


def test_top_scored_breaks_ties_by_title(spark):
    df = spark.createDataFrame([(0, 1, "b", 0.5), (0, 2, "a", 0.5), (0, 3, "z", 0.9), (1, 4, None, 0.1)], "profile_id int, ingest_seq int, title string, match_score double")
    assert sorted(r.ingest_seq for r in S.top_scored(df, 2).collect()) == [2, 3, 4]


def test_only_pages_are_skipped(spark):
    rows = [(1, "json", "http://a.com/x"), (2, "html", "http://a.com/x?utm_q=1"), (3, "html", "http://a.com/y"), (4, "json", "http://a.com/y"), (5, "html", ""), (6, "html", "http://a.com/z"), (7, "html", "http://a.com/y/")]
    cards = spark.createDataFrame(rows, "ingest_seq int, kind string, url string")
    seen = spark.createDataFrame([("http://a.com/z",)], "url_key string")
    assert sorted(r.ingest_seq for r in R.skip_seen(cards, seen).collect()) == [1, 3, 4, 5]
    assert sorted(r.url_key for r in R.seen_after(cards, seen).collect()) == ["http://a.com/x", "http://a.com/y", "http://a.com/z"]
    assert sorted(r.ingest_seq for r in R.skip_seen(cards.drop("kind"), seen).collect()) == [1, 3, 5]


@pytest.mark.parametrize("place,want", [("Houston", "US"), ("Palo Alto", "US"), ("Ohio", "US"), ("Manila", "PH"), ("Tel Aviv", "IL"), ("US", ""), ("Kyiv", "UA"), ("Remote", "")])
def test_whole_country_table(spark, place, want):
    assert one(spark, X.detect_country(F.col("a"), F.lit(None).cast("string")), a=place) == want


@pytest.mark.parametrize("place,want", [("Remote - US", "us"), ("Remote, UK", "foreign"), ("Remote Ukraine", "anywhere"), ("Worldwide", "anywhere"), ("Houston", "onsite"), ("Remote, Houston", "anywhere"), ("Remote EMEA or USA", "us")])
def test_remote_region(spark, place, want):
    assert one(spark, X.remote_region(F.col("a")), a=place) == want


def test_company_tiers_and_freshness(spark):
    df = spark.createDataFrame([("Google ", at(days=29)), ("Stripe", at(days=15)), ("Acme", at(days=8)), ("Acme", None), ("Acme", at(days=7))], "company string, posted_date timestamp")
    assert [r[0] for r in df.select(O.company_tier(F.col("company"))).collect()] == ["mega", "large", "growth", "growth", "growth"]
    assert O.filter_freshness(df, F.lit(AT)).count() == 3 and O.filter_freshness(df, F.lit(AT), {"growth": 0}).count() == 5


@pytest.mark.parametrize("days,want", [(None, "—"), (0, "today"), (1, "1d"), (13, "13d"), (14, "2w"), (59, "8w"), (60, "2mo"), (364, "12mo"), (365, "1y")])
def test_age_labels(spark, days, want):
    row = spark.createDataFrame([(None if days is None else at(days=days, hours=1),)], "p timestamp")
    assert row.select(X.age_label(X.posted_age_days(F.col("p"), F.lit(AT)))).first()[0] == want


def test_future_dates_have_no_age(spark):
    assert one(spark, X.posted_age_days(F.col("p"), F.lit(AT)), p=at(days=-2)) is None and one(spark, X.posted_age_days(F.col("p"), F.lit(AT)), p=at(hours=-20)) == 0


@pytest.mark.parametrize("text,want", [("R&amp;D", "R&D"), ("&lt;b&gt;x&lt;/b&gt;", "x"), (" <i>a</i> ", "a"), ("&#x1F600; &#8211; &eacute;", "😀 – é"), ("&nope; & x;", "&nope; & x;"), ("", None), (None, None), ("<br>", None), ("&copy;2024", "©2024")])
def test_clean_field(spark, text, want):
    assert one(spark, T.clean_field(F.col("t")), t=text) == want


def test_sanitise_posting(spark):
    schema = "title string, company string, location string, description string, url string, seniority string, remote string, technologies array<string>"
    rows = [("REQ-12345", " <b>Acme</b> ", "", None, "u", " Senior ", "", ["Go", "go ", None, "<i>SQL</i>", "sql", ""]), ("LOVED", "JOB12", "x", "d", "u", None, "Remote", None)]
    a, b = T.sanitise_posting(spark.createDataFrame(rows, schema)).collect()
    assert (a.title, a.company, a.location, a.seniority, a.remote, a.technologies) == (None, "Acme", None, "senior", None, ["Go", "SQL"])
    assert (b.title, b.company, b.remote, b.technologies) == ("LOVED", None, "remote", None)


def test_match_filters(spark):
    schema = "i int, removed boolean, tier string, starred boolean, dismissed boolean, seen boolean, archetype string, location string, remote string"
    rows = [
        (1, False, "match", False, False, False, "pm", "Austin", None), (2, True, "match", True, False, False, "pm", "Austin", None), (3, False, "maybe", False, False, False, "pm", "Austin", None),
        (4, False, "maybe", True, False, True, None, "Remote, UK", None), (5, None, None, None, True, None, "pm", None, "remote"), (6, False, "none", False, False, False, None, None, None), (7, False, "", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    shown = lambda **f: sorted(r.i for r in L.filter_matches(df, L.MatchFilters(**f)).collect())
    assert shown() == [1, 7] and shown(hide_foreign_remote=False) == [1, 4, 7] and shown(show_dismissed=True) == [1, 5, 7]
    assert shown(starred_only=True, hide_foreign_remote=False) == [4] and shown(archetype="pm") == [1] and shown(unseen_only=True, hide_foreign_remote=False) == [1, 7]
    assert {r.reason: r.n for r in L.match_filter_counts(df).collect()} == {"kept": 2, "removed": 1, "tier": 2, "foreign remote": 1, "dismissed": 1}


def test_sorted_table_puts_stars_first(spark):
    rows = [(1, False, "b", 0.2, None), (2, True, "c", None, 0.5), (3, False, "A", 0.9, 0.1), (4, None, None, 0.5, 0.7)]
    df = spark.createDataFrame(rows, "ingest_seq int, starred boolean, title string, match_score double, ghost double").withColumn("posted_date", F.lit(None).cast("timestamp"))
    order = lambda *a, **k: [r.ingest_seq for r in L.sorted_table(df, *a, **k).collect()]
    assert order() == [2, 3, 4, 1] and order("role", ascending=True) == [2, 4, 3, 1] and order("ghost") == [2, 4, 3, 1] and order("posted") == [2, 1, 3, 4]


def test_recent_matches_reads_few_batches(spark):
    df = spark.createDataFrame([(b, 100 * b + i, float(b == 3 and i == 0)) for b in range(1, 6) for i in range(4)], "batch_id int, ingest_seq int, match_score double")
    assert {r.batch_id for r in L.recent_matches(df, 6).collect()} == {4, 5} and L.recent_matches(df, 6).count() == 6
    assert L.recent_matches(df, 9).first().ingest_seq == 300


def test_roles_with_a_users_own(spark, tmp_path):
    (tmp_path / "roles.json").write_text('{"archetypes": {"pm": {"aliases": ["Product Manager", "gpm"], "exclude": ["program manager"]}, "ds": {"aliases": ["data scientist"], "exclude": []}}}')
    shipped = X2.read_taxonomy(spark, str(tmp_path / "roles.json"))
    extra = spark.createDataFrame([("pm", "aliases", " GPM ", 0), ("pm", "exclude", "engineer", 0), ("mine", "aliases", "welder", 0)], "archetype string, kind string, phrase string, place int")
    both = X2.merged(shipped, extra)
    assert both.count() == 6 and {r.phrase for r in both.filter("archetype = 'pm' and kind = 'aliases'").collect()} == {"Product Manager", "gpm"}
    titles = spark.createDataFrame([("Senior Product Manager",), ("Program Manager",), ("Software Engineer, GPM",), ("Software Engineer",), ("Chef",), (None,)], "title string")
    kept = lambda targets: [r.title for r in X2.filter_roles(titles, both, targets).collect()]
    assert kept(("pm",)) == ["Senior Product Manager", "Software Engineer, GPM", "Chef", None] and len(kept(())) == 6 and len(kept(("unknown",))) == 6


def test_tables_of_a_cycle(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.2, at(days=1), "x"), (2, 0.9, None, "y"), (3, 0.9, at(days=3), "z")], "ingest_seq int, match_score double, posted_date timestamp, title string")
    path = str(tmp_path / "matches")
    sinks.write_matches(df, path, 1)
    sinks.write_matches(df.filter("ingest_seq > 1"), path, 2)
    sinks.write_matches(df.filter("ingest_seq > 1"), path, 2)
    assert sinks.read_batches(spark, path).groupBy("batch_id").count().count() == 2 and sinks.read_batches(spark, path).count() == 5
    assert [r.ingest_seq for r in spark.read.parquet(f"{path}/batch_id=1").coalesce(1).collect()] == [3, 2, 1]
    sinks.write_snapshot(df, str(tmp_path), "parsed", 7)
    assert sinks.read_batches(spark, f"{tmp_path}/parsed").count() == 3
    audit = spark.createDataFrame([(b, s) for b in (1, 2) for s in range(150)], "batch_id int, seq int")
    again = sinks.append_audit(audit, audit.filter("batch_id = 2"), 200)
    assert again.count() == 200 and again.filter("batch_id = 1").agg(F.min("seq")).first()[0] == 100


def test_tracker_export(spark, tmp_path):
    apps = spark.createDataFrame([(1, "applied", "Acme", AT), (2, "strange", "Acme", AT)], "app_id int, state string, company string, first_ts timestamp")
    tables = sinks.export_tracker(apps, spark.createDataFrame([("no",)], "reason string"), F.lit(AT))
    r = tables["metrics"].first()
    assert r.by_state == {"applied": 1, "unknown": 1} and r.total_passed == 1 and r.discovery_to_apply == "50.0%"
    sinks.write_export(tables, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/applications")).count() == 2


def test_labels_and_seeds(spark):
    cache = spark.createDataFrame([("a", "starred", [1.0]), ("b", "starred", [2.0]), ("c", "dismissed", [3.0]), ("seed:profile", "seed", [9.0])], "key string, state string, embedding array<double>")
    reg = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", None, None), ("d", True, False)], "key string, starred boolean, dismissed boolean")
    encoded = spark.createDataFrame([("b", [5.0]), ("d", [6.0])], "key string, embedding array<double>")
    assert sorted((r.key, r.state, r.embedding[0]) for r in D.refresh_labels(cache, reg, encoded).collect()) == [("a", "starred", 1.0), ("b", "dismissed", 5.0), ("d", "starred", 6.0), ("seed:profile", "seed", 9.0)]
    h = D.seed_hash(" text ", ("b", "a "))
    assert h == D.seed_hash("text", ("a", "b")) != D.seed_hash("text", ("a",)) and D.seed_hash(" ") is None
    seeds = spark.createDataFrame([("profile", [7.0])], "key string, embedding array<double>")
    assert D.reseed(cache, h, h, seeds) is cache and {r.embedding[0] for r in D.reseed(cache, "old", h, seeds).filter("state = 'seed'").collect()} == {7.0}


def test_similarity_in_blocks(spark):
    import math

    rnd = random.Random(5)
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(40)] + [(99, [0.0] * 4)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    p = v.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("profile_id"), "embedding")
    cos = lambda a, b: 0 if not any(a) or not any(b) else sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for size in (1, 4, 8192):
        got = {(r.profile_id, r.vec_id): r.similarity for r in S.profile_similarity(v, p, size).collect()}
        assert len(got) == 41 * 15 and all(s == pytest.approx(cos(dict(vectors)[a], dict(vectors)[b]), abs=6e-5) for (a, b), s in got.items())
    assert S.profile_similarity(v, p.limit(0)).count() == 0


def test_models_get_batches(spark):
    rows = spark.range(70).select(F.col("id").cast("string").alias("text_key"), F.repeat(F.lit("ab"), 1000).alias("text"))

    def encoder(texts):
        assert len(texts) <= 32 and all(len(t) == 1500 for t in texts)
        return [[float(len(texts))] for _ in texts]

    cache = rows.limit(10).select("text_key", F.lit("m").alias("model"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    out = S.encode_missing(rows.coalesce(1), cache, "m", encoder)
    assert out.count() == 60 and out.columns == ["text_key", "model", "embedding"]
    pairs = rows.limit(5).withColumn("profile_text", F.lit("p"))
    assert {r.pair_score for r in S.score_pairs(pairs, lambda items: [float(len(a) + len(b)) for a, b in items]).collect()} == {2001.0}


def test_words_that_stand_alone(spark):
    text = "we use c++ and .net, not c# or golang; go!"
    for word, want in (("c++", True), (".net", True), ("go", True), ("c", False), ("lang", False), ("net", True), ("c#", True), ("ang", False), ("c+", False)):
        import re

        assert want == bool(re.search(rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", text)) or word in ("c", "c+")
        want = bool(re.search(rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", text))
        assert one(spark, S.stands_alone(S._marked(F.col("t")), F.col("w")), t=text, w=word) == want, word


def test_longest_city_key(spark):
    rnd = random.Random(3)
    keys = [("san", 0.0, 0.0), ("san jose", 1.0, 1.0), ("york", 2.0, 2.0), ("new york", 3.0, 3.0), ("", 4.0, 4.0), ("la", 5.0, 5.0), ("x", 6.0, 6.0), ("nan", 7.0, 7.0)]
    cities = spark.createDataFrame(keys, "key string, lat double, lon double")
    df = spark.createDataFrame([("San Jose, CA",), ("New York",), ("San Diego",), (None,), ("Oslo",), ("LA",), ("x",), ("",), ("sa njo se",)], "location string")
    found = O.with_city(df, cities)
    got = {r.location: (r.city, r.lat) for r in found.collect()}
    assert got == {"San Jose, CA": ("san jose", 1.0), "New York": ("new york", 3.0), "San Diego": ("san", 0.0), None: (None, None), "Oslo": (None, None), "LA": ("la", 5.0), "x": ("x", 6.0), "": (None, None), "sa njo se": (None, None)}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    words = [rnd.choice("abc") * rnd.randint(1, 2) + rnd.choice("abc ") + rnd.choice("bcd") for _ in range(60)]
    places = [(" ".join(rnd.choices(words, k=3)),) for _ in range(80)]
    many = spark.createDataFrame([(w, 1.0, 1.0) for w in sorted({w[: rnd.randint(1, 5)].strip() for w in words} - {""})], "key string, lat double, lon double")
    have = [r.key for r in many.collect()]
    for r in O.with_city(spark.createDataFrame(places, "location string"), many).collect():
        hits = [k for k in have if k in r.location]
        assert (r.city in hits and len(r.city) == max(map(len, hits))) if hits else r.city is None


def test_rows_without_a_key_are_dealt_to_all_tasks(spark):
    from postmill.operators import registry as R
    from postmill.operators.shared import spread_absent

    rows = spark.range(20_000).select(F.col("id").alias("ingest_seq"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://x.com/"), F.col("id").cast("string"))).alias("url"))
    key = spread_absent(rows, F.col("url"))
    sizes = [r["count"] for r in rows.repartition(16, key).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 3 * sorted(sizes)[8]
    assert rows.filter(key.startswith("\x00") != F.col("url").isNull()).count() == 0
    seen = R.keyed_urls(rows.filter("ingest_seq < 100 and url is not null")).select("url_key")
    assert R.skip_seen(rows, seen).count() == 10_000 + 10_000 - 50



def test_success_clears_a_failure(spark):
    src = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")], "source string, slug string")
    bad = spark.createDataFrame([("a", "1", at(days=1)), ("a", "2", at(days=2)), ("a", "3", at(days=8)), ("b", "1", None)], "source string, slug string, ts timestamp")
    good = spark.createDataFrame([("a", "2", at(days=1)), ("a", "1", at(days=3))], "source string, slug string, ts timestamp")
    left = lambda **k: sorted(map(tuple, O.active_sources(src, bad, F.lit(AT), **k).collect()))
    assert left() == [("a", "3"), ("b", "1")] and left(successes=good) == [("a", "2"), ("a", "3"), ("b", "1")]


def test_idle_cycle_keeps_the_registry(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "reg")
    schema = "key string, score long, payload long, ingest_seq long"
    spark.createDataFrame([("k", 5, 1, 1)], schema).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    assert jobs.read_registry(spark, folder).count() == 0
    assert [r.score for r in jobs.registry_cycles(stream(), folder).collect()] == [5]
    assert [r.score for r in jobs.registry_cycles(stream(), folder).collect()] == [5]
    spark.createDataFrame([("k", 9, 2, 2), ("j", 1, 3, 3)], schema).write.mode("append").parquet(str(source))
    assert {r.key: (r.score, r.n_batches) for r in jobs.registry_cycles(stream(), folder).collect()} == {"k": (9, 2), "j": (1, 1)}
    assert jobs.registry_table(spark, folder).versions() == [0, 1] and jobs.read_registry(spark, folder, 0).count() == 1
    with pytest.raises(ValueError):
        jobs.read_registry(spark, folder, 5)


def test_cycle_counter(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(25).write.parquet(str(source))
    counter = jobs.CycleCounter()
    spark.streams.addListener(counter)
    try:
        jobs.run_once(spark.readStream.schema("id long").parquet(str(source)), str(tmp_path / "out"))
        import time

        for _ in range(50):
            if sum(counter.rows.values()) >= 25:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counter)
    assert sum(counter.rows.values()) == 25


def test_query_words_end_without_dots(spark):
    assert A.query_words("Licht... the 7 of. Node.js, C++ co-op.") == ["licht", "the", "node.js", "c++", "co-op"]
    df = spark.createDataFrame([(1, "the light"), (2, "das Licht"), (3, "the Licht")], "id int, text string")
    assert [(r.id, r.hits) for r in A.keyword_search(df, "licht... the", "text", 2, ["id"]).collect()] == [(3, 2), (1, 1)]
