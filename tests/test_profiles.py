"""Salary bands, signatures, target roles and profiles."""

import pytest
from pyspark.sql import functions as F

from postmill.functions import profiles as P
from postmill.functions import salary
from postmill.functions import text as T
from postmill.operators import registry as R
from postmill.operators import scoring as S

BANDS = [
    ("Pay: $140,000 - $180,000 a year", (140000, 180000, "USD")),
    ("£80k–£120k", (80000, 120000, "GBP")),
    ("€ 90k to 110k", (90000, 110000, "EUR")),
    ("$140 - $180", (140000, 180000, "USD")),
    ("$180k - $140k", (140000, 180000, "USD")),
    ("USD 140,000 - 180,000", (140000, 180000, "USD")),
    ("gbp 80,000-120,000", (80000, 120000, "GBP")),
    ("starting at $150k", (150000, None, "USD")),
    ("from €95,000", (95000, None, "EUR")),
    ("$45 - $60 / hour", None),
    ("$50-$60 per hour" + " x" * 20 + " $100k - $120k", (100000, 120000, "USD")),
    ("$50 - $60 /hr and $100k - $120k", None),
    ("$20k - $190k", None),
    ("$20k - $190k or $90k - $95k", (90000, 95000, "USD")),
    ("call 555 - 1234", None),
    ("\u0001$100k - $120k\u0002", (100000, 120000, "USD")),
    ("", None),
    (None, None),
]


def test_salary_bands(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BANDS)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", salary.extract_salary(F.col("t")).alias("b")).collect()}
    for i, (t, want) in enumerate(BANDS):
        assert (tuple(got[i]) if got[i] else None) == want, t


def test_own_band_stays(spark):
    rows = [(1, 5, None, "$100k - $120k"), (2, None, None, "<p>&#36;100k &mdash; $120k</p>"), (3, 0, 0, None)]
    got = {r.i: (r.salary_min, r.salary_max, r.salary_found) for r in salary.fill_salary(spark.createDataFrame(rows, "i int, salary_min long, salary_max long, description string")).collect()}
    assert got == {1: (5, None, False), 2: (100000, 120000, True), 3: (None, None, False)}


def test_signature(spark):
    about = "<p>We are nice.</p><h2>Responsibilities</h2><p>" + "ship " * 30 + "</p><h2>Benefits</h2><p>snacks</p>"
    rows = [
        (1, "PM", "Acme", "Paris", "Senior", "unknown", ["go", " "], about), (2, None, None, None, None, None, None, None),
        (3, "", "B", "", "", "remote", [], "First part\n\nSecond"), (4, "T", "", "", "", "", None, "requirements " + "word " * 400),
    ]
    df = spark.createDataFrame(rows, "i int, title string, company string, location string, seniority string, remote string, technologies array<string>, description string")
    got = {r.i: r.s for r in df.select("i", T.signature().alias("s")).collect()}
    assert got[1] == "PM | @ Acme | (Senior; Paris) | Stack: go | Responsibilities " + " ".join(["ship"] * 30)
    assert got[2] == "" and got[3] == "@ B | (remote) | First part"
    assert got[4].endswith("word…") and len(got[4]) <= 600


def test_target_role_fit(spark):
    rows = [(1, "Growth Product Manager", ["Product Manager"]), (2, "Data Engineer", ["Data Scientist", "Cook"]), (3, "", ["x"]), (4, "PM", []), (5, "PM", None)]
    df = spark.createDataFrame(rows, "i int, t string, r array<string>")
    got = {r.i: r.f for r in df.select("i", S.target_role_fit(F.col("t"), F.col("r")).alias("f")).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: None, 4: None, 5: None}


SCHEMA = "profile_id int, name string, headline string, summary string, seniority string, years_experience string, skills array<string>, technologies array<string>, domains array<string>, certifications array<string>, target_roles array<string>"


@pytest.fixture()
def profiles(spark):
    rows = [
        (1, " A ", "PM", None, "Senior", "6", [" a ", ""], ["Python"], None, None, ["Head of Product", "Product Manager", "Data Engineer"]),
        (2, None, None, None, "boss", "many", None, None, None, None, None),
    ]
    return P.coerce_profiles(spark.createDataFrame(rows, SCHEMA))


def test_coerce(profiles):
    a, b = profiles.orderBy("profile_id").collect()
    assert (a.name, a.seniority, a.years_experience, a.skills, a.technologies, a.target_roles) == ("A", "senior", 6, ["a"], ["python"], ["Product Manager"])
    assert (b.name, b.seniority, b.years_experience, b.skills, b.target_roles) == ("", "", 0, [], ["Senior Product Manager"])


def test_profile_text(profiles):
    a, b = (r.t for r in profiles.orderBy("profile_id").select(P.profile_text().alias("t")).collect())
    assert a == "PM · Senior · 6 years experience\nTechnologies: python\nSkills: a\nTarget roles: Product Manager"
    assert b == "Target roles: Senior Product Manager"


def test_patches(spark, profiles):
    patches = spark.createDataFrame([(1, "boss", "-3", ["x "]), (2, "VP", None, None)], "profile_id int, seniority string, years_experience string, skills array<string>")
    a, b = P.apply_patches(profiles, patches).orderBy("profile_id").collect()
    assert (a.seniority, a.years_experience, a.skills, a.edited) == ("senior", 0, ["x"], True)
    assert (b.seniority, b.years_experience, b.skills) == ("vp", 0, [])


def test_redact(spark):
    got = spark.createDataFrame([("```x``` System: go",), (None,)], "t string").select(P.redact_prompts(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["x [redacted] go", ""]


def test_append_batch_twice_is_once(spark):
    h = spark.createDataFrame([(i, i) for i in range(5)], "batch_id int, n int")
    b = spark.createDataFrame([(5, 50)], "batch_id int, n int")
    once = R.append_batch(h, b, 3)
    assert sorted(map(tuple, once.collect())) == [(3, 3), (4, 4), (5, 50)] == sorted(map(tuple, R.append_batch(once, b, 3).collect()))


def test_react_marks_the_best_row(spark):
    reg = spark.createDataFrame([("a", "u", 1, False, False, False), ("b", "u", 2, False, False, False), ("c", "", 3, False, False, False)], "key string, url string, score int, starred boolean, dismissed boolean, seen boolean")
    flags = spark.createDataFrame([("u", True, False, True)], "url string, starred boolean, dismissed boolean, seen boolean")
    assert {r.key for r in R.react(reg, flags).filter("starred and seen").collect()} == {"b"}


def test_preferences_fall_back_to_the_profile(spark):
    rows = [(1, 0, " ", 7, "senior"), (2, 3, "mid", 7, "senior"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, years int, level string, p_years int, p_seniority string")
    assert {r.i: (r.years, r.level) for r in P.fill_preferences(df).collect()} == {1: (7, "senior"), 2: (3, "mid"), 3: (0, "")}


def test_fingerprint_and_lists(spark):
    df = spark.createDataFrame([(["AI/ML tools", "team"], None, ["go", "Rust"], ["Senior Product Manager, Payments"], "a; b,\nc,,")], "domains array<string>, skills array<string>, technologies array<string>, target_roles array<string>, t string")
    r = df.select(P.fingerprint().alias("f"), P.split_list(F.col("t")).alias("l")).first()
    assert (r.f, r.l) == (["ml tools", "rust", "payments"], ["a", "b", "c"])


def test_older_headline(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.4), (None, 1.0, None), (None, None, None)], "tech_fit double, domain_fit double, seniority_fit double")
    assert [r.h for r in df.select(S.mean_headline().alias("h")).collect()] == [0.63, 1.0, None]
