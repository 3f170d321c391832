"""Filters over postings. Each returns a DataFrame; reasons are columns, so counts of drops are one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import text as T


@dataclass(frozen=True)
class Preferences:
    """What a user of the pipeline wants; all filters and scores take it."""

    role_keywords: tuple[str, ...] = ("product manager", "program manager")
    blocked_title_keywords: tuple[str, ...] = ("engineer", "designer", "counsel")
    years_experience: int = 6
    current_level: str = ""
    trapdoor: bool = True
    allowed_countries: tuple[str, ...] = ("US",)
    country_mode: str = "hard"
    allow_remote_any_country: bool = True
    strict_unknown_country: bool = True
    work_modes: tuple[str, ...] = K.WORK_MODES
    allowed_locations: tuple[str, ...] = ("san francisco", "london")
    blocked_locations: tuple[str, ...] = ("bangalore",)
    max_level_gap: int = 3
    max_years_gap: int = 8
    title_weight: float = 0.20
    title_penalty: float = 0.60
    level_weight: float = 0.16
    location_weight: float = 0.06
    salary_floor_usd: float = 150_000.0
    salary_weight: float = 0.15
    years_weight: float = 0.04
    target_archetypes: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    @property
    def level(self) -> str:
        return X.user_level(self.current_level, self.years_experience)


def title_passes(title: Column, prefs: Preferences) -> Column:
    t = F.lower(T.text(title))
    blocked = T.blocked_hit(title, prefs.blocked_title_keywords).isNotNull()
    product = F.contains(t, F.lit("product"))
    relevant = F.when(product, ~T.any_in(t, K.NON_PM_PRODUCT_TITLES)).otherwise(T.any_in(t, prefs.role_keywords))
    too_senior = T.any_in(t, K.TRAPDOOR_TITLES) if prefs.trapdoor and 0 < prefs.years_experience < 8 else F.lit(False)
    return ~blocked & relevant & ~too_senior


def filter_titles(df: DataFrame, prefs: Preferences) -> DataFrame:
    """Titles worth scoring: not blocked, product roles or a role keyword, not too senior."""
    return df.filter(title_passes(F.col("title"), prefs))


def filter_cards(df: DataFrame, keywords) -> DataFrame:
    """Cards whose text holds a keyword; no keywords keep all."""
    return df.filter(T.any_in(F.lower(T.text(F.col("text"))), keywords)) if keywords else df


def country_reason(prefs: Preferences) -> Column:
    """Null where the country gate passes. Needs column country."""
    allowed = [c for c in prefs.allowed_countries]
    if prefs.country_mode != "hard" or not allowed:
        return F.lit(None).cast("string")
    country = F.col("country")
    out = F.when(F.lit(prefs.allow_remote_any_country) & (X.work_mode(F.col("remote"), F.col("location")) == "remote"), F.lit(None))
    out = out.when(country == "", F.lit("country unknown") if prefs.strict_unknown_country else F.lit(None))
    return out.when(~country.isin(*allowed), F.concat(F.lit("country "), country)).cast("string")


def filter_country(df: DataFrame, prefs: Preferences) -> DataFrame:
    """Adds country, drops postings outside the allowed ones."""
    out = df.withColumn("country", X.detect_country(F.col("location"), F.col("remote")))
    if prefs.country_mode != "hard" or not prefs.allowed_countries:
        return out
    # The same rule as country_reason, written so that the country is worked out once a row.
    fits = F.col("country").isin(*prefs.allowed_countries, *([] if prefs.strict_unknown_country else [""]))
    remote = X.work_mode(F.col("remote"), F.col("location")) == "remote"
    return out.filter((remote | fits) if prefs.allow_remote_any_country else fits)


def location_reason(prefs: Preferences) -> Column:
    """Null where the location rule passes."""
    location, mode = F.lower(T.text(F.col("location"))), X.work_mode(F.col("remote"), F.col("location"))
    if not prefs.work_modes:
        return F.lit("no work modes")
    blocks = [b for b in prefs.blocked_locations if b not in K.WORK_MODE_TOKENS["remote"]]
    out = F.when((mode != "unknown") & ~mode.isin(*prefs.work_modes), F.lit("work mode"))
    out = out.when(T.any_in(location, blocks), F.lit("blocked"))
    if prefs.allowed_locations:
        listed = X.is_country_only(F.col("location")) | (location == "") | T.any_in(location, prefs.allowed_locations)
        out = out.when((mode != "remote") & ~listed, F.lit("not allowed"))
    return out


def filter_location(df: DataFrame, prefs: Preferences) -> DataFrame:
    return df.filter(location_reason(prefs).isNull())


def experience_reason(prefs: Preferences) -> Column:
    """Null where level and years fit. Needs columns job_level and required_years."""
    level, years = F.col("job_level"), prefs.years_experience
    out = F.when(F.lit(prefs.trapdoor and years < K.TRAPDOOR_YEARS) & level.isin(*K.TRAPDOOR_LEVELS), F.lit("trapdoor"))
    if prefs.level:
        out = out.when(F.abs(X.level_rank(level) - K.LEVEL_RANK[prefs.level]) >= prefs.max_level_gap, F.lit("level"))
    return out.when(F.col("required_years") - years >= prefs.max_years_gap, F.lit("years"))


def with_levels(df: DataFrame) -> DataFrame:
    """Adds job_level and required_years, which are looked for in all of ``YEARS_FIELDS`` that the rows have, texts or lists."""
    some = lambda c: F.array_join(c, " ") if dict(df.dtypes)[c].startswith("array") else F.nullif(F.col(c).cast("string"), F.lit(""))
    parts = F.concat_ws(" ", *[some(c) for c in K.YEARS_FIELDS if c in df.columns])
    return df.withColumns({"job_level": X.job_level(F.col("title"), F.col("seniority")), "required_years": X.required_years(parts)})


def filter_experience(df: DataFrame, prefs: Preferences) -> DataFrame:
    out = with_levels(df)
    return out.filter(experience_reason(prefs).isNull()) if prefs.level or prefs.years_experience > 0 else out


def filter_archetype(df: DataFrame, allow, deny) -> DataFrame:
    """An allowed phrase in the title wins, else a denied one drops; no signal passes."""
    t = F.lower(T.text(F.col("title")))
    return df.filter((t == "") | T.any_in(t, allow) | ~T.any_in(t, deny))


REQUIRED, DESIRED = ("title", "company"), ("location", "description", "seniority", "technologies")


def qa_issues() -> Column:
    """All issues of a posting, in rule order."""
    def missing(name: str, kind: str) -> Column:
        c = F.col(name)
        gone = c.isNull() if name == "technologies" else c.isNull() | (F.trim(c) == "")
        return F.when(gone, F.lit(f"MISSING_{kind}: {name}"))

    length = F.char_length(T.text(F.col("title")))
    rules = [missing(n, "REQUIRED") for n in REQUIRED] + [missing(n, "DESIRED") for n in DESIRED]
    rules += [F.when(length < 3, F.lit("SUSPECT: title too short")), F.when(length > 200, F.lit("SUSPECT: title too long"))]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def with_qa(df: DataFrame) -> DataFrame:
    """Adds issues and verdict: fail (a required field is missing), warn (a desired one) or pass."""
    out = df.withColumn("issues", qa_issues())
    has = lambda word: F.exists("issues", lambda i: F.contains(i, F.lit(word)))
    return out.withColumn("verdict", F.when(has("MISSING_REQUIRED"), "fail").when(has("MISSING_DESIRED"), "warn").otherwise("pass"))


def qa_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    judged = with_qa(df)
    return judged.filter("verdict <> 'fail'"), judged.filter("verdict = 'fail'")




def huge_amounts(salary: Column) -> Column:
    numbers = F.regexp_extract_all(F.replace(salary, F.lit(","), F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.filter(F.transform(numbers, lambda x: x.try_cast("long")), lambda n: n > 500_000)


def personal_email(desc: Column) -> Column:
    return F.contains(desc, F.lit("@")) & desc.rlike(rf"[a-z0-9._%+-]@(?:{'|'.join(K.FREE_MAIL)})\.(?:com|net|org)")


def _listed(text: Column, words, label: str) -> Column:
    """Labelled words that the text holds; the list is walked only where a plain search finds one of them."""
    some = reduce(or_, (F.contains(text, F.lit(w)) for w in words))
    found = T.let(text, lambda s: F.transform(T.which_in(s, words), lambda p: F.concat(F.lit(label), p)))
    return F.when(some, found).otherwise(F.expr("cast(array() as array<string>)"))


def with_risk(df: DataFrame) -> DataFrame:
    """Adds flags and risk (high, medium, low). Needs a salary_text column."""
    names = ("title", "description", "salary_text", "url", "company")
    out = df.withColumns({f"__{c}": F.lower(T.text(F.col(c))) for c in names})  # worked out once a row, used by all rules
    out = out.withColumn("__full", F.concat_ws(" ", "__title", "__description", "__salary_text"))
    title, desc, salary, url, company, full = (F.col(f"__{c}") for c in (*names, "full"))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    long_digits = salary.rlike("[0-9][0-9,]{5}")  # no amount over 500,000 without them
    amounts = F.when(long_digits, F.transform(huge_amounts(salary), lambda n: F.concat(F.lit("SUSPICIOUS_SALARY: "), n.cast("string"))))
    out = out.withColumns({
        "__scam": _listed(full, K.SCAM_PHRASES, "SCAM_PHRASE: "), "__ghost": _listed(full, K.GHOST_PHRASES, "GHOST_JOB: "),
        "__first": F.filter(F.array(flag(title.rlike(K.VAGUE_TITLES), "VAGUE_TITLE"), flag(company.isin(*K.HIDDEN_COMPANIES), "NO_COMPANY")), lambda x: x.isNotNull()),
        "__amounts": F.coalesce(amounts, F.expr("cast(array() as array<string>)")),
        "__thin": F.filter(F.array(flag((desc != "") & (F.char_length(desc) < 50), "SHORT_DESCRIPTION"), flag(desc == "", "NO_DESCRIPTION")), lambda x: x.isNotNull()),
        "__short": _listed(url, K.SHORTENERS, "SHORTENED_URL: "),
        "__mail": F.filter(F.array(flag(personal_email(desc), "PERSONAL_EMAIL")), lambda x: x.isNotNull()),
    })
    lists = [F.col(f"__{c}") for c in ("scam", "ghost", "first", "amounts", "thin", "short", "mail")]
    scam, ghost = F.size("__scam"), F.size("__ghost")
    other = sum((F.size(c) for c in lists[2:]), F.lit(0))
    risk = F.when((scam > 0) | (ghost >= 2) | ((ghost >= 1) & (other >= 2)), "high").when(ghost + other >= 3, "medium").otherwise("low")
    out = out.withColumns({"flags": F.concat(*lists), "risk": risk})
    return out.drop(*(f"__{c}" for c in (*names, "full", "scam", "ghost", "first", "amounts", "thin", "short", "mail")))


def risk_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    judged = with_risk(df)
    return judged.filter("risk <> 'high'"), judged.filter("risk in ('high', 'medium')")


def active_sources(sources: DataFrame, failures: DataFrame, now: Column, days: int = 7, successes: DataFrame | None = None) -> DataFrame:
    """Sources whose last failure is not within the last days, or was followed by a success.

    failures and successes are events (source, slug, ts); the latest of each counts, null times never do.
    """
    last = failures.groupBy("source", "slug").agg(F.max("ts").alias("ts"))
    if successes is not None:
        good = successes.groupBy("source", "slug").agg(F.max("ts").alias("good"))
        last = last.join(good, ["source", "slug"], "left").filter(F.col("good").isNull() | (F.col("good") < F.col("ts")))
    recent = last.filter((F.unix_timestamp(now) - F.unix_timestamp("ts")) < days * 86400).select("source", "slug")
    return sources.join(recent, ["source", "slug"], "left_anti")


def first_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first condition that drops a row, or null: the order of the filters."""
    out = None
    for name, cond in reasons.items():
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def drop_counts(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """How many rows each filter drops, in order, and how many stay (reason 'kept')."""
    return df.select(F.coalesce(first_reason(reasons), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def company_tier(company: Column, tiers: dict | None = None) -> Column:
    """mega, large or growth, by lists of names in lower case."""
    c = F.lower(F.trim(T.text(company)))
    out = F.when(F.lit(False), "")
    for tier, names in (tiers or K.COMPANY_TIERS).items():
        out = out.when(c.isin(*names), tier)
    return out.otherwise("growth")


def filter_freshness(df: DataFrame, now: Column, windows: dict[str, int] | None = None, tiers: dict | None = None) -> DataFrame:
    """Postings not older than their company tier's window of days; 0 is no limit, undated postings pass."""
    limit = F.lit(0)
    for tier, days in (windows or K.FRESHNESS_DAYS).items():
        limit = F.when(company_tier(F.col("company"), tiers) == tier, F.lit(days)).otherwise(limit)
    age = F.unix_timestamp(now) - F.unix_timestamp("posted_date")
    return df.filter(F.col("posted_date").isNull() | (limit == 0) | (age <= limit * 86400))


def filter_view(df: DataFrame, allowed, blocked, blocked_titles) -> DataFrame:
    """Client-side view filter; unlike filter_location remote postings get no bypass."""
    location = F.lower(T.text(F.col("location")))
    ok = ~T.any_in(location, blocked) & T.blocked_hit(F.col("title"), blocked_titles).isNull()
    return df.filter(ok & T.any_in(location, allowed) if allowed else ok)


def filter_radius(df: DataFrame, cities: DataFrame, pins: list[tuple[float, float]], km: float) -> DataFrame:
    """Postings within ``km`` of any pin; those with no known city pass, and so do remote ones.

    ``cities`` (key, lat, lon) is a small table given by the caller; the longest key in the location wins.
    """
    located = with_city(df, cities)
    near = F.lit(False)
    for lat, lon in pins:
        near = near | (X.haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= km)
    remote = X.work_mode(F.col("remote"), F.col("location")) == "remote"
    return located.filter(remote | F.col("lat").isNull() | near)


GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """Distinct pieces of ``n`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, n)))


def with_city(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Adds city, lat and lon of the longest city key that the location holds; an empty key stands for no city.

    Distinct locations meet keys on one piece of three characters (or the whole key, if it is shorter): of the pieces of a
    key, all of which a location that holds it must have, the one that the fewest locations have.
    """
    low = F.lower("__place")
    places = df.select(F.coalesce("location", F.lit("")).alias("__place")).distinct()
    keys = cities.filter("key <> ''").select("key", "lat", "lon", F.least(F.char_length("key"), F.lit(GRAM)).alias("q"))
    sizes = F.filter(F.array(*map(F.lit, range(1, GRAM + 1))), lambda q: q <= F.char_length(low))
    pieces = places.select("__place", F.explode(F.flatten(F.transform(sizes, lambda q: _grams(low, q)))).alias("gram"))
    common = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("places"))
    asked = keys.withColumn("gram", F.explode(_grams(F.col("key"), F.col("q")))).join(common, "gram", "left")
    rare = asked.groupBy("key", "lat", "lon").agg(F.min_by("gram", F.struct("places", "gram")).alias("gram"), F.count_if(F.col("places").isNull()).alias("absent")).filter("absent = 0")
    hits = pieces.join(rare.drop("absent"), "gram").filter(F.contains(low, F.col("key")))
    best = hits.groupBy("__place").agg(F.max(F.struct(F.char_length("key").alias("n"), F.col("key").alias("city"), "lat", "lon")).alias("c"))
    return df.join(best, F.coalesce("location", F.lit("")) == F.col("__place"), "left").select(df["*"], "c.city", "c.lat", "c.lon")


def filter_recent(df: DataFrame, days: int, now: Column) -> DataFrame:
    """Last seen, first seen or posted within the window; rows without any of them pass."""
    at = F.coalesce("last_seen_at", "first_seen_at", "posted_date")
    return df.filter(at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) <= days * 86400))


def prune_keywords(keywords: DataFrame, prefs: Preferences) -> DataFrame:
    """Query keywords without those that name too senior roles; "product management" goes where "product manager" is searched."""
    t = F.lower("keyword")
    kept = keywords.filter(~T.any_in(t, K.SENIOR_QUERIES)) if prefs.trapdoor and 0 < prefs.years_experience < 8 else keywords
    both = F.broadcast(kept.agg(F.coalesce(F.bool_or(F.col("keyword") == "product manager"), F.lit(False)).alias("__both")))  # one row
    return kept.join(both).filter(~(F.col("__both") & (F.col("keyword") == "product management"))).drop("__both")
