"""Scores of postings against profiles: similarity, adjustments, tiers, ghost fold, company bonus, cap and rerank."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as P

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.operators import filters as O
from postmill.operators.similarity import all_similarities as profile_similarity
from postmill.operators.similarity import highest_similarities as label_similarity

ENCODE_ROWS = 32


def with_batches(rows: DataFrame, encoder: Callable[[list], list], schema: str, columns: tuple[str, ...], batch: int = ENCODE_ROWS) -> DataFrame:
    """``rows`` with the columns of ``schema`` that a caller's model gives for batches of ``batch`` rows.

    ``encoder`` gets a list of tuples of ``columns`` and returns as many values for the one column of ``schema``. Rows of a
    task are taken in order; a model that loads lazily does so once a task.
    """
    added = P.StructType.fromDDL(schema)
    name = added.fields[0].name

    def run(batches):
        for frame in batches:
            for k in range(0, frame.num_rows, batch):
                part = frame.slice(k, batch)
                values = encoder(list(zip(*(part.column(c).to_pylist() for c in columns), strict=True)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, kind)], [*part.schema.names, name])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(added.fields[0].dataType)
    return rows.mapInArrow(run, P.StructType([*rows.schema.fields, *added.fields]))


def encode(rows: DataFrame, encoder: Callable[[list], list], most: int = 1500, batch: int = ENCODE_ROWS) -> DataFrame:
    """Rows (text, ...) with embedding, from texts of at most ``most`` characters."""
    short = rows.withColumn("__short", F.substring(T.text(F.col("text")), 1, most))
    return with_batches(short, lambda items: encoder([t for (t,) in items]), "embedding array<float>", ("__short",), batch).drop("__short")


def score_pairs(rows: DataFrame, scorer: Callable[[list], list], batch: int = ENCODE_ROWS) -> DataFrame:
    """Rows (profile_text, text, ...) with pair_score."""
    return with_batches(rows, scorer, "pair_score double", ("profile_text", "text"), batch)


def encode_missing(rows: DataFrame, cache: DataFrame, model: str, encoder: Callable[[list], list]) -> DataFrame:
    """Cache rows (text_key, model, embedding) for the texts that have none of this model: each text is encoded once."""
    from postmill.operators.registry import split_cached

    _, misses = split_cached(rows, cache, model)
    return encode(misses.select("text_key", "text").dropDuplicates(["text_key"]), encoder).select("text_key", F.lit(model).alias("model"), "embedding")


def feedback(base: Column) -> Column:
    """Starred likeness lifts, else seed likeness does; dismissed likeness lowers. Needs the columns of label_similarity."""
    starred, seed, dismissed = F.col("starred"), F.col("seed"), F.col("dismissed")
    lifted = F.when(starred.isNotNull(), 0.75 * base + 0.25 * starred).when(seed.isNotNull(), 0.88 * base + 0.12 * seed).otherwise(base)
    return X.clamp(lifted - F.when(dismissed > 0, 0.15 * dismissed).otherwise(0.0))


def title_adjust(prefs: O.Preferences, boost: float) -> Column:
    blocked = T.blocked_hit(F.col("title"), prefs.blocked_title_keywords).isNotNull()
    wanted = T.blocked_hit(F.col("title"), prefs.role_keywords).isNotNull()
    own = K.LEVEL_RANK.get(prefs.level, 99)
    fits = F.coalesce(X.level_rank(F.col("job_level")) <= own, F.lit(True))
    return F.when(T.text(F.col("title")) == "", 0.0).when(blocked, -prefs.title_penalty).when(wanted & fits, boost).otherwise(0.0)


def seniority_adjust(prefs: O.Preferences) -> Column:
    gap = X.level_rank(F.col("job_level")) - K.LEVEL_RANK.get(prefs.level, 99)
    return F.when(gap > 0, -prefs.level_weight * gap).otherwise(0.0)


def location_adjust(prefs: O.Preferences) -> Column:
    return F.when(O.location_reason(prefs).isNotNull(), -prefs.location_weight).otherwise(0.0)


def salary_adjust(prefs: O.Preferences, usd: Column) -> Column:
    floor, w = prefs.salary_floor_usd, prefs.salary_weight
    over = F.least((usd - floor) / floor, F.lit(1.0))
    return F.when(usd.isNull(), -0.3 * w).when(usd >= floor, w * (0.5 + 0.5 * over)).otherwise(-w)


def years_adjust(prefs: O.Preferences) -> Column:
    gap = F.col("required_years") - prefs.years_experience
    return F.when(gap >= 3, -prefs.years_weight * F.least(gap - 2, F.lit(5))).otherwise(0.0)


def tier(score: Column, match: float = 0.60, maybe: float = 0.45) -> Column:
    return F.when(score >= match, "match").when(score >= maybe, "maybe").otherwise("none")


def adjustments(df: DataFrame, prefs: O.Preferences, *, structured_profile: bool = True, title_boost: float = 0.0) -> DataFrame:
    """Adds adjustments, an array of the steps in their order: what a posting adds to any profile's score.

    Needs job_level, required_years and salary_usd. Work them out before postings meet profiles.
    """
    steps = [title_adjust(prefs, title_boost)] + ([] if structured_profile else [seniority_adjust(prefs)])
    steps += [location_adjust(prefs), salary_adjust(prefs, F.col("salary_usd")), years_adjust(prefs)]
    return df.withColumn("adjustments", F.array(*(F.coalesce(s.cast("double"), F.lit(0.0)) for s in steps)))


def fitted(df: DataFrame, steps: int = 4) -> DataFrame:
    """Adds fit: the score after the adjustments, each step clamped to 0..1."""
    fit = F.col("score")
    for i in range(steps):
        fit = X.clamp(fit + F.get("adjustments", F.lit(i)))
    return df.withColumn("fit", fit)


def adjust(df: DataFrame, prefs: O.Preferences, *, structured_profile: bool = True, title_boost: float = 0.0) -> DataFrame:
    """Rows with score, fitted at once."""
    rows = adjustments(df, prefs, structured_profile=structured_profile, title_boost=title_boost)
    return fitted(rows, 4 if structured_profile else 5).drop("adjustments")


def top_scored(df: DataFrame, n: int) -> DataFrame:
    """Of each profile the n rows of highest score, ties by title and then arrival.

    Each of 64 parts of a profile keeps its n best, so that its rows are not sorted in one task.
    """
    order = [F.desc("match_score"), F.asc("title"), F.asc("ingest_seq")]
    parts = df.withColumn("__part", F.pmod(F.xxhash64("ingest_seq"), F.lit(64)))
    few = parts.withColumn("__r", F.row_number().over(W.partitionBy("profile_id", "__part").orderBy(*order))).filter(F.col("__r") <= n)
    return few.withColumn("__r", F.row_number().over(W.partitionBy("profile_id").orderBy(*order))).filter(F.col("__r") <= n).drop("__r", "__part")


def ghost_band(ghost: Column, flag: float = 0.45, warn: float = 0.30) -> Column:
    return F.when(ghost >= flag, "flag").when(ghost >= warn, "warn").otherwise("clear")


def fold_ghost(df: DataFrame, weight: float = 0.35, flag: float = 0.45, warn: float = 0.30) -> DataFrame:
    """Adds match_score (fit lowered by the ghost score), display, tier and ghost_band. Needs fit and ghost."""
    folded = F.round(F.col("fit") * X.clamp(1 - weight * F.col("ghost")), 4)
    out = df.withColumn("match_score", folded)
    return out.withColumns({
        "display": F.round(X.calibrate(F.col("match_score")), 4), "tier": tier(F.col("match_score")),
        "ghost_band": ghost_band(F.col("ghost"), flag, warn),
    })


def with_bonus(df: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds the company's bonus, 0 where signals (company_key, bonus) has none."""
    keyed = df.withColumn("company_key", F.lower(F.trim(T.text(F.col("company")))))
    return keyed.join(signals, "company_key", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0))).drop("company_key")


def company_bonus(df: DataFrame, signals: DataFrame) -> DataFrame:
    """match_score times one plus the company's bonus, and display anew; tiers stay. signals: (company_key, bonus)."""
    out = with_bonus(df, signals).withColumn("match_score", F.when(F.col("bonus") == 0, F.col("match_score")).otherwise(F.round(X.clamp(F.col("match_score") * (1 + F.col("bonus"))), 4)))
    return out.withColumn("display", F.round(X.calibrate(F.col("match_score")), 4))


def cap_matches(df: DataFrame, n: int, best: DataFrame | None = None) -> DataFrame:
    """The n best of the match tier of each profile stay; the others become maybe and are marked.

    Ranks of all matches of a profile would meet in one task, so the n-th score is found first: each group of rows
    keeps its n best, and only those are ranked. ``best``: matches (profile_id, match_score, ingest_seq) that hold these n, where they
    are known; then the n-th scores, one a profile, are sent to all rows, which stay where they are.
    """
    key = F.struct((-F.col("match_score")).alias("s"), F.col("ingest_seq").alias("q"))
    matches = df.filter("tier = 'match'") if best is None else best
    matches = matches.select("profile_id", key.alias("__key"), F.pmod(F.xxhash64("ingest_seq"), F.lit(64)).alias("__part"))
    local = matches.withColumn("__r", F.row_number().over(W.partitionBy("profile_id", "__part").orderBy("__key"))).filter(F.col("__r") <= n)
    last = local.withColumn("__r", F.row_number().over(W.partitionBy("profile_id").orderBy("__key"))).filter(F.col("__r") == n).select("profile_id", F.col("__key").alias("__last"))
    out = df.join(last if best is None else F.broadcast(last), "profile_id", "left")
    over = (F.col("tier") == "match") & F.col("__last").isNotNull() & (key > F.col("__last"))
    return out.withColumn("capped", F.coalesce(over, F.lit(False))).withColumn("tier", F.when(F.col("capped"), "maybe").otherwise(F.col("tier"))).drop("__last")


def rerank(df: DataFrame, n: int, weight: float = 0.55) -> DataFrame:
    """Of each profile's n best rows: pair scores (column pair_score) scaled to 0..1 in the batch, blended, tiers anew.

    Returns those rows only, with reranked and new_tier; a single row is left alone.
    """
    w = W.partitionBy("profile_id")
    part = df.withColumn("__part", F.pmod(F.xxhash64("ingest_seq"), F.lit(64)))
    order = [F.desc("match_score"), F.asc("ingest_seq")]
    local = part.withColumn("__r", F.row_number().over(W.partitionBy("profile_id", "__part").orderBy(*order))).filter(F.col("__r") <= n)
    top = local.withColumn("rank", F.row_number().over(w.orderBy(*order))).filter(F.col("rank") <= n).drop("__r", "__part")
    lo, hi = F.min("pair_score").over(w), F.max("pair_score").over(w)
    norm = F.when(hi - lo < 1e-6, 1 / (1 + F.exp(-F.col("pair_score")))).otherwise((F.col("pair_score") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    blended = F.round((1 - weight) * F.col("match_score") + weight * norm, 4)
    out = top.withColumn("reranked", F.when(F.count(F.lit(1)).over(w) < 2, F.col("match_score")).otherwise(blended))
    return out.withColumns({"new_tier": tier(F.col("reranked")), "new_rank": F.row_number().over(w.orderBy(F.desc("reranked"), F.asc("ingest_seq")))})


def ordinal_fit(profile: Column, job: Column) -> Column:
    """1, 0.75, 0.4 or 0.15 by the distance of the bands; null if either is unknown (an intern's rank 0 is unknown)."""
    p, j = (F.nullif(T.mapped(c, K.PROFILE_RANK, F.lit(None).cast("int")), F.lit(0)) for c in (profile, job))
    gap = F.abs(p - j)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.75).when(gap == 2, 0.40).when(gap > 2, 0.15)


def years_fit(years: Column, job: Column) -> Column:
    floor = T.mapped(job, K.PROFILE_YEARS, F.lit(None).cast("int"))
    return F.when((years < 0) | floor.isNull(), None).when((floor <= 0) | (years >= floor), 1.0).otherwise(F.round(years / F.nullif(floor, F.lit(0)), 3))


def share_found(words: Column, found) -> Column:
    """Share of the words for which ``found`` holds; null without words."""
    return F.when(F.size(words) > 0, F.round(F.size(F.filter(words, found)) / F.nullif(F.size(words), F.lit(0)), 3))


def target_role_fit(title: Column, targets: Column) -> Column:
    """Highest share of a target role's words that the title holds; 1 if one holds the other, null without either."""
    words = lambda s: F.array_distinct(F.concat(T.lane_tokens(s), F.filter(F.split(s, r"\s+"), lambda w: w != "")))

    def best(t: Column) -> Column:
        have = words(t)
        near = lambda w: F.contains(t, w) | F.exists(have, lambda h: F.contains(h, w) | F.contains(w, h))
        share = lambda own: F.try_divide(F.size(F.filter(own, near)), F.size(own))
        one = lambda r: F.when(F.contains(t, r) | F.contains(r, t), 1.0).otherwise(F.coalesce(T.let(words(r), share), F.lit(0.0)))
        return F.array_max(F.transform(F.transform(targets, lambda r: F.lower(r)), one))

    known = (T.text(title) != "") & (F.size(targets) > 0)
    return F.when(known, F.round(T.let(F.lower(T.text(title)), best), 3))


def mean_headline() -> Column:
    """The older headline: half technologies, 0.3 domains and 0.2 seniority, over those known."""
    parts = [(0.5, "tech_fit"), (0.3, "domain_fit"), (0.2, "seniority_fit")]
    total = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for w, n in parts), F.lit(0.0))
    return F.round(F.try_divide(sum((F.coalesce(w * F.col(n), F.lit(0.0)) for w, n in parts), F.lit(0.0)), total), 3)


def _marked(s: Column) -> Column:
    """The text with a sign at each place between a letter or digit and another character, and one between two others."""
    change = F.regexp_replace(F.concat(F.lit(" "), s, F.lit(" ")), r"(?<=[a-z0-9])(?![a-z0-9])|(?<![a-z0-9])(?=[a-z0-9])", "\x01")
    return F.regexp_replace(change, "(?<![a-z0-9\x01])(?![a-z0-9\x01])", "\x02")


def stands_alone(marked: Column, word: Column) -> Column:
    """Whether a word in lower case stands in a ``_marked`` text with no letter or digit next to it; no pattern is compiled
    for the word."""
    return T.let(_marked(word), lambda m: F.contains(marked, F.substring(m, F.lit(3), F.char_length(m) - 4)))


def dimensions(df: DataFrame) -> DataFrame:
    """Adds seniority_fit, tech_fit, domain_fit, lane_fit, years_fit and headline.

    Needs job_level and the profile's p_seniority, p_years, p_technologies (lower case) and p_fingerprint (tokens).
    """
    c = F.col
    body = F.lower(F.concat_ws(" ", T.text(c("description")), T.text(c("title"))))
    alone = lambda b, t: F.contains(b, t) & stands_alone(_marked(b), t)
    full = F.lower(F.concat_ws(" ", T.text(c("title")), T.text(c("description")), T.text(c("company")), F.coalesce(F.array_join("technologies", " "), F.lit(""))))
    stack = F.coalesce(F.transform("technologies", lambda t: F.lower(t)), F.array().cast("array<string>"))
    close = lambda t: F.exists("p_fingerprint", lambda f: F.contains(t, f) | F.contains(f, t))
    out = df.withColumns({
        "seniority_fit": ordinal_fit(c("p_seniority"), c("job_level")),
        "tech_fit": T.let(stack, lambda own: T.let(body, lambda b: share_found(c("p_technologies"), lambda t: F.array_contains(own, t) | alone(b, t)))),
        "domain_fit": T.let(full, lambda s: share_found(c("p_fingerprint"), lambda t: F.contains(s, t))),
        "lane_fit": F.when(F.size("p_fingerprint") > 0, T.let(T.lane_tokens(c("title")), lambda own: share_found(own, close))),
        "years_fit": years_fit(c("p_years"), c("job_level")),
    })
    parts = [(0.30, "tech_fit"), (0.35, "domain_fit"), (0.20, "lane_fit"), (0.15, "seniority_fit")]
    total = sum((F.when(c(n).isNotNull(), w).otherwise(0.0) for w, n in parts), F.lit(0.0))
    value = sum((F.coalesce(w * c(n), F.lit(0.0)) for w, n in parts), F.lit(0.0))
    return out.withColumn("headline", F.round(F.try_divide(value, total), 3))


def profile_adjust() -> Column:
    """Adjustment from the dimensions, -0.45 to 0.10, nothing below 0.005."""
    c = F.col
    term = lambda name, x: F.coalesce(F.when(c(name).isNotNull(), x), F.lit(0.0))
    delta = (
        term("seniority_fit", -(1 - c("seniority_fit")) * 0.22)
        + term("years_fit", F.when(c("years_fit") < 1, -(1 - c("years_fit")) * 0.18).otherwise(0.0))
        + term("lane_fit", F.when(c("lane_fit") < 0.25, -(0.25 - c("lane_fit")) * 0.38).otherwise(0.0))
        + term("domain_fit", F.when(c("domain_fit") < 0.20, -(0.20 - c("domain_fit")) * 0.32).when(c("domain_fit") >= 0.45, (c("domain_fit") - 0.45) * 0.10).otherwise(0.0))
        + term("tech_fit", (c("tech_fit") - 0.40) * 0.12)
    )
    delta = X.clamp(delta, -0.45, 0.10)
    return F.when(F.abs(delta) < 0.005, 0.0).otherwise(delta)
