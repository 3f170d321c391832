"""Queries of the ghost score, the match score and the ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.operators import filters as O
from postmill.operators import ghost as G
from postmill.operators import grid as B
from postmill.operators import scoring as S
from postmill.operators.shared import cut_lineage
from postmill.plans.derived import P_CTE, postings, query, sql_case, sql_first, table
from postmill.plans.filter_queries import BLOCKED_SQL, JOB_LEVEL_SQL, LOCATION_REASON_SQL, PREFS, YEARS_SQL


def now():
    return F.lit("2001-08-02").cast("timestamp")


_TITLE = "lower(title)"
_BODY = "lower(description || ' ' || title)"
_DAYS = "(date_diff('second', posted_date, TIMESTAMP '2001-08-02') // 86400)"
_G_LEVEL = sql_first(_TITLE, K.GHOST_TITLE_LEVELS)
_G_LO = sql_case(f"({_G_LEVEL})", {k: v[0] for k, v in K.GHOST_LEVEL_YEARS.items()}, "NULL")
_G_HI = sql_case(f"({_G_LEVEL})", {k: v[1] for k, v in K.GHOST_LEVEL_YEARS.items()}, "NULL")
_BUZZ = " + ".join("CASE WHEN contains(body, '" + w.replace("'", "''") + "') THEN 1 ELSE 0 END" for w in K.BUZZWORDS)

GHOST_CTES = f"""{P_CTE}, g0 AS (SELECT *, {_BODY} AS body, {_DAYS} AS days, ({_G_LO}) AS glo, ({_G_HI}) AS ghi, CAST(regexp_extract(description, '([0-9]+)[+] years', 1) AS INT) AS yoe,
  row_number() OVER (PARTITION BY lower(company), lower(title), lower(location) ORDER BY ingest_seq) AS rn FROM postings),
g1 AS (SELECT *, CASE WHEN days IS NULL THEN NULL WHEN days <= 14 THEN 0.0 ELSE round(1 - exp(-(days - 14) / 30.0), 3) END AS age_stale,
  CASE WHEN salary_min IS NULL THEN NULL ELSE round(greatest(0.0, least(1.0, (salary_max / CAST(salary_min AS DOUBLE) - 3.5) / 2.5)), 3) END AS salary_band_wide,
  CASE WHEN location IN ('Remote - US', 'Worldwide') THEN 0.7 WHEN location = 'United States' THEN 0.3 ELSE 0.0 END AS location_vague,
  CASE WHEN glo IS NULL THEN NULL ELSE round(least(1.0, CASE WHEN yoe < glo THEN glo - yoe WHEN yoe > ghi THEN yoe - ghi ELSE 0 END / 6.0), 3) END AS seniority_conflict,
  CASE WHEN len(regexp_extract_all(body, '[a-z][a-z0-9+.#-]*')) < 80 THEN NULL ELSE round(least(1.0, ({_BUZZ}) / 6.0), 3) END AS buzzword_density,
  round(least(1.0, CASE WHEN length(trim(description)) < 200 THEN 0.6 ELSE 0.0 END + CASE WHEN company = '' THEN 0.4 ELSE 0.0 END), 3) AS missing_fields,
  CASE WHEN company = '' THEN NULL WHEN rn > 1 THEN 1.0 ELSE 0.0 END AS duplicate_title,
  CASE WHEN url = '' THEN 0.8 ELSE 0.0 END AS apply_url_missing, CASE WHEN technologies IS NULL THEN NULL ELSE 0.0 END AS overloaded_stack FROM g0),
g2 AS (SELECT *, greatest(({' + '.join(f'{w} * CAST(coalesce({n}, 0) AS DOUBLE)' for n, (w, _) in K.GHOST_SIGNALS.items())}) / 1.0, {', '.join(f'{cap} * CAST(coalesce({n}, 0) AS DOUBLE)' for n, (_, cap) in K.GHOST_SIGNALS.items())}) AS raw FROM g1),
g3 AS (SELECT *, CASE WHEN raw > 0 THEN round(pow(raw, 0.65), 3) ELSE 0.0 END AS eased FROM g2),
g AS (SELECT *, CASE WHEN age_stale IS NULL THEN least(eased, 0.29) ELSE eased END AS ghost FROM g3)"""

_NAMES = list(K.GHOST_SIGNALS)
_ROUNDED = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _NAMES)


def with_ghost(spark, sf):
    return G.with_ghost(postings(spark, sf), now())


@query(f"SELECT job_id, {_ROUNDED} FROM g", GHOST_CTES)
def ghost_signals(spark, sf):
    return with_ghost(spark, sf).select("job_id", *_NAMES)


@query("SELECT job_id, CAST(ghost AS DOUBLE) AS ghost, ghost >= 0.45 AS suspect FROM g", GHOST_CTES)
def ghost_score(spark, sf):
    return with_ghost(spark, sf).select("job_id", "ghost", "suspect")


@query("SELECT job_id, CASE WHEN company = '' THEN NULL ELSE rn > 1 END AS duplicate FROM g0", GHOST_CTES.split(",\ng1 AS")[0])
def duplicate_titles(spark, sf):
    return G.mark_duplicates(postings(spark, sf)).select("job_id", "duplicate")


@query("+u AS (SELECT job_id, unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS name, unnest([" + ", ".join(f"CAST({n} AS DOUBLE)" for n in _NAMES) + "]) AS v FROM g) SELECT job_id, string_agg(name, ',' ORDER BY v DESC, name) AS fired FROM u WHERE v > 0 GROUP BY job_id", GHOST_CTES)
def fired_signals(spark, sf):
    rows = with_ghost(spark, sf).select("job_id", G.fired(F.col("signals")).alias("fired"))
    return rows.filter(F.size("fired") > 0).select("job_id", F.array_join("fired", ",").alias("fired"))


def profiles(spark, sf):
    """The query set: every vector whose id is divisible by 50."""
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("profile_id"), "embedding")


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


SIM_CTE = f"sim AS MATERIALIZED (SELECT p.vec_id AS profile_id, v.vec_id, round({_cos('v.embedding', 'p.embedding')}, 4) + 0.0 AS similarity FROM embeddings v, embeddings p WHERE p.vec_id % 50 = 0)"


@query("SELECT profile_id, vec_id, similarity FROM sim", SIM_CTE)
def profile_similarity(spark, sf):
    return S.profile_similarity(table(spark, sf, "embeddings").select("vec_id", "embedding"), profiles(spark, sf))


LABEL_CTE = f"lab AS MATERIALIZED (SELECT v.vec_id, l.label, max({_cos('v.embedding', 'l.embedding')}) AS best FROM embeddings v, embeddings l WHERE l.label IN (1, 2, 3) GROUP BY 1, 2), lb AS (SELECT vec_id, max(CASE WHEN label = 1 THEN best END) AS starred, max(CASE WHEN label = 2 THEN best END) AS dismissed, max(CASE WHEN label = 3 THEN best END) AS seed FROM lab GROUP BY 1)"
LEAST = {"starred": 3, "dismissed": 3, "seed": 2}


def labels(spark, sf):
    e = table(spark, sf, "embeddings").filter("label in (1, 2, 3)")
    return e.select(F.when(F.col("label") == 1, "starred").when(F.col("label") == 2, "dismissed").otherwise("seed").alias("state"), "embedding")


@query("SELECT vec_id, round(starred, 6) AS starred, round(dismissed, 6) AS dismissed, round(seed, 6) AS seed FROM lb", LABEL_CTE)
def label_similarity(spark, sf):
    out = S.label_similarity(table(spark, sf, "embeddings"), labels(spark, sf), LEAST)
    return out.select("vec_id", *(F.round(s, 6).alias(s) for s in ("starred", "dismissed", "seed")))


_FEED = "round(greatest(0.0, least(1.0, 0.75 * similarity + 0.25 * starred - CASE WHEN dismissed > 0 THEN 0.15 * dismissed ELSE 0 END)), 6)"


@query(f"SELECT s.profile_id, s.vec_id, {_FEED} AS score FROM sim s JOIN lb ON s.vec_id = lb.vec_id", f"{SIM_CTE}, {LABEL_CTE}")
def feedback_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    known = e.select("vec_id", "embedding").join(S.label_similarity(e, labels(spark, sf), LEAST), "vec_id")  # before vectors meet profiles
    both = S.profile_similarity(known, profiles(spark, sf))
    return both.select("profile_id", "vec_id", F.round(S.feedback(F.col("similarity")), 6).alias("score"))


_CAL = "CASE WHEN x <= 0 THEN 0.0 " + " ".join(f"WHEN x <= {x1} THEN {y0} + {y1 - y0!r} * (x - {x0}) / {x1 - x0!r}" for (x0, y0), (x1, y1) in zip(K.CALIBRATION, K.CALIBRATION[1:], strict=False)) + " ELSE 0.95 END"


@query(f"+x AS (SELECT event_id, value / 100.0 AS x FROM events) SELECT event_id, CAST(floor(1000 * ({_CAL}) + 0.000001) AS INT) AS display FROM x", "e AS (SELECT 1)")
def calibrated(spark, sf):
    return table(spark, sf, "events").select("event_id", F.floor(1000 * X.calibrate(F.col("value") / 100.0) + 0.000001).cast("int").alias("display"))


def _clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


_TITLE_ADJ = f"CASE WHEN ({BLOCKED_SQL}) IS NOT NULL THEN -0.6e0 ELSE 0e0 END"
_LOC_ADJ = f"CASE WHEN ({LOCATION_REASON_SQL}) IS NOT NULL THEN -0.06e0 ELSE 0e0 END"
_SAL_ADJ = "CASE WHEN salary_min IS NULL THEN -0.3e0 * 0.15e0 WHEN (salary_min + salary_max) / 2e0 >= 150000 THEN 0.15e0 * (0.5e0 + 0.5e0 * least(((salary_min + salary_max) / 2e0 - 150000e0) / 150000e0, 1e0)) ELSE -0.15e0 END"
_YEARS_ADJ = f"CASE WHEN ({YEARS_SQL}) - 6 >= 3 THEN -0.04e0 * least(({YEARS_SQL}) - 6 - 2, 5) ELSE 0e0 END"
_BONUS = "CASE lower(company) WHEN 'company 1' THEN 0.05e0 WHEN 'company 2' THEN -0.04e0 ELSE 0e0 END"
SCORED_CTES = f"""{GHOST_CTES}, {SIM_CTE}, {LABEL_CTE}, ga AS MATERIALIZED (SELECT job_id, ingest_seq, title, vec_id, CAST(ghost AS DOUBLE) AS ghost, {_TITLE_ADJ} AS a1, {_LOC_ADJ} AS a2, {_SAL_ADJ} AS a3, {_YEARS_ADJ} AS a4, {_BONUS} AS bonus FROM g),
fs AS MATERIALIZED (SELECT s.profile_id, s.vec_id, {_FEED} AS score FROM sim s JOIN lb ON s.vec_id = lb.vec_id),
s0 AS (SELECT fs.profile_id, fs.score, ga.* FROM ga JOIN fs ON ga.vec_id = fs.vec_id),
s1 AS (SELECT *, {_clamp(_clamp(_clamp(_clamp('score + a1') + ' + a2') + ' + a3') + ' + a4')} AS fit FROM s0),
s2 AS (SELECT *, round(fit * (1 - 0.35 * ghost), 4) AS folded FROM s1),
s3 AS (SELECT *, CASE WHEN folded >= 0.6 THEN 'match' WHEN folded >= 0.45 THEN 'maybe' ELSE 'none' END AS tier, CASE WHEN ghost >= 0.45 THEN 'flag' WHEN ghost >= 0.3 THEN 'warn' ELSE 'clear' END AS ghost_band,
  CASE WHEN bonus = 0 THEN folded ELSE round({_clamp('folded * (1 + bonus)')}, 4) END AS x FROM s2),
scored AS MATERIALIZED (SELECT *, x AS match_score, {_CAL} AS display FROM s3)"""


def scorable_parts(spark, sf):
    """Postings with adjustments, ghost score and company bonus, and the vectors, with label likeness, that their vec_id names.

    What depends on the posting alone is worked out, and stored once, before postings meet profiles.
    """
    e = table(spark, sf, "embeddings")
    p = O.with_levels(postings(spark, sf)).withColumn("salary_usd", (F.col("salary_min") + F.col("salary_max")) / 2)
    signals = spark.createDataFrame([("company 1", 0.05), ("company 2", -0.04)], "company_key string, bonus double")
    p = S.with_bonus(S.adjustments(p, PREFS), F.broadcast(signals))  # two rows
    p = G.with_ghost(p, now()).select("vec_id", "job_id", "ingest_seq", "title", "ghost", "adjustments", "bonus")
    likeness = S.label_similarity(e, labels(spark, sf), LEAST)
    return cut_lineage(p), cut_lineage(e.select("vec_id", "embedding").join(likeness, "vec_id"))


def scored(spark, sf, columns):
    """The whole chain, for every pair: similarity, feedback, adjustments, ghost fold, tiers, company bonus."""
    p, vectors = scorable_parts(spark, sf)
    return B.all_scores(p, profiles(spark, sf), columns, vectors=vectors).withColumn("tier", S.tier(F.col("folded")))


@query("SELECT profile_id, job_id, CAST(floor(1000 * match_score + 0.000001) AS INT) AS score_permille, CAST(floor(1000 * display + 0.000001) AS INT) AS display_permille, tier, ghost_band, CAST(ghost AS DOUBLE) AS ghost FROM scored", SCORED_CTES)
def score_postings(spark, sf):
    permille = F.floor(1000 * X.calibrate(F.col("match_score")) + 0.000001).cast("int")  # no ties of rounding
    score = F.floor(1000 * F.col("match_score") + 0.000001).cast("int").alias("score_permille")
    return scored(spark, sf, ["job_id", "ghost"]).select("profile_id", "job_id", score, permille.alias("display_permille"), "tier", S.ghost_band(F.col("ghost")).alias("ghost_band"), "ghost")


@query("SELECT profile_id, tier, count(*) AS n FROM scored GROUP BY 1, 2", SCORED_CTES)
def tier_counts(spark, sf):
    names = F.element_at(F.array(*map(F.lit, ("none", "maybe", "match"))), F.col("level") + 1)
    p, vectors = scorable_parts(spark, sf)
    return B.score_counts(p, profiles(spark, sf), [0.45, 0.60], vectors=vectors).select("profile_id", names.alias("tier"), "n")


@query("SELECT profile_id, job_id, CASE WHEN tier = 'match' AND k > 25 THEN 'maybe' ELSE tier END AS tier, tier = 'match' AND k > 25 AS capped FROM (SELECT profile_id, job_id, tier, row_number() OVER (PARTITION BY profile_id, tier ORDER BY match_score DESC, ingest_seq) AS k FROM scored)", SCORED_CTES)
def capped_matches(spark, sf):
    p, vectors = scorable_parts(spark, sf)
    rows = B.capped_scores(p, profiles(spark, sf), ["job_id"], 25, "ingest_seq", 0.60, vectors=vectors)
    tier = F.when(F.col("capped"), "maybe").otherwise(S.tier(F.col("folded"))).alias("tier")
    return rows.select("profile_id", "job_id", tier, "capped")


_RERANK = """+t AS (SELECT profile_id, job_id, ingest_seq, match_score, ln(1 + job_id % 17) AS pair_score, row_number() OVER (PARTITION BY profile_id ORDER BY match_score DESC, ingest_seq) AS rank FROM scored),
u AS (SELECT *, round(0.44999999999999996 * match_score + 0.55 * ((pair_score - min(pair_score) OVER (PARTITION BY profile_id)) / (max(pair_score) OVER (PARTITION BY profile_id) - min(pair_score) OVER (PARTITION BY profile_id))), 4) AS reranked FROM t WHERE rank <= 40)
SELECT profile_id, job_id, rank, CAST(floor(1000 * reranked + 0.000001) AS INT) AS reranked_permille, row_number() OVER (PARTITION BY profile_id ORDER BY reranked DESC, ingest_seq) AS new_rank FROM u"""


@query(_RERANK, SCORED_CTES)
def reranked(spark, sf):
    p, vectors = scorable_parts(spark, sf)
    best = B.best_scores(p, profiles(spark, sf), ["job_id", "ingest_seq"], 40, ["ingest_seq"], vectors=vectors)
    rows = best.withColumn("pair_score", F.log1p(F.col("job_id") % 17))
    return S.rerank(rows, 40).select("profile_id", "job_id", F.col("rank").cast("long").alias("rank"), F.floor(1000 * F.col("reranked") + 0.000001).cast("int").alias("reranked_permille"), F.col("new_rank").cast("long").alias("new_rank"))


@query("SELECT profile_id, job_id, match_score FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY match_score DESC, title, ingest_seq) AS k FROM scored) WHERE k <= 8", SCORED_CTES)
def top_for_analysis(spark, sf):
    """The eight best of each profile."""
    p, vectors = scorable_parts(spark, sf)
    best = B.best_scores(p, profiles(spark, sf), ["job_id", "title", "ingest_seq"], 8, ["title", "ingest_seq"], vectors=vectors)
    return S.top_scored(best, 8).select("profile_id", "job_id", "match_score")




_FP = ["growth", "payments", "steel", "roadmap", "python"]
_TECH = ["python", "aws", "rust"]
_J = "job_level"
_PR = f"nullif({sql_case(_J, K.PROFILE_RANK, 'NULL')}, 0)"
_FULL = "lower(title || ' ' || description || ' ' || company || ' ' || coalesce(array_to_string(technologies, ' '), ''))"
_DIMS = f"""+j AS MATERIALIZED (SELECT *, {JOB_LEVEL_SQL} AS job_level FROM postings), d AS (SELECT job_id, CASE abs({_PR} - 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.4 ELSE CASE WHEN {_PR} IS NOT NULL THEN 0.15 END END AS seniority_fit,
 round(({' + '.join(f"CASE WHEN regexp_matches(lower(description || ' ' || title), '(^|[^A-Za-z0-9]){t}([^A-Za-z0-9]|$)') OR coalesce(list_contains(technologies, '{t}'), false) THEN 1 ELSE 0 END" for t in _TECH)}) / 3.0, 3) AS tech_fit,
 round(({' + '.join(f"CASE WHEN contains({_FULL}, '{t}') THEN 1 ELSE 0 END" for t in _FP)}) / 5.0, 3) AS domain_fit,
 CASE WHEN {_J} = '' THEN NULL WHEN 6 >= ({sql_case(_J, K.PROFILE_YEARS, 'NULL')}) THEN 1.0 ELSE round(6 / CAST(({sql_case(_J, K.PROFILE_YEARS, 'NULL')}) AS DOUBLE), 3) END AS years_fit FROM j)
SELECT job_id, CAST(seniority_fit AS DOUBLE) AS seniority_fit, CAST(tech_fit AS DOUBLE) AS tech_fit, CAST(domain_fit AS DOUBLE) AS domain_fit, CAST(years_fit AS DOUBLE) AS years_fit FROM d"""


_LANE_LIST = "list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(lower(title), '" + K.LANE_BOILERPLATE + r"', ' ', 'g'), '[,/|\-–—\s]+'), lambda w: regexp_replace(w, '^[.,()]+|[.,()]+$', '', 'g')), lambda w: length(w) >= 3 AND w NOT IN ('" + "', '".join(K.GENERIC_LANE_WORDS) + "')))"
_NEAR = " OR ".join(f"contains(w, '{t}') OR contains('{t}', w)" for t in _FP)
_ALL_DIMS = _DIMS.split("\nSELECT")[0].replace("AS years_fit FROM j)", f"AS years_fit, {_LANE_LIST} AS lane FROM j), l AS (SELECT *, CASE WHEN len(lane) > 0 THEN round(len(list_filter(lane, lambda w: {_NEAR})) / CAST(len(lane) AS DOUBLE), 3) END AS lane_fit FROM d)")


@query(_ALL_DIMS + " SELECT job_id, CAST(seniority_fit AS DOUBLE) AS seniority_fit, CAST(tech_fit AS DOUBLE) AS tech_fit, CAST(domain_fit AS DOUBLE) AS domain_fit, CAST(years_fit AS DOUBLE) AS years_fit, lane_fit, CAST(floor(1000 * (0.3 * coalesce(CAST(tech_fit AS DOUBLE), 0) + 0.35 * coalesce(CAST(domain_fit AS DOUBLE), 0) + 0.2 * coalesce(lane_fit, 0) + 0.15 * coalesce(CAST(seniority_fit AS DOUBLE), 0)) / (0.65 + CASE WHEN lane_fit IS NULL THEN 0 ELSE 0.2 END + CASE WHEN seniority_fit IS NULL THEN 0 ELSE 0.15 END) + 0.5001) AS INT) AS headline_permille FROM l")
def dimensions(spark, sf):
    p = O.with_levels(postings(spark, sf)).withColumns({
        "p_seniority": F.lit("senior"), "p_years": F.lit(6), "p_technologies": F.array(*map(F.lit, _TECH)), "p_fingerprint": F.array(*map(F.lit, _FP)),
    })
    permille = F.floor(1000 * F.col("headline") + 0.1).cast("int").alias("headline_permille")
    return S.dimensions(p).select("job_id", "seniority_fit", "tech_fit", "domain_fit", "years_fit", "lane_fit", permille)


