"""Queries of the filters and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.operators import filters as O
from postmill.plans.derived import postings, query, sql_any, sql_case, sql_first, sql_in, table

PREFS = O.Preferences()
_LOC = "lower(coalesce(location, ''))"
_TITLE = "lower(coalesce(title, ''))"
WORK_MODE_SQL = "CASE WHEN lower(trim(remote)) IN ('remote', 'hybrid', 'onsite') THEN lower(trim(remote)) " + " ".join(
    f"WHEN {sql_any(f'(lower(trim(remote)) || chr(32) || {_LOC})', K.WORK_MODE_TOKENS[m])} THEN '{m}'" for m in K.WORK_MODES) + " ELSE 'unknown' END"
_CTEXT = "lower(coalesce(location, '') || ' ' || coalesce(remote, ''))"
COUNTRY_SQL = (
    f"CASE WHEN trim({_CTEXT}) = '' OR trim({_CTEXT}, ' -,/|') IN {sql_in(K.WORK_MODE_TOKENS['remote'])} THEN '' "
    + " ".join(f"WHEN {sql_any(_CTEXT, words)} THEN '{iso}'" for iso, words in K.COUNTRY_TOKENS.items())
    + f" WHEN regexp_matches({_CTEXT}, ', ({'|'.join(K.US_STATE_CODES)})| ({'|'.join(K.US_STATE_CODES)}) |[(]({'|'.join(K.US_STATE_CODES)})[)]') THEN 'US' ELSE '' END"
)
NORM_TITLE_SQL = "array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[()\\[\\],./]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: " + sql_case("t", K.TITLE_ALIASES, "t") + "), ' ')"
_CUT = f"trim(regexp_replace({_LOC}, '\\s+', ' ', 'g'))"
for _s in K.COUNTRY_SUFFIXES:
    _CUT = f"regexp_replace({_CUT}, '{_s}$', '')"
NORM_LOCATION_SQL = f"CASE WHEN contains({_LOC}, 'remote') THEN 'remote' ELSE trim({_CUT}) END"
DEDUPE_KEY_SQL = f"lower(trim(coalesce(company, ''))) || '||' || {NORM_TITLE_SQL} || '||' || {NORM_LOCATION_SQL}"
TITLE_LEVEL_SQL = sql_first(_TITLE, K.TITLE_LEVELS)
_TAG = "lower(trim(coalesce(seniority, '')))"
TAG_LEVEL_SQL = f"CASE WHEN {_TAG} IN {sql_in(K.LEVEL_RANK)} THEN {_TAG} ELSE {sql_case(_TAG, K.LEVEL_ALIASES, chr(39) * 2)} END"
JOB_LEVEL_SQL = f"CASE WHEN ({TITLE_LEVEL_SQL}) = '' THEN {TAG_LEVEL_SQL} WHEN ({TAG_LEVEL_SQL}) = '' THEN {TITLE_LEVEL_SQL} WHEN ({sql_case(f'({TITLE_LEVEL_SQL})', K.LEVEL_RANK, '0')}) >= ({sql_case(f'({TAG_LEVEL_SQL})', K.LEVEL_RANK, '0')}) THEN {TITLE_LEVEL_SQL} ELSE {TAG_LEVEL_SQL} END"
#: The descriptions name one requirement, "N+ years of product experience".
YEARS_SQL = "CAST(regexp_extract(description, '([0-9]+)[+] years of product experience', 1) AS INT)"


def sql_word(column: str, word: str) -> str:
    return f"regexp_matches({column}, '(^|[^a-z]){word}([^a-z]|$)')"


BLOCKED_SQL = "CASE " + " ".join(f"WHEN {sql_word(_TITLE, k)} THEN '{k}'" for k in PREFS.blocked_title_keywords) + " END"


@query(f"SELECT job_id, {NORM_TITLE_SQL} AS norm_title, {NORM_LOCATION_SQL} AS norm_location, {DEDUPE_KEY_SQL} AS dedupe_key, lower(trim(title)) || '||' || lower(trim(company)) AS job_key FROM postings")
def normalise_keys(spark, sf):
    p = postings(spark, sf)
    return p.select("job_id", T.norm_title(F.col("title")).alias("norm_title"), T.norm_location(F.col("location")).alias("norm_location"),
                    T.dedupe_key(F.col("company"), F.col("title"), F.col("location")).alias("dedupe_key"), T.job_key(F.col("title"), F.col("company")).alias("job_key"))


COMPLETENESS_SQL = "CAST(floor(length(description) / 200) AS BIGINT) + coalesce(len(technologies), 0) + CASE WHEN coalesce(seniority, 'unknown') IN ('unknown', '') THEN 0 ELSE 2 END + CASE WHEN coalesce(remote, 'unknown') IN ('unknown', '') THEN 0 ELSE 1 END + CASE WHEN posted_date IS NULL THEN 0 ELSE 1 END + CASE WHEN coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0 THEN 3 ELSE 0 END"


@query(f"SELECT job_id, CAST({COMPLETENESS_SQL} AS BIGINT) AS completeness FROM postings")
def completeness(spark, sf):
    return postings(spark, sf).select("job_id", T.completeness().alias("completeness"))


_DROPPED = "^(" + "|".join(K.TRACKING_PARAMS) + ")"
_URL_SQL = f"""+u AS (SELECT job_id, url, company, title, location, regexp_replace(lower(trim(url)), '#.*$', '') AS u FROM postings), s AS (SELECT *, regexp_replace(split_part(u, '?', 1), '/+$', '') AS base,
 list_sort(list_filter(string_split(split_part(u, '?', 2), '&'), lambda p: regexp_matches(p, '^[^=]*=.') AND NOT regexp_matches(p, '{_DROPPED}'))) AS q FROM u)
SELECT job_id, CASE WHEN url = '' THEN '' ELSE regexp_replace(base, '^(https?://[^/]*):(80|443)(/|$)', '\\1\\3') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key,
 CASE WHEN url = '' THEN company || '::' || title || '::' || location ELSE url END AS row_key FROM s"""


@query(_URL_SQL)
def normalise_urls(spark, sf):
    return postings(spark, sf).select("job_id", T.norm_url(F.col("url")).alias("url_key"), T.row_key(F.col("url"), F.col("company"), F.col("title"), F.col("location")).alias("row_key"))


@query(f"SELECT job_id, {WORK_MODE_SQL} AS work_mode, {COUNTRY_SQL} AS country, lower(trim(location)) IN {sql_in(K.COUNTRY_ONLY)} AS country_only FROM postings")
def places(spark, sf):
    c = F.col
    return postings(spark, sf).select("job_id", X.work_mode(c("remote"), c("location")).alias("work_mode"), X.detect_country(c("location"), c("remote")).alias("country"), X.is_country_only(c("location")).alias("country_only"))


@query(f"SELECT job_id, {TITLE_LEVEL_SQL} AS title_level, {JOB_LEVEL_SQL} AS job_level, CASE job_id % 6 WHEN 0 THEN 25 WHEN 1 THEN greatest({YEARS_SQL}, 12) ELSE {YEARS_SQL} END AS required_years FROM postings")
def levels_and_years(spark, sf):
    """Some postings name years among their requirements or in a list of qualifications, too."""
    k = F.col("job_id") % 6
    more = {"requirements": F.when(k == 0, "needs 25+ years of product experience"), "qualifications": F.when(k == 1, F.array(F.lit("degree"), F.lit("12+ years of product experience")))}
    p = O.with_levels(postings(spark, sf).withColumns(more))
    return p.select("job_id", X.title_level(F.col("title")).alias("title_level"), "job_level", "required_years")


@query("SELECT job_id, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9+#.]+'), lambda t: length(t) >= 2 AND t NOT IN " + sql_in(K.TITLE_STOP_WORDS) + ")).list_sort() AS tokens FROM postings")
def title_token_sets(spark, sf):
    return postings(spark, sf).select("job_id", F.array_sort(T.title_tokens(F.col("title"))).alias("tokens"))


_ARCH = "CASE " + " ".join(f"WHEN regexp_matches(trim(title), '(?i)\\b({p})\\b') THEN '{s}'" for p, s in K.ARCHETYPES) + " ELSE 'unclassified' END"


@query(f"SELECT {_ARCH} AS archetype, count(*) AS n FROM postings GROUP BY 1")
def archetypes(spark, sf):
    return postings(spark, sf).groupBy(T.archetype_of_title(F.col("title")).alias("archetype")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT job_id, '$' || CAST(salary_min AS VARCHAR) || '-$' || CAST(salary_max AS VARCHAR) AS salary_text, (salary_min + salary_max) / 2.0 AS usd FROM postings WHERE salary_min IS NOT NULL")
def salary_in_usd(spark, sf):
    p = postings(spark, sf).filter("salary_min is not null").withColumn("salary_text", salary_text())
    return p.select("job_id", "salary_text", X.salary_usd(F.col("salary_text")).alias("usd"))


def salary_text():
    return F.concat(F.lit("$"), F.col("salary_min").cast("string"), F.lit("-$"), F.col("salary_max").cast("string"))


@query(f"SELECT job_id, substring(sha1('title: ' || title || CASE WHEN company <> '' THEN chr(10) || 'company: ' || company ELSE '' END || chr(10) || 'location: ' || location || chr(10) || 'description: ' || substring(description, 1, 300) || CASE WHEN seniority IS NOT NULL THEN chr(10) || 'seniority: ' || seniority ELSE '' END || chr(10) || 'remote: ' || remote || CASE WHEN technologies IS NOT NULL THEN chr(10) || 'technologies: python, kubernetes, aws' ELSE '' END), 1, 16) AS text_key FROM postings")
def text_keys(spark, sf):
    return postings(spark, sf).select("job_id", T.text_key(T.posting_text(300)).alias("text_key"))


_ARCHETYPE_HIT = f"CASE WHEN {sql_any(_TITLE, K.NON_PM_PRODUCT_TITLES)} THEN 0 ELSE 1 END"
TITLE_PASS_SQL = f"({BLOCKED_SQL}) IS NULL AND CASE WHEN contains({_TITLE}, 'product') THEN NOT {sql_any(_TITLE, K.NON_PM_PRODUCT_TITLES)} ELSE {sql_any(_TITLE, PREFS.role_keywords)} END AND NOT {sql_any(_TITLE, K.TRAPDOOR_TITLES)}"


@query(f"SELECT job_id, title FROM postings WHERE {TITLE_PASS_SQL}")
def filter_titles(spark, sf):
    return O.filter_titles(postings(spark, sf), PREFS).select("job_id", "title")


@query("SELECT page_id FROM pages WHERE contains(lower(html), 'the') OR contains(lower(html), 'eau')", "")
def filter_cards(spark, sf):
    return O.filter_cards(table(spark, sf, "pages").withColumnRenamed("html", "text"), ("the", "eau")).select("page_id")


@query(f"SELECT ({BLOCKED_SQL}) AS hit, count(*) AS n FROM postings GROUP BY 1")
def blocked_titles(spark, sf):
    return postings(spark, sf).groupBy(T.blocked_hit(F.col("title"), PREFS.blocked_title_keywords).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


COUNTRY_PASS_SQL = f"(({WORK_MODE_SQL}) = 'remote' OR ({COUNTRY_SQL}) = 'US')"


@query(f"SELECT job_id, {COUNTRY_SQL} AS country FROM postings WHERE {COUNTRY_PASS_SQL}")
def filter_country(spark, sf):
    return O.filter_country(postings(spark, sf), PREFS).select("job_id", "country")


LOCATION_REASON_SQL = f"CASE WHEN {sql_any(_LOC, PREFS.blocked_locations)} THEN 'blocked' WHEN ({WORK_MODE_SQL}) <> 'remote' AND NOT (lower(trim(location)) IN {sql_in(K.COUNTRY_ONLY)} OR location = '' OR {sql_any(_LOC, PREFS.allowed_locations)}) THEN 'not allowed' END"


@query(f"SELECT job_id, ({LOCATION_REASON_SQL}) AS reason FROM postings")
def location_reasons(spark, sf):
    return postings(spark, sf).select("job_id", O.location_reason(PREFS).alias("reason"))


_RANK = sql_case("job_level", K.LEVEL_RANK, "NULL")
EXPERIENCE_REASON_SQL = f"CASE WHEN job_level IN {sql_in(K.TRAPDOOR_LEVELS)} THEN 'trapdoor' WHEN abs(({_RANK}) - {K.LEVEL_RANK[PREFS.level]}) >= 3 THEN 'level' WHEN ({YEARS_SQL}) - 6 >= 8 THEN 'years' END"


@query(f"+j AS MATERIALIZED (SELECT description, {JOB_LEVEL_SQL} AS job_level FROM postings) SELECT reason, count(*) AS n FROM (SELECT {EXPERIENCE_REASON_SQL} AS reason FROM j) GROUP BY 1")
def experience_reasons(spark, sf):
    p = O.with_levels(postings(spark, sf))
    return p.groupBy(O.experience_reason(PREFS).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_id FROM postings WHERE {sql_any(_TITLE, ('staff', 'senior product'))} OR NOT {sql_any(_TITLE, ('engineer', 'director'))}")
def filter_archetype(spark, sf):
    return O.filter_archetype(postings(spark, sf), ("staff", "senior product"), ("engineer", "director")).select("job_id")


@query("SELECT job_id, array_to_string(list_filter([CASE WHEN trim(title) = '' THEN 'MISSING_REQUIRED: title' END, CASE WHEN trim(company) = '' THEN 'MISSING_REQUIRED: company' END, CASE WHEN trim(location) = '' THEN 'MISSING_DESIRED: location' END, CASE WHEN trim(description) = '' THEN 'MISSING_DESIRED: description' END, CASE WHEN seniority IS NULL THEN 'MISSING_DESIRED: seniority' END, CASE WHEN technologies IS NULL THEN 'MISSING_DESIRED: technologies' END], lambda x: x IS NOT NULL), '; ') AS issues, CASE WHEN company = '' THEN 'fail' WHEN seniority IS NULL OR technologies IS NULL THEN 'warn' ELSE 'pass' END AS verdict FROM postings")
def qa(spark, sf):
    return O.with_qa(postings(spark, sf)).select("job_id", F.array_join("issues", "; ").alias("issues"), "verdict")


@query("SELECT issue, count(*) AS n FROM (SELECT unnest([CASE WHEN company = '' THEN 'MISSING_REQUIRED: company' END, CASE WHEN seniority IS NULL THEN 'MISSING_DESIRED: seniority' END, CASE WHEN technologies IS NULL THEN 'MISSING_DESIRED: technologies' END]) AS issue FROM postings) WHERE issue IS NOT NULL GROUP BY 1")
def qa_issue_counts(spark, sf):
    return O.with_qa(postings(spark, sf)).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


_FULL = "lower(title || ' ' || description || ' ' || coalesce('$' || CAST(salary_min AS VARCHAR) || '-$' || CAST(salary_max AS VARCHAR), ''))"
_RISK = f"""+r AS (SELECT job_id, {' + '.join(f"CASE WHEN contains({_FULL}, '{p}') THEN 1 ELSE 0 END" for p in K.SCAM_PHRASES)} AS scam,
 {' + '.join(f"CASE WHEN contains({_FULL}, '{p}') THEN 1 ELSE 0 END" for p in K.GHOST_PHRASES)} AS ghost,
 CASE WHEN company = '' THEN 1 ELSE 0 END + CASE WHEN salary_min > 500000 THEN 1 ELSE 0 END + CASE WHEN salary_max > 500000 THEN 1 ELSE 0 END AS other FROM postings)
SELECT job_id, CAST(scam + ghost + other AS INT) AS n_flags, CASE WHEN scam >= 1 OR ghost >= 2 OR (ghost >= 1 AND other >= 2) THEN 'high' WHEN scam + ghost + other >= 3 THEN 'medium' ELSE 'low' END AS risk FROM r"""


@query(_RISK)
def risk(spark, sf):
    p = O.with_risk(postings(spark, sf).withColumn("salary_text", salary_text()))
    return p.select("job_id", F.size("flags").alias("n_flags"), "risk")


@query("+r AS (" + _RISK.split("\nSELECT")[0].split("+r AS (", 1)[1] + ", v AS (SELECT CASE WHEN scam >= 1 OR ghost >= 2 OR (ghost >= 1 AND other >= 2) THEN 'removed' WHEN scam + ghost + other >= 3 THEN 'flagged' ELSE 'clean' END AS action FROM r) SELECT action, count(*) AS n FROM v GROUP BY 1")
def risk_counts(spark, sf):
    p = O.with_risk(postings(spark, sf).withColumn("salary_text", salary_text()))
    action = F.when(F.col("risk") == "high", "removed").when(F.col("risk") == "medium", "flagged").otherwise("clean")
    return p.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT job_id FROM postings WHERE posted_date IS NULL OR CASE WHEN lower(company) IN ('company 0', 'company 1') THEN 30 WHEN lower(company) IN ('company 2', 'company 3', 'company 4') THEN 14 ELSE 7 END * 86400 >= date_diff('second', posted_date, TIMESTAMP '2001-08-02')")
def filter_freshness(spark, sf):
    return O.filter_freshness(postings(spark, sf), F.lit("2001-08-02").cast("timestamp"), tiers={"mega": ("company 0", "company 1"), "large": ("company 2", "company 3", "company 4")}).select("job_id")


@query(f"SELECT job_id FROM postings WHERE NOT contains({_LOC}, 'bangalore') AND ({BLOCKED_SQL}) IS NULL AND {sql_any(_LOC, ('san francisco', 'united states'))}")
def filter_view(spark, sf):
    return O.filter_view(postings(spark, sf), ("san francisco", "united states"), ("bangalore",), PREFS.blocked_title_keywords).select("job_id")


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN contains({_LOC}, 'bangalore') THEN 'blocked location' WHEN ({BLOCKED_SQL}) IS NOT NULL THEN 'blocked title' WHEN NOT {sql_any(_LOC, ('san francisco', 'united states'))} THEN 'location' ELSE 'kept' END AS reason FROM postings) GROUP BY 1")
def view_drop_counts(spark, sf):
    loc = F.lower(F.col("location"))
    return O.drop_counts(postings(spark, sf), {
        "blocked location": T.any_in(loc, ("bangalore",)),
        "blocked title": T.blocked_hit(F.col("title"), PREFS.blocked_title_keywords).isNotNull(),
        "location": ~T.any_in(loc, ("san francisco", "united states")),
    })


CITIES = [("san francisco", 37.7749, -122.4194), ("london", 51.5074, -0.1278), ("bangalore", 12.9716, 77.5946), ("san", 0.0, 0.0)]


def cities(spark):
    return spark.createDataFrame(CITIES, "key string, lat double, lon double")


@query("SELECT CASE WHEN contains(location, 'San Francisco') THEN 'san francisco' WHEN contains(location, 'London') THEN 'london' WHEN contains(location, 'Bangalore') THEN 'bangalore' END AS city, count(*) AS n FROM postings GROUP BY 1")
def geo_buckets(spark, sf):
    return O.with_city(postings(spark, sf), cities(spark)).groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_id FROM postings WHERE ({WORK_MODE_SQL}) = 'remote' OR NOT (contains(location, 'London') OR contains(location, 'Bangalore'))")
def filter_radius(spark, sf):
    return O.filter_radius(postings(spark, sf), cities(spark), [(37.3, -121.9)], 100.0).select("job_id")


@query("SELECT job_id FROM postings WHERE posted_date IS NULL OR date_diff('second', posted_date, TIMESTAMP '2001-08-02') <= 90 * 86400")
def filter_recent(spark, sf):
    p = postings(spark, sf).withColumns({"last_seen_at": F.lit(None).cast("timestamp"), "first_seen_at": F.lit(None).cast("timestamp")})
    return O.filter_recent(p, 90, F.lit("2001-08-02").cast("timestamp")).select("job_id")


@query("+f AS (SELECT source, split_part(source, ':', 2) AS slug, max(posted_date) AS ts FROM postings WHERE job_id % 9 = 0 GROUP BY 1), s AS (SELECT DISTINCT source, split_part(source, ':', 2) AS slug FROM postings) SELECT s.source, s.slug FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = s.source AND f.slug = s.slug AND date_diff('second', f.ts, TIMESTAMP '2001-08-02') < 7 * 86400)")
def active_sources(spark, sf):
    p = postings(spark, sf).withColumn("slug", F.split_part("source", F.lit(":"), F.lit(2)))
    failed = p.filter("job_id % 9 = 0").groupBy("source", "slug").agg(F.max("posted_date").alias("ts"))
    return O.active_sources(p.select("source", "slug").distinct(), failed, F.lit("2001-08-02").cast("timestamp"))


@query("SELECT doc_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t\\x{a0}]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS INT) AS n FROM documents", "")
def collapsed_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.char_length(T.collapse_ws(F.col("text"))).alias("n"))


