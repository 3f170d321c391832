"""Queries of the registry, joins, aggregates and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.operators import aggregates as A
from postmill.operators import listing as L
from postmill.operators import registry as R
from postmill.plans.derived import APPLICATIONS_CTE, P_CTE, application_events, postings, query, table
from postmill.plans.filter_queries import COMPLETENESS_SQL, DEDUPE_KEY_SQL, NORM_LOCATION_SQL, salary_text
from postmill.plans.score_queries import GHOST_CTES, now, with_ghost

KEYED_CTE = f"{P_CTE}, keyed AS MATERIALIZED (SELECT job_id, ingest_seq, batch_id, source, url, remote, seniority, {DEDUPE_KEY_SQL} AS k, lower(trim(title)) || '||' || lower(trim(company)) AS job_key, CAST({COMPLETENESS_SQL} AS BIGINT) AS c FROM postings)"


@query("+o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, ingest_seq) AS rn FROM keyed), s AS (SELECT k, source, min(rn) AS r FROM o GROUP BY ALL) SELECT o.k AS dedupe_key, min(o.job_id) FILTER (rn = 1) AS job_id, count(*) AS n, arg_min(seniority, rn) FILTER (seniority IS NOT NULL) AS seniority, arg_min(url, rn) FILTER (url <> '') AS url, (SELECT string_agg(source, ',' ORDER BY r) FROM s WHERE s.k = o.k) AS provenance FROM o GROUP BY o.k", KEYED_CTE)
def merge_crosslisted(spark, sf):
    out = R.merge_crosslisted(postings(spark, sf), ("seniority", "url"))
    return out.select("dedupe_key", "job_id", "n", "seniority", "url", F.array_join("provenance", ",").alias("provenance"))


@query("+g AS (SELECT k, count(*) AS n FROM keyed GROUP BY k) SELECT CAST(sum(n) AS BIGINT) AS n_input, count(*) AS n_unique, CAST(sum(n) - count(*) AS BIGINT) AS merged, round(100.0 * count(*) FILTER (n > 1) / CAST(sum(n) AS DOUBLE), 1) AS cross_listed_groups_pct, round(100.0 * CAST(sum(n) - count(*) AS DOUBLE) / count(*), 1) AS cross_listed_rows_pct FROM g", KEYED_CTE)
def merge_stats(spark, sf):
    return R.merge_stats(postings(spark, sf))


@query("+c AS (SELECT job_id, batch_id, url, job_id % 5000 AS u, source = 'amazon' AS html FROM keyed), seen AS (SELECT DISTINCT u FROM c WHERE batch_id < 3 AND url <> ''), n AS (SELECT u, min(job_id) AS job_id FROM c WHERE batch_id >= 3 AND url <> '' GROUP BY u) SELECT job_id FROM c WHERE batch_id >= 3 AND (NOT html OR url = '' OR (u NOT IN (SELECT u FROM seen) AND job_id IN (SELECT job_id FROM n)))", KEYED_CTE)
def skip_seen_urls(spark, sf):
    """Cards of one source are pages, those of the others feed entries, which always go on."""
    p = R.keyed_urls(postings(spark, sf)).withColumn("kind", F.when(F.col("source") == "amazon", "html").otherwise("json"))
    seen = p.filter("batch_id < 3 and url_key is not null").select("url_key").distinct()
    return R.skip_seen(p.filter("batch_id >= 3"), seen).select("job_id")


@query("SELECT count(DISTINCT job_id % 5000) AS n FROM postings WHERE url <> ''")
def seen_urls_after(spark, sf):
    p = R.keyed_urls(postings(spark, sf))
    seen = p.filter("batch_id < 3 and url_key is not null").select("url_key").distinct()
    return R.seen_after(p.filter("batch_id >= 3"), seen).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT is_new, count(*) AS n FROM (SELECT job_key NOT IN (SELECT job_key FROM keyed WHERE batch_id < 6) AS is_new FROM keyed WHERE batch_id >= 6) GROUP BY 1", KEYED_CTE)
def new_or_refresh(spark, sf):
    p = postings(spark, sf)
    old = p.filter("batch_id < 6").select(T.job_key(F.col("title"), F.col("company")).alias("job_key"))
    return A.counts(R.mark_new(p.filter("batch_id >= 6"), old), "is_new")


HISTOGRAM_SQL = """+b AS (SELECT job_id, CASE WHEN job_id % 4 = 1 THEN NULL WHEN job_id % 100 = 7 THEN 300 ELSE salary_max END AS hi, CASE WHEN job_id % 10 = 3 THEN NULL WHEN job_id % 100 = 7 THEN 200 ELSE salary_min END AS lo FROM postings), m AS (SELECT CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2.0 WHEN lo IS NOT NULL THEN lo ELSE hi END AS mid FROM b WHERE job_id % 19 <> 0),
 n AS (SELECT CAST(floor((greatest(80000, least(299999, mid)) - 80000) / 20000) AS INT) AS bin, count(*) AS n FROM m WHERE mid >= 1000 GROUP BY 1), h AS (SELECT CAST(s.b * 20000 + 80000 AS INT) AS low, coalesce(n.n, 0) AS n FROM (SELECT unnest(generate_series(0, 10)) AS b) s LEFT JOIN n ON n.bin = s.b WHERE EXISTS (SELECT 1 FROM n)) SELECT """


def banded(spark, sf):
    """Postings with one-sided bands, amounts that are no salaries, and removed rows."""
    junk = F.col("job_id") % 100 == 7
    return postings(spark, sf).withColumns({
        "salary_max": F.when(F.col("job_id") % 4 == 1, None).when(junk, 300).otherwise(F.col("salary_max")).cast("long"),
        "salary_min": F.when(F.col("job_id") % 10 == 3, None).when(junk, 200).otherwise(F.col("salary_min")).cast("long"),
        "removed": F.col("job_id") % 19 == 0,
    })


REGISTRY_CTE = KEYED_CTE + """, old AS (SELECT k, max((job_id * 7) % 1000) AS score, 'v' || CAST(max(batch_id) AS VARCHAR) AS pv, max(job_id) AS payload, min(batch_id) AS first_seen, max(batch_id) AS last_seen, count(DISTINCT batch_id) AS nb, bool_or(job_id % 50 = 0) AS starred, bool_or(job_id % 3 = 0) AS seen, bool_or(job_id % 41 = 0) AS dismissed, bool_or(job_id % 67 = 0) AS removed FROM keyed WHERE batch_id < 11 GROUP BY k),
new AS (SELECT k, max((job_id * 7) % 1000) AS score, max(job_id) AS payload FROM keyed WHERE batch_id = 11 GROUP BY k)"""


def registry(spark, sf):
    p = postings(spark, sf).withColumns({"key": T.dedupe_key(F.col("company"), F.col("title"), F.col("location")), "score": (F.col("job_id") * 7) % 1000, "payload": F.col("job_id")})
    old = p.filter("batch_id < 11").groupBy("key").agg(
        F.max("score").alias("score"), F.concat(F.lit("v"), F.max("batch_id").cast("string")).alias("profile_version"), F.max("payload").alias("payload"),
        F.min("batch_id").alias("first_seen"), F.max("batch_id").alias("last_seen"), F.countDistinct("batch_id").cast("int").alias("n_batches"),
        *[F.bool_or(F.col("job_id") % k == 0).alias(f) for f, k in (("starred", 50), ("seen", 3), ("dismissed", 41), ("removed", 67))],
    )
    return old, p.filter("batch_id = 11")


UPSERT_SQL = "SELECT coalesce(o.k, n.k) AS key, greatest(o.score, n.score) AS score, CASE WHEN n.k IS NOT NULL AND (o.score IS NULL OR n.score > o.score) THEN 'v11' ELSE o.pv END AS profile_version, coalesce(n.payload, o.payload) AS payload, coalesce(o.first_seen, 11) AS first_seen, CASE WHEN n.k IS NOT NULL THEN 11 ELSE o.last_seen END AS last_seen, CAST(coalesce(o.nb, 0) + CASE WHEN n.k IS NOT NULL THEN 1 ELSE 0 END AS INT) AS n_batches, coalesce(o.starred, false) AS starred, coalesce(o.seen, false) AS seen, coalesce(o.dismissed, false) AS dismissed, coalesce(o.removed, false) AS removed FROM old o FULL JOIN new n ON o.k = n.k"


@query(UPSERT_SQL, REGISTRY_CTE)
def registry_upsert(spark, sf):
    old, new = registry(spark, sf)
    return R.upsert(old, new, 11, "v11")


@query("SELECT count(*) AS total, count(*) FILTER (seen) AS seen, count(*) FILTER (NOT seen) AS unseen, count(*) FILTER (dismissed) AS dismissed, count(*) FILTER (starred) AS starred FROM old", REGISTRY_CTE)
def registry_stats(spark, sf):
    return R.registry_stats(registry(spark, sf)[0])


_TOK = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9+#.]+'), lambda t: length(t) >= 2 AND t NOT IN ('a', 'an', 'the', 'of', 'for', 'in', 'on', 'at', 'to', 'with', 'and', 'or'))))"


@query(f"+t AS MATERIALIZED (SELECT ingest_seq, batch_id, lower(company) || '|' || {NORM_LOCATION_SQL} AS b, {_TOK} AS w FROM postings), m AS (SELECT n.ingest_seq, o.ingest_seq AS key, len(list_intersect(n.w, o.w)) / CAST(len(list_distinct(list_concat(n.w, o.w))) AS DOUBLE) AS overlap FROM t n JOIN t o ON n.b = o.b WHERE n.batch_id = 11 AND o.batch_id < 11), r AS (SELECT *, row_number() OVER (PARTITION BY ingest_seq ORDER BY overlap DESC, key) AS k FROM m WHERE overlap >= 0.75) SELECT ingest_seq, key, round(overlap, 6) AS overlap FROM r WHERE k = 1")
def near_duplicate_titles(spark, sf):
    p = postings(spark, sf).withColumn("key", F.col("ingest_seq"))
    return R.near_dupes(p.filter("batch_id = 11").drop("key"), p.filter("batch_id < 11")).select("ingest_seq", "key", F.round("overlap", 6).alias("overlap"))


@query()
def near_duplicates_whole_registry(spark, sf):
    """The newest batch against all earlier ones, and its rows against one another. Without SQL: the self-join is slow."""
    p = postings(spark, sf).withColumn("key", F.col("ingest_seq"))
    found = R.collapse_new(p.filter("batch_id = 11").drop("key"), p.filter("batch_id < 11"))
    return found.select("ingest_seq", "key", F.round("overlap", 6).alias("overlap"), "in_batch")


STATES_CTE = APPLICATIONS_CTE + ", states AS (SELECT app_id, arg_max(state, seq) AS state, count(*) AS n_changes, min(ts) AS first_ts, arg_max(company, seq) AS company FROM applications GROUP BY app_id)"


def states(spark, sf):
    return R.latest_states(application_events(spark, sf))


@query("SELECT app_id, state, n_changes FROM states", STATES_CTE)
def application_states(spark, sf):
    return states(spark, sf).select("app_id", "state", "n_changes")


@query("+c AS (SELECT state, count(*) AS n FROM states GROUP BY 1), t AS (SELECT count(*) AS total, count(*) FILTER (state IN ('applied', 'interview')) AS applied, count(*) FILTER (state = 'interview') AS responded FROM states) SELECT total, applied, responded, (SELECT string_agg(state || '=' || CAST(n AS VARCHAR), ',' ORDER BY state) FROM c) AS by_state, printf('%.1f%%', round(100.0 * applied / greatest(total, 1), 1)) AS discovery_to_apply, printf('%.1f%%', round(100.0 * responded / greatest(applied, 1), 1)) AS apply_to_response, (SELECT count(*) FROM events WHERE event_type = 'error') AS total_passed FROM t", STATES_CTE)
def funnel(spark, sf):
    passed = table(spark, sf, "events").filter("event_type = 'error'")
    listed = F.transform(F.array_sort(F.map_entries("by_state")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return R.funnel(states(spark, sf), passed).withColumn("by_state", F.array_join(listed, ","))


@query("SELECT lower(company) AS company_key, round(tanh(CAST(sum(CASE state WHEN 'applied' THEN 1.0 WHEN 'interview' THEN 3.0 WHEN 'rejected' THEN -2.0 WHEN 'discovered' THEN -0.125 ELSE 0 END) AS DOUBLE) / 10) * 0.08, 4) AS bonus FROM states GROUP BY 1", STATES_CTE)
def company_signals(spark, sf):
    return R.company_signals(states(spark, sf), F.lit("2024-03-05").cast("timestamp"))


@query("+a AS (SELECT DISTINCT lower(trim(title)) AS t, lower(trim(company)) AS c FROM postings WHERE job_id % 5 = 0 AND job_id % 6 IN (1, 2, 3, 4) AND trim(company) <> '') SELECT p.job_id, a.t IS NOT NULL AS applied FROM postings p LEFT JOIN a ON lower(trim(p.title)) = a.t AND lower(trim(p.company)) = a.c")
def applied_flags(spark, sf):
    p = postings(spark, sf)
    names = F.array(*map(F.lit, ("discovered", "applied", "responded", "interview", "offer", "rejected")))
    applications = p.filter("job_id % 5 = 0").select("title", "company", F.get(names, (F.col("job_id") % 6).cast("int")).alias("state"))
    return R.with_applied(p, applications).select("job_id", "applied")


@query("+f AS (SELECT job_key, min(job_id) AS job_id FROM keyed GROUP BY job_key) SELECT job_key, job_id, 'discovered' AS state FROM f", KEYED_CTE)
def discovered(spark, sf):
    apps = application_events(spark, sf).select("title", "company").distinct()
    return R.discover(apps, postings(spark, sf)).select("job_key", "job_id", "state")


_ACTION = {"click": "star", "view": "seen", "purchase": "up", "signup": "clear"}
REACTIONS_CTE = "rx AS (SELECT event_id % 1000 AS key, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'star' WHEN 'view' THEN 'seen' WHEN 'purchase' THEN 'up' WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'down' ELSE 'dismiss' END ELSE 'clear' END AS action FROM events)"


def as_reactions(events):
    error = F.when(F.col("event_id") % 2 == 0, "down").otherwise("dismiss")
    action = F.when(F.col("event_type") == "error", error).otherwise(T.mapped(F.col("event_type"), _ACTION, F.lit("clear")))
    return events.select((F.col("event_id") % 1000).alias("key"), "ts", F.col("event_id").alias("seq"), action.alias("action"))


def reactions(spark, sf):
    return as_reactions(table(spark, sf, "events"))


def _walk(on: str, toggle: str) -> str:
    """A walk over the ordered actions: the flag at its end."""
    return f"list_reduce(list_prepend('F', a), lambda s, x: CASE x WHEN '{on}' THEN 'T' WHEN 'clear' THEN 'F' WHEN '{toggle}' THEN CASE s WHEN 'T' THEN 'F' ELSE 'T' END ELSE s END) = 'T'"


FLAGS_SQL = f"+o AS (SELECT key, list(action ORDER BY ts, seq) AS a FROM rx GROUP BY key), w AS (SELECT key, {_walk('up', 'star')} AS starred, {_walk('down', 'dismiss')} AS dismissed, len(list_filter(a, lambda x: x <> 'clear')) > 0 AS seen, CAST(len(list_filter(a, lambda x: x = 'up')) AS BIGINT) AS n_up FROM o) SELECT "


@query(FLAGS_SQL + "* FROM w", REACTIONS_CTE)
def reaction_flags(spark, sf):
    return R.fold_reactions(reactions(spark, sf))


@query("+l AS (SELECT key, arg_max(action, (ts, seq)) AS action, max(seq) FILTER (TRUE) AS any_seq, max((ts, seq)) AS at FROM rx GROUP BY key) SELECT key, action FROM l WHERE action = 'star'", REACTIONS_CTE)
def reactions_starred(spark, sf):
    return L.reactions_list(reactions(spark, sf), "star").select("key", "action")


@query("+o AS (SELECT key, list(action ORDER BY ts, seq) AS a FROM rx GROUP BY key), w AS (SELECT key, " + _walk("up", "star") + " AS starred, " + _walk("down", "dismiss") + " AS dismissed FROM o), u AS (SELECT k, first_seen, score, starred AS s0, 'u' || CAST(payload % 2000 AS VARCHAR) AS url FROM old), b AS (SELECT url, arg_max(k, (score, k)) AS k FROM u GROUP BY url) SELECT u.k AS key, CASE WHEN b.k = u.k AND w.key IS NOT NULL THEN w.starred ELSE u.s0 END AS starred FROM u JOIN b ON u.url = b.url LEFT JOIN w ON 'u' || CAST(w.key AS VARCHAR) = u.url", REGISTRY_CTE + ", " + REACTIONS_CTE)
def registry_reacted(spark, sf):
    """The flags of reactions put on the registry's best row of each url."""
    rows = registry(spark, sf)[0].withColumn("url", F.concat(F.lit("u"), (F.col("payload") % 2000).cast("string")))
    flags = R.fold_reactions(reactions(spark, sf)).withColumn("url", F.concat(F.lit("u"), F.col("key").cast("string"))).drop("key", "n_up")
    return R.react(rows, flags).select("key", "starred")


@query("SELECT action, count(*) AS n FROM rx GROUP BY 1", REACTIONS_CTE)
def reaction_counts(spark, sf):
    return A.counts(reactions(spark, sf), "action")


@query("SELECT company, count(*) AS n FROM postings GROUP BY 1 ORDER BY n DESC, company LIMIT 20")
def company_volume(spark, sf):
    return A.top(postings(spark, sf), "company", 20)


@query("SELECT split_part(source, ':', 1) AS provider, count(*) AS n FROM postings GROUP BY 1")
def source_breakdown(spark, sf):
    return A.counts(postings(spark, sf), F.split_part("source", F.lit(":"), F.lit(1)).alias("provider"))


@query("SELECT remote, count(*) AS n FROM postings GROUP BY 1")
def work_model(spark, sf):
    return A.work_model(postings(spark, sf))


@query("SELECT coalesce(seniority, 'unknown') AS seniority, count(*) AS n FROM postings GROUP BY 1")
def seniority_distribution(spark, sf):
    return A.counts(postings(spark, sf), F.coalesce("seniority", F.lit("unknown")).alias("seniority"))


@query("SELECT ingest_seq, '$' || CAST(salary_min AS VARCHAR) || '-$' || CAST(salary_max AS VARCHAR) AS salary_text FROM postings WHERE salary_min IS NOT NULL ORDER BY ingest_seq LIMIT 50")
def salary_samples(spark, sf):
    return A.salary_samples(postings(spark, sf).withColumn("salary_text", salary_text()))


@query(HISTOGRAM_SQL + "* FROM h")
def salary_histogram(spark, sf):
    return A.salary_histogram(banded(spark, sf))


_FIRST_SEEN = "TIMESTAMP '2001-06-06' + to_hours(CAST(60 * batch_id + job_id % 31 AS BIGINT))"


def with_first_seen(spark, sf):
    hours = (60 * F.col("batch_id") + F.col("job_id") % 31).cast("int")
    return with_ghost(spark, sf).withColumns({"first_seen_at": F.lit("2001-06-06").cast("timestamp") + F.make_dt_interval(F.lit(0), hours), "removed": F.col("job_id") % 19 == 0})


@query(f"+t AS (SELECT {_FIRST_SEEN} AS seen_at, ghost FROM g WHERE job_id % 19 <> 0) SELECT CAST(date_trunc('week', seen_at) AS TIMESTAMP) AS week, count(*) AS n, count(*) FILTER (ghost >= 0.45) AS suspects, CAST(floor(100.0 * count(*) FILTER (ghost >= 0.45) / count(*) + 0.5) AS INT) AS pct FROM t GROUP BY 1", GHOST_CTES)
def ghost_trend(spark, sf):
    return A.ghost_trend(with_first_seen(spark, sf))


@query("SELECT CAST(floor(100.0 * count(*) FILTER (ghost >= 0.45) / count(*) + 0.5) AS INT) AS pct, count(*) AS n FROM g WHERE job_id % 19 <> 0", GHOST_CTES)
def ghost_now(spark, sf):
    return A.ghost_rate(with_first_seen(spark, sf))


@query("SELECT CASE WHEN trim(company) = '' THEN 'Unknown' ELSE trim(company) END AS company, count(*) AS n, count(*) FILTER (ghost >= 0.45) AS suspects, round(sum(CAST(coalesce(ghost, 0) AS DOUBLE)) / count(*), 3) AS mean_ghost, round(100.0 * count(*) FILTER (ghost >= 0.45) / CAST(count(*) AS DOUBLE), 1) AS suspect_pct FROM g GROUP BY 1 HAVING count(*) >= 3", GHOST_CTES)
def ghost_by_company(spark, sf):
    return A.ghost_by_company(with_ghost(spark, sf))


@query("+d AS (SELECT date_diff('second', posted_date, TIMESTAMP '2001-08-02') // 86400 AS d FROM postings), c AS (SELECT CASE WHEN d IS NULL THEN 'unknown' WHEN d <= 7 THEN '0-7' WHEN d <= 30 THEN '8-30' WHEN d <= 60 THEN '31-60' ELSE '61+' END AS age, count(*) AS n FROM d GROUP BY 1) SELECT age, n, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 1) AS pct FROM c")
def posting_age(spark, sf):
    return A.posting_age(postings(spark, sf), now())


@query("+s AS (SELECT unnest(technologies) AS skill FROM postings WHERE job_id % 9 <> 0 AND job_id % 10 <> 0) SELECT skill AS key, count(*) AS n, skill FROM s GROUP BY skill ORDER BY n DESC, key LIMIT 8")
def skill_rank(spark, sf):
    p = postings(spark, sf).withColumns({"removed": F.col("job_id") % 9 == 0, "dismissed": F.col("job_id") % 10 == 0})
    return A.skill_rank(p, "technologies")


_TRIAGE = "list_distinct(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9+-]*'), lambda t: lower(t)), lambda t: length(t) > 2 AND t NOT IN ('" + "', '".join(K.TRIAGE_STOP_WORDS) + "')))"


@query(f"+r AS MATERIALIZED (SELECT job_id % 3 = 0 OR contains(title, 'Software') AS skipped, {_TRIAGE} AS w FROM postings WHERE job_id % 5 <> 4), t AS (SELECT count(*) FILTER (skipped) AS titles, CAST(greatest(1, sum(len(w)) FILTER (skipped)) AS DOUBLE) AS s, CAST(greatest(1, sum(len(w)) FILTER (NOT skipped)) AS DOUBLE) AS k FROM r), p AS (SELECT token, count(*) FILTER (skipped) AS skips, count(*) FILTER (NOT skipped) AS keeps FROM (SELECT skipped, unnest(w) AS token FROM r) GROUP BY token), x AS (SELECT token, skips, keeps, ln(((skips + 1) / (t.s + 2)) / ((keeps + 1) / (t.k + 2))) AS odds FROM p, t WHERE titles >= 3 AND skips >= 2) SELECT token, skips, keeps, round(odds, 3) AS score FROM x WHERE odds > 0 ORDER BY score DESC, skips DESC, token LIMIT 15")
def learned_keywords(spark, sf):
    skipped = (F.col("job_id") % 3 == 0) | F.contains("title", F.lit("Software"))
    action = F.when(F.col("job_id") % 5 == 4, "star").when(skipped, "down").otherwise("up")
    return A.learned_keywords(postings(spark, sf).select("title", action.alias("action")))


@query("SELECT round(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0), 6) AS gap, (SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END), 6) FROM x a, x b WHERE a.quality = 1 AND b.quality = 0) AS auc FROM x", "x AS MATERIALIZED (SELECT d.doc_id, d.n_chars, l.quality FROM (SELECT doc_id, n_chars FROM documents) d JOIN labels l ON d.doc_id = l.doc_id)")
def label_separation(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, sf, "labels"), "doc_id")
    return A.label_separation(d.withColumn("positive", F.col("quality") == 1))


_CLOCK_TEXT = "2024-01-30 06:00:00"
_CLOCK = f"TIMESTAMP '{_CLOCK_TEXT}'"


@query(f"+e AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id), h AS (SELECT c_custkey AS user_id, e.b IS NULL AS nothing, greatest(0, date_diff('second', b, {_CLOCK}) / 3600.0) AS idle, date_diff('second', a, {_CLOCK}) / 3600.0 AS since FROM customer LEFT JOIN e ON c_custkey = e.user_id) SELECT user_id, CASE WHEN nothing THEN 'unknown' WHEN idle >= 336 THEN 'lapsed' WHEN idle >= 48 THEN 'dormant' WHEN since < 48 THEN 'new' ELSE 'active' END AS tier FROM h", "z AS (SELECT 1)")
def engagement(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return A.engagement(table(spark, sf, "events"), F.lit(_CLOCK_TEXT).cast("timestamp"), users)


@query("+g AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap_s FROM events) SELECT user_id, event_id, gap_s, CAST(floor((gap_s - 12 * 3600) / (6 * 3600.0) + 1) AS BIGINT) AS alerts FROM g WHERE gap_s > 12 * 3600", "e AS (SELECT 1)")
def idle_alerts(spark, sf):
    return A.idle_gaps(table(spark, sf, "events"), 12, 6)


@query("SELECT unnest(['company', 'url', 'posted_date', 'seniority', 'technologies']) AS field, unnest([round(count(*) FILTER (company <> '') / CAST(count(*) AS DOUBLE), 4), round(count(*) FILTER (url <> '') / CAST(count(*) AS DOUBLE), 4), round(count(posted_date) / CAST(count(*) AS DOUBLE), 4), round(count(seniority) / CAST(count(*) AS DOUBLE), 4), round(count(technologies) / CAST(count(*) AS DOUBLE), 4)]) AS rate FROM postings")
def fill_rates(spark, sf):
    return A.fill_rates(postings(spark, sf), ["company", "url", "posted_date", "seniority", "technologies"])


@query("+t AS (SELECT source, CASE WHEN source LIKE 'lever%' AND CAST(right(source, 1) AS INT) > 6 THEN 0 ELSE count(*) END AS jobs, count(*) FILTER (job_id % 11 = 0) AS errors FROM postings GROUP BY source), s AS (SELECT CASE WHEN contains(source, ':') THEN split_part(source, ':', 1) ELSE source END AS provider, CASE WHEN contains(source, ':') THEN split_part(source, ':', 2) ELSE source END AS tenant, jobs, errors FROM t) SELECT provider, tenant, jobs, errors, CAST(NULL AS BIGINT) AS productive, CAST(NULL AS BIGINT) AS tenants FROM s UNION ALL SELECT provider, NULL, CAST(sum(jobs) AS BIGINT), CAST(sum(errors) AS BIGINT), count(*) FILTER (jobs > 0), count(*) FROM s GROUP BY provider")
def source_health(spark, sf):
    """Sources with their jobs and errors; some tenants of one provider had only errors."""
    p = postings(spark, sf)
    idle = F.col("source").startswith("lever") & (F.right("source", F.lit(1)).try_cast("int") > 6)
    tallies = p.groupBy("source").agg(F.count_if(~F.coalesce(idle, F.lit(False))).alias("jobs"), F.count_if(F.col("job_id") % 11 == 0).alias("errors"))
    return A.source_health(tallies)


@query("+h AS (SELECT split_part(source, ':', 1) AS source, TIMESTAMP '2001-08-02' - to_hours(CAST(40 * (11 - batch_id) AS BIGINT)) AS ts FROM postings), w AS (SELECT source, count(*) FILTER (ts >= TIMESTAMP '2001-07-26') AS t, count(*) FILTER (ts < TIMESTAMP '2001-07-26') AS l FROM h WHERE ts < TIMESTAMP '2001-08-02' AND ts >= TIMESTAMP '2001-07-19' GROUP BY 1 UNION ALL SELECT 'all', count(*) FILTER (ts >= TIMESTAMP '2001-07-26'), count(*) FILTER (ts < TIMESTAMP '2001-07-26') FROM h WHERE ts < TIMESTAMP '2001-08-02' AND ts >= TIMESTAMP '2001-07-19') SELECT source, t AS this_week, l AS last_week, CASE WHEN l > 0 THEN round(100.0 * (t - l) / CAST(l AS DOUBLE), 1) WHEN t > 0 THEN 100.0 ELSE 0.0 END AS delta_pct FROM w")
def hiring_velocity(spark, sf):
    at = now() - F.make_dt_interval(F.lit(0), 40 * (11 - F.col("batch_id")))
    source = F.split_part("source", F.lit(":"), F.lit(1))
    history = postings(spark, sf).groupBy("batch_id", source.alias("source")).agg(F.count(F.lit(1)).alias("n")).withColumn("ts", at)
    return A.velocity(history, now())


@query("+c AS (SELECT batch_id * batch_id AS batch_id, CASE WHEN batch_id < 11 THEN 'company ' ELSE 'Company ' END || CAST((job_id * 7919) % 3000 AS VARCHAR) AS company FROM postings), n AS (SELECT company, count(*) AS n FROM c WHERE batch_id = 121 GROUP BY 1) SELECT company, n, (SELECT count(*) FROM n) AS active, 2 AS compared FROM n WHERE lower(company) NOT IN (SELECT lower(company) FROM c WHERE batch_id IN (81, 100))")
def new_companies(spark, sf):
    """Batches with gaps between their numbers; the newest spells its companies otherwise."""
    name = F.concat(F.when(F.col("batch_id") < 11, "company ").otherwise("Company "), ((F.col("job_id") * 7919) % 3000).cast("string"))
    return A.new_companies(postings(spark, sf).withColumns({"company": name, "batch_id": F.col("batch_id") * F.col("batch_id")}), 2)


_POINTS = (10, 25, 50, 75, 90, 95)


@query("+s AS (SELECT list_sort(list(value)) AS v, avg(value) AS mean, stddev_samp(value) AS sd FROM events) SELECT " + ", ".join(f"round(v[greatest(0, least(len(v) * {p} // 100 - 1, len(v) - 1)) + 1], 6) AS p{p}" for p in _POINTS) + ", round(mean, 6) AS mean, round(sd, 6) AS sd FROM s", "z AS (SELECT 1)")
def score_report(spark, sf):
    return A.percentile_by_index(table(spark, sf, "events"), "value", list(_POINTS))


@query("+m AS (SELECT median(value) AS m FROM events) SELECT count(*) AS n, round(avg(value), 4) AS mean, max(value) AS worst FROM events, m WHERE value <= 2.5 * m", "e AS (SELECT 1)")
def trimmed_latency(spark, sf):
    return A.trimmed_latency(table(spark, sf, "events"), "value")


@query("SELECT conv_id, turn, 2 * contains(lower(text), 'the')::INT + contains(lower(text), 'queai')::INT + contains(lower(text), 'licht')::INT AS hits FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'queai') OR contains(lower(text), 'licht') ORDER BY hits DESC, conv_id, turn LIMIT 6", "")
def keyword_search(spark, sf):
    return A.keyword_search(table(spark, sf, "conversations"), "The 'queai', licht... the 7 of", "text", 6, ["conv_id", "turn"]).select("conv_id", "turn", "hits")


_HIT = lambda c: f"(contains({c}, 'staff')::INT + contains({c}, 'london')::INT + contains({c}, 'python')::INT)"


@query(f"""+m AS (SELECT job_id AS id, {_HIT("lower(title || ' ' || company || ' ' || description || ' ' || location || ' ' || coalesce(array_to_string(technologies, ' '), ''))")} AS hits FROM postings),
g AS (SELECT conv_id * 1000 + turn AS id, {_HIT("lower(coalesce(text, ''))")} AS hits FROM conversations), r AS (SELECT job_id AS id, {_HIT("lower(title || ' ' || company)")} AS hits FROM postings WHERE job_id % 7 = 0),
a AS (SELECT 'matches' AS collection, 6 AS k, * FROM m WHERE hits > 0 UNION ALL SELECT 'fit_gaps', 3, * FROM g WHERE hits > 0 UNION ALL SELECT 'reactions', 5, * FROM r)
SELECT collection, rank, id, hits FROM (SELECT *, CAST(row_number() OVER (PARTITION BY collection ORDER BY hits DESC, id) AS INTEGER) AS rank FROM a) WHERE rank <= k""")
def retrieved(spark, sf):
    p = postings(spark, sf).withColumn("id", F.col("job_id"))
    gaps = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("json"))
    return A.retrieve("Staff, London? python!", p, gaps, p.filter("job_id % 7 = 0").withColumn("notes", F.lit(None).cast("string")))


@query("""+d AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id % 6 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s - s % 86400 WHEN 3 THEN 1600000000 END AS posted_s FROM d""", "z AS (SELECT 1)")
def first_dates(spark, sf):
    """The first date that can be read: seconds, milliseconds with decimals, days, or a later field behind junk; small numbers are none."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 6
    rows = table(spark, sf, "events").select("event_id", *[
        F.when(k == 0, s.cast("string")).when(k == 1, F.lit("")).when(k == 3, F.lit("soon")).when(k == 4, F.lit("2024")).alias("posted_at"),
        F.when(k == 1, F.concat((s * 1000).cast("string"), F.lit(".25"))).when(k == 2, F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd")).alias("publishedAt"),
        F.when(k == 3, F.lit("2020-09-13T12:26:40Z")).alias("updatedAt"), F.when(k < 4, F.lit("1999-01-01")).alias("created_at"),
    ])
    return rows.select("event_id", F.unix_timestamp(X.first_date(rows)).alias("posted_s"))


@query("+r AS (SELECT url, arg_max(title, job_id) AS gaps, arg_max(company || '; ' || location, job_id) AS points FROM postings WHERE url <> '' AND job_id % 5 = 0 AND job_id % 35 <> 0 GROUP BY url) SELECT p.job_id, r.gaps, substring(r.points, 1, 1000) AS rationale FROM postings p LEFT JOIN r ON p.url = r.url")
def reports_merged(spark, sf):
    """One url in five has reports, some of which failed."""
    p = postings(spark, sf)
    error = F.when(F.col("job_id") % 35 == 0, "failed")
    reports = p.filter("url <> '' and job_id % 5 = 0").select("url", F.col("job_id").alias("seq"), error.alias("error"), F.array("title").alias("gaps"), F.array("company", "location").alias("points"))
    return R.merge_reports(p, reports).select("job_id", F.array_join("gaps", ",").alias("gaps"), "rationale")


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.vec_id IS NULL THEN 'added' WHEN b.vec_id IS NULL THEN 'dropped' WHEN a.label = b.label THEN 'kept' ELSE 'changed' END AS change FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0) a FULL JOIN (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN label + 1 ELSE label END AS label FROM embeddings WHERE vec_id % 2 = 0) b ON a.vec_id = b.vec_id) GROUP BY 1", "")
def label_sync(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label")
    old = e.filter("key % 3 = 0").select("key", F.col("label").cast("string").alias("state"))
    new = e.filter("key % 2 = 0").select("key", F.when(F.col("key") % 4 == 0, F.col("label") + 1).otherwise(F.col("label")).cast("string").alias("state"))
    return A.counts(R.sync_labels(old, new), "change")


