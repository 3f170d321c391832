"""Queries of the streaming jobs and page sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.plans.derived import APPLICATIONS_CTE, as_applications, query, table
from postmill.plans.market_queries import FLAGS_SQL, REACTIONS_CTE, REGISTRY_CTE, STATES_CTE, UPSERT_SQL, as_reactions, registry
from postmill.sources import feeds
from postmill.streaming import jobs
from postmill.streaming import state as Y


FILE_ROWS = 100_000


def event_stream(spark, sf):
    """The events table as a stream: a file source over its folder."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n FROM events GROUP BY 1", "")
def weekly_events(spark, sf):
    """The batch form of weekly_counts."""
    week = F.window("ts", "7 days", startTime="4 days")
    return table(spark, sf, "events").groupBy(week).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week"), "n")


@query("SELECT (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 7 <> 0 AND user_id % 5 <> 1) + (SELECT count(*) FROM events WHERE user_id % 7 = 0 OR user_id % 5 = 1) AS n", "z AS (SELECT 1)")
def stream_unseen_urls(spark, sf):
    """A seventh of the users have cards without a URL and a fifth have feed entries, all of which pass; three micro-batches."""
    url = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("https://x.com/"), F.col("user_id").cast("string")))
    kind = F.when(F.col("user_id") % 5 == 1, "json").otherwise("html")
    rows = event_batches(spark, sf).withColumns({"url": url, "kind": kind, "ingest_ts": F.col("ts").cast("timestamp")})
    out = jobs.run_once(jobs.unseen_urls(rows, keep="90 days").select("url_key"), jobs.shared_folder(spark))
    return out.agg(F.count(F.lit(1)).alias("n"))


def event_batches(spark, sf, n=3):
    """The events table as a stream of ``n`` micro-batches in the order of time: a folder to which each adds its files, one for
    ``FILE_ROWS`` rows, so that large batches are written and read by many tasks."""
    e, folder = table(spark, sf, "events"), jobs.shared_folder(spark)
    first, last, rows = e.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    part = F.floor((F.col("event_id") - first) * n / (last - first + 1))  # ids grow with time
    counts = dict(e.groupBy(part.alias("part")).count().collect())  # ``n`` rows
    files = max(1, min(-(-rows // (n * FILE_ROWS)), *(counts.get(k, 0) for k in range(n))))
    for k in range(n):
        own = e.filter(part == k)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(f"{folder}/events")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/events")


@query(FLAGS_SQL + "key, starred, dismissed, seen, n_up FROM w", REACTIONS_CTE)
def stream_reaction_flags(spark, sf):
    """Flags by keyed state over three micro-batches; each writes only the flags that it changed."""
    return jobs.reaction_cycles(as_reactions(event_batches(spark, sf)), jobs.shared_folder(spark), buckets=16).select("key", "starred", "dismissed", "seen", "n_up")


STEPS_CTE = APPLICATIONS_CTE + """, d AS (SELECT app_id, min(seq) AS first FROM applications WHERE state = 'discovered' GROUP BY app_id),
steps AS (SELECT a.*, lower(trim(title)) || '||' || lower(trim(company)) AS app_key, CAST(row_number() OVER (PARTITION BY a.app_id ORDER BY seq) AS INTEGER) AS step FROM applications a JOIN d ON a.app_id = d.app_id WHERE seq = first OR (seq > first AND state <> 'discovered'))"""


def steps(spark, sf):
    rows = as_applications(event_batches(spark, sf))
    return jobs.run_once(Y.application_steps(rows), jobs.shared_folder(spark))


@query("SELECT app_key, step, state, seq FROM steps", STEPS_CTE)
def stream_application_history(spark, sf):
    """What each application went through; steps before its discovery are ignored."""
    return steps(spark, sf).select("app_key", "step", "state", "seq")


@query("SELECT app_key, arg_max(state, step) AS state, count(*) AS n_changes FROM steps GROUP BY 1", STEPS_CTE)
def stream_application_states(spark, sf):
    return Y.latest_steps(steps(spark, sf)).select("app_key", "state", "n_changes")


@query("SELECT event_type AS source, CAST(user_id % 50 AS VARCHAR) AS slug FROM events WHERE event_type <> 'error' GROUP BY ALL EXCEPT SELECT b.source, b.slug FROM (SELECT 'view' AS source, CAST(user_id % 50 AS VARCHAR) AS slug, max(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY 2) b LEFT JOIN (SELECT 'view' AS source, CAST(user_id % 50 AS VARCHAR) AS slug, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 2) g ON b.slug = g.slug WHERE (g.ts IS NULL OR g.ts < b.ts) AND date_diff('second', b.ts, TIMESTAMP '2024-02-01') < 7 * 86400", "")
def stream_active_sources(spark, sf):
    """Failures and successes come as a stream; a success, or seven days, clears a failure."""
    slug = (F.col("user_id") % 50).cast("string").alias("slug")
    results = event_batches(spark, sf).filter("event_type in ('error', 'purchase')").select(F.lit("view").alias("source"), slug, "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    changes = jobs.run_once(Y.cooldown_changes(results), jobs.shared_folder(spark))
    sources = table(spark, sf, "events").filter("event_type <> 'error'").select(F.col("event_type").alias("source"), slug).distinct()
    return sources.join(Y.suppressed(changes, F.lit("2024-02-01").cast("timestamp")), ["source", "slug"], "left_anti")


@query("+w AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM events) SELECT lower(company) AS company_key, round(tanh(CAST(sum(CASE state WHEN 'applied' THEN 1.0 WHEN 'interview' THEN 3.0 WHEN 'rejected' THEN -2.0 WHEN 'discovered' THEN CASE WHEN first_ts + INTERVAL 7 DAY <= now THEN -0.125 ELSE 0 END ELSE 0 END) AS DOUBLE) / 10) * 0.08, 4) AS bonus FROM states, w GROUP BY 1", STATES_CTE)
def stream_company_signals(spark, sf):
    """Signals of companies as they change; what stays at discovered becomes a weak negative when a timer of event time fires."""
    changes = jobs.run_once(Y.signal_changes(as_applications(event_batches(spark, sf))), jobs.shared_folder(spark))
    return Y.bonuses(changes)


@query("+n AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n FROM events GROUP BY 1) SELECT week, n FROM n WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY", "z AS (SELECT 1)")
def stream_weekly_events(spark, sf):
    """Weeks that the watermark has closed."""
    rows = event_batches(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_once(jobs.weekly_counts(rows), jobs.shared_folder(spark))


@query("+l AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM events), u AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), k AS (SELECT user_id, ts, unnest(generate_series(1, 200)) AS alert FROM u) SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS last_s, CAST(alert AS INT) AS alert FROM k, w WHERE ts + INTERVAL 12 HOUR + to_hours(CAST(6 * (alert - 1) AS BIGINT)) <= now", "z AS (SELECT 1)")
def stream_idle_alerts(spark, sf):
    """Alerts of idle users by event-time timers, at the watermark that the whole table leaves."""
    rows = event_stream(spark, sf).select("user_id", "ts")
    out = jobs.run_once(jobs.idle_alerts(rows, 12, 6), jobs.shared_folder(spark))
    return out.select("user_id", F.floor(F.col("last_ms") / 1000).alias("last_s"), "alert")


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(event_id % 100) AS score, max(event_id) AS payload, 0 AS first_seen, 1 AS n_batches FROM events GROUP BY user_id", "")
def stream_registry(spark, sf):
    e = event_stream(spark, sf)
    rows = e.select(F.col("user_id").cast("string").alias("key"), (F.col("event_id") % 100).alias("score"), F.col("event_id").alias("payload"), F.col("event_id").alias("ingest_seq"))
    return jobs.registry_cycles(rows, jobs.shared_folder(spark), 16).select("key", "score", "payload", "first_seen", "n_batches")


@query(UPSERT_SQL, REGISTRY_CTE)
def registry_in_buckets(spark, sf):
    """The registry as a table of hash buckets: earlier batches as one version, the newest as the next."""
    folder = jobs.shared_folder(spark)
    old, new = registry(spark, sf)
    jobs.registry_table(spark, folder, 32).merge(old, 10, lambda _, rows: rows)
    jobs.upsert_registry(new, folder, 11, "v11", 32)
    return jobs.read_registry(spark, folder)


@query()
def page_texts(spark, sf):
    return feeds.clean_pages(table(spark, sf, "pages"))


@query()
def page_cards(spark, sf):
    """Cards of the pages; without SQL, as HTML is parsed."""
    return feeds.cards_from_html(table(spark, sf, "pages"), ("li.job", "[data-id]", "article", "li", "p"))


@query()
def page_links(spark, sf):
    return feeds.page_links(table(spark, sf, "pages"))
