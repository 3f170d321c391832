"""Queries of salary bands, signatures, profiles, history and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import profiles as P
from postmill.functions import text as T
from postmill.functions.salary import fill_salary
from postmill.operators import aggregates as A
from postmill.operators import filters as O
from postmill.operators import registry as R
from postmill.operators import scoring as S
from postmill.plans.derived import P_CTE, postings, query, sql_any, sql_case, sql_first, sql_in, table
from postmill.plans.filter_queries import _RISK, salary_text
from postmill.plans.market_queries import HISTOGRAM_SQL, REGISTRY_CTE, banded, registry
from postmill.sources import feeds
from postmill.streaming import cycle, jobs

_PAID = r"\$(\d+)k - \$(\d+)k"


@query(f"+m AS (SELECT job_id, salary_min AS a, salary_max AS b, salary_min IS NULL AS open, 1000 * CAST(regexp_extract(description, '{_PAID}', 1) AS BIGINT) AS x, 1000 * CAST(regexp_extract(description, '{_PAID}', 2) AS BIGINT) AS y FROM postings) SELECT job_id, CASE WHEN open THEN least(x, y) ELSE a END AS salary_min, CASE WHEN open THEN greatest(x, y) ELSE b END AS salary_max, open AS salary_found FROM m")
def salary_bands(spark, sf):
    return fill_salary(postings(spark, sf)).select("job_id", "salary_min", "salary_max", "salary_found")


def _short(s: str, most: int) -> str:
    return f"CASE WHEN length({s}) > {most} THEN regexp_replace(substr({s}, 1, {most - 1}), ' [^ ]*$', '') || '…' ELSE {s} END"


@query("+b AS (SELECT *, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS body, concat_ws('; ', CASE WHEN lower(seniority) <> 'unknown' THEN seniority END, CASE WHEN remote <> 'unknown' THEN remote END, location) AS meta FROM postings), "
       f"j AS (SELECT job_id, trim(regexp_replace(concat_ws(' | ', title, CASE WHEN company <> '' THEN '@ ' || company END, '(' || meta || ')', 'Stack: ' || array_to_string(technologies, ', '), {_short('body', 420)}), '\\s+', ' ', 'g')) AS s FROM b) SELECT job_id, {_short('s', 600)} AS signature FROM j")  # fmt: skip
def signatures(spark, sf):
    return postings(spark, sf).select("job_id", T.signature().alias("signature"))


_STACK_SQL = ", ".join(rf"nullif(regexp_extract(t, '(?:^|[^\pL\pN_])({p})(?:$|[^\pL\pN_])', 1), '')" for p in K.PROFILE_STACK)
_DOMAIN_SQL = ", ".join(f"CASE WHEN {sql_any('t', words)} THEN '{label}' END" for label, words in K.PROFILE_DOMAINS.items())
_joined = lambda listed: f"array_to_string(list_sort(list_distinct(list_filter([{listed}], lambda x: x IS NOT NULL))), ',')"


@query("+d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), "
       f"f AS (SELECT doc_id, {_joined(_STACK_SQL)} AS technologies, {_joined(_DOMAIN_SQL)} AS domains, {sql_first('t', K.PROFILE_LEVELS)} AS seniority, coalesce(TRY_CAST(regexp_extract(t, '(\\d{{1,2}})\\+?\\s*(?:years|yrs)', 1) AS INT), 0) AS years_experience FROM d) "
       f"SELECT *, {sql_case('seniority', {k: '; '.join(v) for k, v in K.DEFAULT_TARGETS.items()}, chr(39) + 'Senior Product Manager' + chr(39))} AS target_roles FROM f", "e AS (SELECT 1)")  # fmt: skip
def profiles_from_documents(spark, sf):
    rows = P.profiles_from_text(table(spark, sf, "documents"), key="doc_id", body="text")
    return rows.select("doc_id", F.array_join("technologies", ",").alias("technologies"), F.array_join("domains", ",").alias("domains"), "seniority", "years_experience", F.array_join("target_roles", "; ").alias("target_roles"))


_TARGETS = ("Product Manager, Growth", "Software Architect", "Head of Steel Design")
_LANE_SQL = "list_filter(list_transform(string_split_regex(regexp_replace({0}, '" + K.LANE_BOILERPLATE + r"', ' ', 'g'), '[,/|\-–—\s]+'), lambda w: regexp_replace(w, '^[.,()]+|[.,()]+$', '', 'g')), lambda w: length(w) >= 3 AND w NOT IN " + sql_in(K.GENERIC_LANE_WORDS) + ")"
_WORDS_SQL = "list_distinct(list_concat(" + _LANE_SQL + r", list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')))"


@query(f"+r AS (SELECT r, {_WORDS_SQL.format('r')} AS own FROM (SELECT lower(unnest([{', '.join(chr(39) + t + chr(39) for t in _TARGETS)}])) AS r)), t AS (SELECT job_id, lower(title) AS t, {_WORDS_SQL.format('lower(title)')} AS have FROM postings) "
       "SELECT job_id, round(max(CASE WHEN contains(t, r) OR contains(r, t) THEN 1.0 ELSE len(list_filter(own, lambda w: contains(t, w) OR len(list_filter(have, lambda h: contains(h, w) OR contains(w, h))) > 0)) / CAST(len(own) AS DOUBLE) END), 3) AS fit FROM t, r GROUP BY job_id")  # fmt: skip
def target_role_fits(spark, sf):
    return postings(spark, sf).select("job_id", S.target_role_fit(F.col("title"), F.array(*map(F.lit, _TARGETS))).alias("fit"))


_BATCHES = "b AS (SELECT batch_id, count(*) AS ingested, count(*) FILTER (job_id % 9 = 0) AS matches, CASE WHEN batch_id % 4 = 0 THEN 0 ELSE batch_id * 10 END AS seconds FROM postings GROUP BY batch_id)"


def batches(spark, sf):
    p = postings(spark, sf)
    seconds = F.when(F.col("batch_id") % 4 == 0, 0).otherwise(F.col("batch_id") * 10)
    return p.groupBy("batch_id").agg(F.count(F.lit(1)).alias("ingested"), F.count_if(F.col("job_id") % 9 == 0).alias("matches")).withColumn("seconds", seconds)


@query("SELECT *, round(100.0 * matches / ingested, 1) AS match_pct FROM b ORDER BY batch_id DESC LIMIT 5", f"{P_CTE}, {_BATCHES}")
def batch_history(spark, sf):
    return A.match_rate(R.keep_last(batches(spark, sf), 5))


@query("SELECT round(avg(ingested), 4) AS ingested, round(avg(nullif(seconds, 0)), 4) AS seconds FROM (SELECT * FROM b ORDER BY batch_id DESC LIMIT 10)", f"{P_CTE}, {_BATCHES}")
def batch_means(spark, sf):
    return A.recent_means(batches(spark, sf), ["ingested", "seconds"], 10, ("seconds",))


@query("SELECT list_sort(list(value))[CAST(floor(count(*) / 2) AS INT) + 1] AS median, (SELECT count(*) FROM events) AS lifetime FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY event_id DESC LIMIT 500)", "")
def latency_median(spark, sf):
    return A.latest_median(table(spark, sf, "events"), "value", "event_id", 500, upper=True)


@query("SELECT median(value) AS median, (SELECT count(*) FROM events) AS lifetime FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY event_id DESC LIMIT 20)", "")
def latency_recent(spark, sf):
    return A.latest_median(table(spark, sf, "events"), "value", "event_id", 20)


@query("SELECT split_part(source, ':', 1) AS provider, count(*) AS ingested, count(*) FILTER (job_id % 3 = 0) AS matched, round(count(*) FILTER (job_id % 3 = 0) / CAST(count(*) AS DOUBLE), 4) AS rate FROM postings GROUP BY 1")
def source_effectiveness(spark, sf):
    p = postings(spark, sf)
    return A.source_effectiveness(p, p.filter("job_id % 3 = 0"))


@query(HISTOGRAM_SQL + "arg_min(low, (abs(low - 150000), low)) AS low FROM h")
def nearest_salary_bucket(spark, sf):
    return A.nearest_bucket(A.salary_histogram(banded(spark, sf)), 150_000)


@query("+c AS (SELECT event_type AS task, user_id % 3 AS model, event_id AS seq, user_id AS chars, value AS latency FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY task, model ORDER BY seq DESC) AS r FROM c) SELECT task, model, count(*) AS calls, CAST(floor(sum(chars) / 4) AS BIGINT) AS tokens, round(avg(latency) FILTER (r <= 100), 4) AS mean_latency FROM r GROUP BY ALL", "e AS (SELECT 1)")
def usage(spark, sf):
    c = F.col
    return A.usage(table(spark, sf, "events").select(c("event_type").alias("task"), (c("user_id") % 3).alias("model"), c("event_id").alias("seq"), c("user_id").alias("chars"), c("value").alias("latency")))


@query("SELECT count(*) AS n FROM old WHERE NOT removed AND (starred OR score >= 600)", REGISTRY_CTE)
def visible_matches(spark, sf):
    rows = registry(spark, sf)[0].withColumns({"tier": S.tier(F.col("score") / 1000), "is_match": F.lit(None).cast("boolean")})
    return R.visible(rows).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o.k AS key, CASE WHEN n.k IS NULL THEN o.score ELSE n.score END AS score, CASE WHEN n.k IS NULL THEN o.pv ELSE 'again' END AS profile_version FROM old o LEFT JOIN new n ON o.k = n.k", REGISTRY_CTE)
def rescored(spark, sf):
    old, new = registry(spark, sf)
    scores = new.groupBy("key").agg(F.max("score").alias("score")).withColumn("profile_version", F.lit("again"))
    return R.rescore(old, scores).select("key", "score", "profile_version")


@query("+m AS (SELECT job_id, job_id % 997 - job_id % 991 AS move FROM postings), u AS (SELECT * FROM m WHERE move > 0 ORDER BY move DESC, job_id LIMIT 10), d AS (SELECT * FROM m WHERE move < 0 ORDER BY move, job_id LIMIT 10) SELECT * FROM u UNION ALL SELECT * FROM d")
def rank_moves(spark, sf):
    p = postings(spark, sf).withColumns({"old_rank": F.col("job_id") % 997, "new_rank": F.col("job_id") % 991})
    return A.rank_moves(p, 10).select("job_id", "move")


@query("+k AS (" + _RISK.split("+r AS (", 1)[1].split("FROM r", 1)[0].join(["WITH r AS (", "FROM r"]) + ") SELECT p.batch_id, count(*) AS ingested, count(*) FILTER (company <> '' AND seniority IS NOT NULL AND technologies IS NOT NULL) AS qa_passed, count(*) FILTER (k.risk = 'high') AS blocked, count(DISTINCT lower(trim(title)) || '||' || lower(trim(company))) AS unique_jobs FROM postings p JOIN k ON p.job_id = k.job_id GROUP BY p.batch_id")
def batch_counts(spark, sf):
    p = O.with_risk(O.with_qa(postings(spark, sf).withColumn("salary_text", salary_text()))).withColumn("job_key", T.job_key(F.col("title"), F.col("company")))
    return A.batch_stats(p)


@query("+k AS (" + _RISK.split("+r AS (", 1)[1].split("FROM r", 1)[0].join(["WITH r AS (", "FROM r"]) + """), p AS (SELECT p.*, k.risk, job_id % 17 <> 0 AS parsed, lower(trim(title)) || '||' || lower(trim(company)) AS job_key FROM postings p JOIN k USING (job_id)),
f AS (SELECT job_key, min(batch_id) AS first FROM p WHERE parsed GROUP BY 1), c AS (SELECT p.*, parsed AND company <> '' AND seniority IS NOT NULL AND technologies IS NOT NULL AS passed, (job_id * 7) % 1000 >= 600 AS match, f.first = batch_id AS fresh FROM p LEFT JOIN f USING (job_key))
SELECT batch_id, count(*) AS ingested, count(*) FILTER (parsed) AS parsed, count(*) FILTER (passed) AS qa_passed, count(*) FILTER (passed AND risk = 'high') AS blocked, count(*) FILTER (passed AND risk <> 'high' AND fresh) AS new_jobs, count(*) FILTER (passed AND risk <> 'high' AND match) AS matches, count(*) FILTER (passed AND risk <> 'high' AND match AND job_id % 3 > 0) AS fit_gaps FROM c GROUP BY 1""")
def cycle_counts(spark, sf):
    """Twelve cycles, one after the other; the counters of each are observed while it stores its rows."""
    folder = jobs.shared_folder(spark)
    p = postings(spark, sf).withColumns({"salary_text": salary_text(), "title": F.when(F.col("job_id") % 17 == 0, " ").otherwise(F.col("title"))})
    p.withColumn("job_key", F.when(F.trim("title") != "", T.job_key(F.col("title"), F.col("company")))).repartition("batch_id").write.partitionBy("batch_id").parquet(f"{folder}/fetched")
    fetched = spark.read.parquet(f"{folder}/fetched")
    gaps = F.when(F.col("job_id") % 3 > 0, F.array(F.lit("rust")))
    scores = fetched.select("job_id", ((F.col("job_id") * 7) % 1000 / 1000).alias("score"), gaps.alias("gaps"), "batch_id")
    rows = []
    for k in range(12):
        seen = fetched.filter((F.col("batch_id") < k) & F.col("job_key").isNotNull()).select("job_key")
        counts = cycle.run_cycle(fetched.filter(F.col("batch_id") == k).drop("job_key"), scores.filter(F.col("batch_id") == k), seen, f"{folder}/stored", k)
        rows.append((k, *(counts[c] for c in cycle.COUNTERS)))
    return spark.createDataFrame(rows, "batch_id int, " + ", ".join(f"{c} long" for c in cycle.COUNTERS)).filter("ingested > 0")


@query("SELECT source, count(*) AS jobs, CAST(count(*) FILTER (job_id % 11 = 0) AS BIGINT) AS errors FROM postings GROUP BY source")
def source_tallies(spark, sf):
    p = postings(spark, sf)
    return feeds.source_tallies(p, p.filter("job_id % 11 = 0").select("source", F.lit("e").alias("error")))


@query()
def trimmed_pages(spark, sf):
    return feeds.trim_descriptions(table(spark, sf, "pages"))
