"""Queries of match lists, digests, audits, labels and single functions over the posting views."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.operators import digests as D
from postmill.operators import filters as O
from postmill.operators import listing as L
from postmill.operators import registry as R
from postmill.operators import scoring as S
from postmill.plans.derived import P_CTE, postings, query, sql_any, sql_case, sql_in, table
from postmill.plans.filter_queries import _RISK, JOB_LEVEL_SQL, PREFS, salary_text
from postmill.plans.market_queries import REGISTRY_CTE, registry
from postmill.sources import sinks

_MARKS = {"removed": 19, "starred": 8, "dismissed": 10, "seen": 3}
_MARKS_SQL = ", ".join(f"job_id % {k} = 0 AS {c}" for c, k in _MARKS.items())
_TIER_SQL = "CASE job_id % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'match' WHEN 2 THEN 'maybe' WHEN 3 THEN 'none' END AS tier"
_KIND_SQL = "CASE job_id % 4 WHEN 0 THEN 'growth_pm' WHEN 1 THEN 'platform_pm' WHEN 2 THEN 'tpm' END AS archetype"
_PLACE_SQL = "CASE job_id % 7 WHEN 0 THEN 'Remote, UK' WHEN 1 THEN 'Remote (Ukraine)' WHEN 2 THEN 'Anywhere in Europe or the US' ELSE location END AS location"
_FOREIGN = "|".join(K.FOREIGN_REGIONS)
REGION_SQL = f"CASE WHEN NOT {sql_any('lower(coalesce(location, chr(32)))', K.REMOTE_SIGNS)} THEN 'onsite' WHEN regexp_matches(lower(location), '\\b({K.US_REGION})\\b') THEN 'us' WHEN regexp_matches(lower(location), '\\b({_FOREIGN})\\b') THEN 'foreign' ELSE 'anywhere' END"
MATCHES_CTE = f"{P_CTE}, m AS MATERIALIZED (SELECT job_id, ingest_seq, batch_id, title, company, source, remote, technologies, description, posted_date, (job_id * 7) % 1000 / 1000.0 AS match_score, {_MARKS_SQL}, {_TIER_SQL}, {_KIND_SQL}, {_PLACE_SQL} FROM postings)"
REASON_SQL = f"CASE WHEN removed THEN 'removed' WHEN tier IS NOT NULL AND tier <> 'match' AND NOT starred THEN 'tier' WHEN dismissed THEN 'dismissed' WHEN seen THEN 'seen' WHEN archetype IS NULL OR archetype <> 'tpm' THEN 'archetype' WHEN ({REGION_SQL}) = 'foreign' THEN 'foreign remote' ELSE 'kept' END"
SHOWN = L.MatchFilters(archetype="tpm", unseen_only=True)


def matches(spark, sf):
    """Postings with marks, tiers and archetypes, as a list of matches shows them."""
    j = F.col("job_id")
    pick = lambda n, values: F.get(F.array(*[F.lit(v) for v in values]), (j % n).cast("int"))
    place = F.coalesce(pick(7, ("Remote, UK", "Remote (Ukraine)", "Anywhere in Europe or the US", None, None, None, None)), "location")
    return postings(spark, sf).withColumns({
        **{c: j % k == 0 for c, k in _MARKS.items()}, "tier": pick(5, ("match", "match", "maybe", "none", None)),
        "archetype": pick(4, ("growth_pm", "platform_pm", "tpm", None)), "location": place, "match_score": (j * 7) % 1000 / 1000,
    })


@query(f"SELECT job_id FROM (SELECT job_id, {REASON_SQL} AS reason FROM m) WHERE reason = 'kept'", MATCHES_CTE)
def match_list(spark, sf):
    return L.filter_matches(matches(spark, sf), SHOWN).select("job_id")


@query(f"SELECT {REASON_SQL} AS reason, count(*) AS n FROM m GROUP BY 1", MATCHES_CTE)
def match_list_counts(spark, sf):
    return L.match_filter_counts(matches(spark, sf), SHOWN)


@query("SELECT job_id, row_number() OVER (ORDER BY match_score DESC, posted_date DESC NULLS LAST, ingest_seq) AS place FROM m ORDER BY place LIMIT 100", MATCHES_CTE)
def match_page(spark, sf):
    """The first page of matches, a hundred rows."""
    return L.page(L.by_score(matches(spark, sf), "posted_date", "match_score", "ingest_seq"), 100).select("job_id", "place")


@query("SELECT k AS key, row_number() OVER (ORDER BY score DESC, last_seen DESC, k) AS place FROM old ORDER BY place LIMIT 100 OFFSET 50", REGISTRY_CTE)
def registry_page(spark, sf):
    """A hundred rows after the first fifty."""
    return L.page(L.by_score(registry(spark, sf)[0], "last_seen"), 100, 50).select("key", "place")


@query("SELECT job_id, row_number() OVER (ORDER BY starred DESC, lower(company), ingest_seq) AS place FROM m ORDER BY place LIMIT 100", MATCHES_CTE)
def table_page_by_company(spark, sf):
    return L.page(L.sorted_table(matches(spark, sf), "company", ascending=True), 100).select("job_id", "place")


@query("SELECT job_id, row_number() OVER (ORDER BY starred DESC, coalesce(epoch(posted_date), 0) DESC, ingest_seq) AS place FROM m ORDER BY place LIMIT 100", MATCHES_CTE)
def table_page_by_date(spark, sf):
    return L.page(L.sorted_table(matches(spark, sf), "posted"), 100).select("job_id", "place")


@query("+o AS (SELECT job_id, row_number() OVER (ORDER BY starred DESC, CASE WHEN job_id % 8 = 0 THEN -1 ELSE (job_id * 13) % 101 / 100.0 END, ingest_seq) AS place FROM m) SELECT job_id, place FROM o ORDER BY place LIMIT 100", MATCHES_CTE)
def table_page_by_ghost(spark, sf):
    """Least suspect first; a posting without a ghost score comes before all that have one."""
    ghost = F.when(F.col("job_id") % 8 != 0, (F.col("job_id") * 13) % 101 / 100)
    return L.page(L.sorted_table(matches(spark, sf).withColumn("ghost", ghost), "ghost", ascending=True), 100).select("job_id", "place")


@query("+s AS (SELECT batch_id, count(*) AS n FROM m GROUP BY 1 ORDER BY batch_id DESC LIMIT 5), w AS (SELECT batch_id, coalesce(sum(n) OVER (ORDER BY batch_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM s) SELECT job_id, row_number() OVER (ORDER BY match_score DESC, batch_id DESC, ingest_seq) AS place FROM m WHERE batch_id IN (SELECT batch_id FROM w WHERE newer < 2000) ORDER BY place LIMIT 2000", MATCHES_CTE)
def recent_matches(spark, sf):
    """So many that they take several batches."""
    return L.page(L.recent_matches(matches(spark, sf), 2000), 2000).select("job_id", "place")


@query("SELECT 'registry' AS facet, 'total' AS value, count(*) AS n FROM m UNION ALL SELECT 'registry', 'unseen', count(*) FILTER (NOT seen) FROM m UNION ALL SELECT 'registry', 'dismissed', count(*) FILTER (dismissed) FROM m UNION ALL SELECT 'registry', 'starred', count(*) FILTER (starred) FROM m UNION ALL SELECT 'archetype', coalesce(archetype, 'uncategorised'), count(*) FROM m WHERE NOT removed GROUP BY 2", MATCHES_CTE)
def facets(spark, sf):
    return L.facet_counts(matches(spark, sf))


@query("SELECT coalesce(archetype, 'uncategorised') AS archetype, count(*) AS n FROM m WHERE NOT removed AND NOT dismissed GROUP BY 1 ORDER BY n DESC, archetype LIMIT 5", MATCHES_CTE)
def top_archetypes(spark, sf):
    return L.top_archetypes(matches(spark, sf))


@query("SELECT company, count(*) AS n, (SELECT count(*) FROM postings WHERE batch_id = 11) AS total_ingested FROM postings WHERE batch_id = 11 GROUP BY 1 ORDER BY n DESC, company LIMIT 5")
def latest_companies(spark, sf):
    return D.latest_batch(postings(spark, sf))


REPORTS_CTE = f"{P_CTE}, rep AS (SELECT job_id, company, list_filter(technologies, lambda t: t <> 'aws') AS gap_skills, CASE WHEN job_id % 2 = 0 THEN 'High' ELSE NULL END AS severity, [' SQL ', CASE WHEN job_id % 3 = 0 THEN 'Python' ELSE '' END] AS missing FROM postings WHERE job_id % 5 = 0)"


def reports(spark, sf):
    """Fit reports of one posting in five: gaps with and without a severity, and lists of missing skills."""
    severity = F.when(F.col("job_id") % 2 == 0, "High")
    gaps = F.transform(F.filter("technologies", lambda t: t != "aws"), lambda t: F.struct(t.alias("skill"), severity.alias("severity")))
    missing = F.array(F.lit(" SQL "), F.when(F.col("job_id") % 3 == 0, "Python").otherwise(""))
    return postings(spark, sf).filter("job_id % 5 = 0").select("job_id", "company", gaps.alias("gaps"), missing.alias("missing_skills"))


@query("+x AS (SELECT unnest(gap_skills) AS skill, lower(coalesce(severity, 'unknown')) AS severity FROM rep UNION ALL SELECT lower(trim(unnest(missing))), NULL FROM rep), y AS (SELECT skill, severity, count(*) AS n FROM x WHERE skill <> '' GROUP BY 1, 2) SELECT skill, CAST(sum(n) AS BIGINT) AS n, round(100.0 * CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM rep), 1) AS pct_of_reports, coalesce(string_agg(severity || '=' || CAST(n AS VARCHAR), ',' ORDER BY severity) FILTER (severity IS NOT NULL), '') AS severities FROM y GROUP BY skill ORDER BY n DESC, skill LIMIT 15", REPORTS_CTE)
def skill_gaps(spark, sf):
    listed = F.transform(F.array_sort(F.map_entries("severities")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return D.skill_gap_frequency(reports(spark, sf)).withColumn("severities", F.array_join(listed, ","))


@query("+x AS (SELECT lower(trim(unnest(missing))) AS name FROM rep) (SELECT 'company' AS part, company AS name, count(*) AS n FROM postings GROUP BY 2 ORDER BY n DESC, name LIMIT 8) UNION ALL (SELECT 'gap', name, count(*) AS n FROM x GROUP BY 2 ORDER BY n DESC, name LIMIT 5) UNION ALL SELECT 'source', source, count(*) FROM postings GROUP BY 2", REPORTS_CTE)
def digest(spark, sf):
    return D.digest_tables(postings(spark, sf), reports(spark, sf))


@query("+w AS (SELECT unnest(CASE WHEN technologies IS NOT NULL THEN technologies ELSE list_filter(regexp_extract_all(lower(description), '\\b[a-z][a-z+\\-.]{2,}\\b'), lambda t: t NOT IN " + sql_in(K.NON_SKILL_WORDS) + ") END) AS skill FROM postings) SELECT skill, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, skill LIMIT 12")
def matched_skills(spark, sf):
    """All postings are taken as matched."""
    return D.matched_skills(postings(spark, sf))


_MATCHED_SKILLS = "w AS (SELECT unnest(CASE WHEN technologies IS NOT NULL THEN technologies ELSE list_filter(regexp_extract_all(lower(description), '\\b[a-z][a-z+\\-.]{2,}\\b'), lambda t: t NOT IN " + sql_in(K.NON_SKILL_WORDS) + ") END) AS skill FROM postings WHERE job_id % 3 = 1) SELECT skill, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, skill LIMIT 12"


@query("+" + _MATCHED_SKILLS.replace(") SELECT skill, count(*) AS n FROM w", "), s AS (SELECT skill, count(*) AS n FROM w") + """), m AS (SELECT * FROM postings WHERE job_id % 3 = 1), c AS (SELECT CASE WHEN company = '' THEN 'Unknown' ELSE company END AS name, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, name LIMIT 10)
SELECT 'total' AS part, 'matched' AS name, count(*) AS n FROM m UNION ALL SELECT 'skill', skill, n FROM s UNION ALL SELECT 'company', name, n FROM c UNION ALL SELECT 'work model', CASE WHEN remote IN ('remote', 'hybrid', 'onsite') THEN remote ELSE 'unknown' END, count(*) FROM m GROUP BY 2""")
def matched_summary(spark, sf):
    return D.matched_summary(postings(spark, sf).filter("job_id % 3 = 1"))


@query("SELECT CASE WHEN remote IN ('remote', 'hybrid', 'onsite') THEN remote ELSE 'unknown' END AS work_model, count(*) AS n FROM postings GROUP BY 1")
def matched_work_model(spark, sf):
    return D.matched_work_model(postings(spark, sf))


@query("+f AS (SELECT DISTINCT split_part(source, ':', 1) AS source, 'co' || CAST(job_id % 40 AS VARCHAR) AS slug FROM postings WHERE job_id % 9 = 0) SELECT source, string_agg(slug, ',' ORDER BY slug) AS slugs, count(*) AS n FROM f GROUP BY source")
def dead_slugs(spark, sf):
    p = postings(spark, sf).filter("job_id % 9 = 0")
    failed = p.select(F.split_part("source", F.lit(":"), F.lit(1)).alias("source"), F.concat(F.lit("co"), (F.col("job_id") % 40).cast("string")).alias("slug"), F.col("posted_date").cast("timestamp").alias("ts"))
    return D.dead_by_source(failed).select("source", F.array_join(F.transform("slugs", lambda s: s["slug"]), ",").alias("slugs"), "n")


_AGE = "date_diff('second', posted_date, TIMESTAMP '1998-06-01') // 86400"


@query(f"+a AS (SELECT job_id, CASE WHEN posted_date IS NULL OR posted_date > TIMESTAMP '1998-06-02' THEN NULL ELSE greatest(0, {_AGE}) END AS d FROM postings) SELECT job_id, CASE WHEN d IS NULL THEN '—' WHEN d = 0 THEN 'today' WHEN d < 14 THEN CAST(d AS VARCHAR) || 'd' WHEN d < 60 THEN CAST(d // 7 AS VARCHAR) || 'w' WHEN d < 365 THEN CAST(d // 30 AS VARCHAR) || 'mo' ELSE CAST(d // 365 AS VARCHAR) || 'y' END AS age FROM a")
def age_labels(spark, sf):
    at = F.lit("1998-06-01").cast("timestamp")
    return postings(spark, sf).select("job_id", X.age_label(X.posted_age_days(F.col("posted_date").cast("timestamp"), at)).alias("age"))


@query("SELECT job_id, concat_ws(' | ', title || ' @ ' || company, 'score=' || CAST((job_id * 7) % 100 AS VARCHAR) || '%', location, remote, CASE WHEN salary_min IS NOT NULL THEN 'pay: $' || CAST(salary_min AS VARCHAR) || '-$' || CAST(salary_max AS VARCHAR) END, 'tech: ' || array_to_string(technologies, ', '), substring(trim(description), 1, 200)) AS summary FROM postings")
def posting_summaries(spark, sf):
    p = postings(spark, sf).withColumns({"salary_text": salary_text(), "match_score": (F.col("job_id") * 7) % 100 / 100})
    return p.select("job_id", T.posting_summary().alias("summary"))


@query("SELECT job_id, CASE job_id % 3 WHEN 0 THEN NULL WHEN 1 THEN title ELSE 'R&D <' || title END AS title, nullif(company, '') AS company, CASE WHEN job_id % 2 = 0 THEN 'Python,SQL' ELSE 'go' END AS technologies FROM postings")
def sanitised(spark, sf):
    """Entities, tags, tracking codes and repeated technologies cleaned away."""
    j = F.col("job_id")
    dirty = F.when(j % 3 == 0, F.concat(F.lit(" REQ-"), F.lpad(j.cast("string"), 8, "0"))).when(j % 3 == 1, F.concat(F.lit("<b>"), "title", F.lit("</b> "))).otherwise(F.concat(F.lit("R&amp;D &#60;"), "title"))
    techs = F.when(j % 2 == 0, F.array(F.lit("Python"), F.lit("python "), F.lit("SQL"), F.lit(""))).otherwise(F.array(F.lit("<i>go</i>"), F.lit("GO")))
    out = T.sanitise_posting(postings(spark, sf).withColumns({"title": dirty, "technologies": techs}))
    return out.select("job_id", "title", "company", F.array_join("technologies", ",").alias("technologies"))


@query("+k AS (" + _RISK.split("+r AS (", 1)[1].split("FROM r", 1)[0].join(["WITH r AS (", "FROM r"]) + "), a AS (SELECT p.job_id AS seq, p.batch_id, CASE k.risk WHEN 'high' THEN 'removed' ELSE 'flagged' END AS action FROM postings p JOIN k ON p.job_id = k.job_id WHERE k.risk IN ('high', 'medium')) SELECT batch_id, seq, action FROM a WHERE batch_id >= 10 ORDER BY batch_id DESC, seq DESC LIMIT 200")
def audit(spark, sf):
    """The last 200 rows that the rules took out or marked, over two cycles of which the later ran twice."""
    p = O.with_risk(postings(spark, sf).withColumn("salary_text", salary_text()))
    cycle = lambda b: sinks.audit_rows(p.filter(F.col("batch_id") == b), b)
    return sinks.append_audit(sinks.append_audit(cycle(10), cycle(11)), cycle(11)).select("batch_id", "seq", "action")


@query("SELECT k AS key, CASE WHEN starred THEN 'starred' ELSE 'dismissed' END AS state FROM old WHERE starred OR dismissed UNION ALL SELECT 'seed:' || CAST(vec_id AS VARCHAR), 'seed' FROM embeddings WHERE label = 3", REGISTRY_CTE)
def labels_refreshed(spark, sf):
    """A cache of stale labels after the registry's marks have changed; seeds stay."""
    old = registry(spark, sf)[0]
    e = table(spark, sf, "embeddings")
    seeds = e.filter("label = 3").select(F.concat(F.lit("seed:"), F.col("vec_id").cast("string")).alias("key"), F.lit("seed").alias("state"), "embedding")
    vector = F.array(F.lit(0.0).cast("float"))
    cache = seeds.unionByName(old.filter("score % 2 = 0").select("key", F.lit("starred").alias("state"), vector.alias("embedding")))
    return D.refresh_labels(cache, old, old.select("key", vector.alias("embedding"))).select("key", "state")


@query("SELECT job_id, job_id % 3 = 0 AS hit, CASE WHEN job_id % 3 = 0 THEN (job_id % 10) / 10e0 END AS first FROM postings")
def cache_split(spark, sf):
    """Texts with a vector of the model, and those without or with another model's."""
    p = postings(spark, sf).select("job_id", T.text_key(F.col("job_id").cast("string")).alias("text_key"))
    model = F.when(F.col("job_id") % 3 == 0, "m1").otherwise("m0")
    cache = p.filter("job_id % 3 <> 1").select("text_key", model.alias("model"), F.array(F.col("job_id") % 10 / 10).alias("embedding"))
    hits, misses = R.split_cached(p, cache, "m1")
    return hits.select("job_id", F.lit(True).alias("hit"), F.get("cached", F.lit(0)).alias("first")).unionAll(misses.select("job_id", F.lit(False), F.lit(None).cast("double")))


@query("+u AS (SELECT url, arg_max('note ' || CAST(job_id AS VARCHAR), job_id) AS note FROM postings WHERE job_id % 6 = 0 GROUP BY url) SELECT p.job_id, coalesce(u.note, p.company) AS note FROM postings p LEFT JOIN u ON p.url = u.url")
def patched(spark, sf):
    p = postings(spark, sf).withColumn("note", F.col("company"))
    updates = p.filter("job_id % 6 = 0").select("url", F.col("job_id").alias("seq"), F.concat(F.lit("note "), F.col("job_id").cast("string")).alias("note"))
    return R.patch(p, updates, "note").select("job_id", "note")


@query(f"+n AS (SELECT DISTINCT lower(p_name) AS keyword FROM part), k AS (SELECT keyword FROM n UNION ALL SELECT 'director of ' || keyword FROM n UNION ALL SELECT 'contractor manager ' || keyword FROM n UNION ALL SELECT unnest(['product manager', 'product management', 'Group Product Manager', 'coordinator', 'vp sales'])) SELECT keyword FROM k WHERE NOT {sql_any('lower(keyword)', K.SENIOR_QUERIES)} AND keyword <> 'product management'", "z AS (SELECT 1)")
def pruned_keywords(spark, sf):
    """Names of parts as query keywords, with some that name too senior roles and two that are one search."""
    names = table(spark, sf, "part").select(F.lower("p_name").alias("keyword")).distinct()
    more = [names.select(F.concat(F.lit(x), "keyword").alias("keyword")) for x in ("director of ", "contractor manager ")]
    own = spark.createDataFrame([(x,) for x in ("product manager", "product management", "Group Product Manager", "coordinator", "vp sales")], "keyword string")
    return O.prune_keywords(names.unionAll(more[0]).unionAll(more[1]).unionAll(own), PREFS)


@query("SELECT n_name, " + sql_case("lower(trim(n_name))", K.COUNTRY_ALIASES, "''") + " AS iso FROM nation", "")
def country_codes(spark, sf):
    return table(spark, sf, "nation").select("n_name", X.norm_country(F.col("n_name")).alias("iso"))


@query(f"SELECT job_id, {REGION_SQL} AS region FROM m", MATCHES_CTE)
def remote_regions(spark, sf):
    return matches(spark, sf).select("job_id", X.remote_region(F.col("location")).alias("region"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 AND day(o_orderdate) <= 12 THEN CAST(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) END AS at FROM orders", "")
def parsed_dates(spark, sf):
    """Order dates written in six ways and read again; of slashed dates that can be read both ways the day comes first."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    way = F.col("o_orderkey") % 6
    written = F.when(way == 0, F.date_format("d", "yyyy-MM-dd")).when(way == 1, F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(way == 2, F.unix_timestamp("d").cast("string")).when(way == 3, F.date_format("d", "yyyy-MM-dd HH:mm:ss")).when(way == 4, F.date_format("d", "dd/MM/yyyy")).otherwise(F.date_format("d", "MM/dd/yyyy"))
    long_enough = F.when((way == 2) & (F.unix_timestamp("d") < 100_000_000), F.date_format("d", "yyyy-MM-dd")).otherwise(written)
    return o.select("o_orderkey", X.parse_posted(long_enough).alias("at"))


_GAP = "(" + sql_case("job_level", K.LEVEL_RANK, "NULL") + f" - {K.LEVEL_RANK[PREFS.level]})"


@query(f"+j AS (SELECT job_id, {JOB_LEVEL_SQL} AS job_level FROM postings) SELECT job_id, CASE WHEN {_GAP} > 0 THEN -0.16 * {_GAP} ELSE 0.0 END AS step FROM j")
def seniority_steps(spark, sf):
    return O.with_levels(postings(spark, sf)).select("job_id", S.seniority_adjust(PREFS).alias("step"))


_FITS = "+f AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 11) / 10.0 END AS s, (event_id % 13) / 12.0 AS y, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 17) / 16.0 END AS l, (event_id % 19) / 18.0 AS d, (event_id % 23) / 22.0 AS t FROM events), x AS (SELECT event_id, coalesce(-(1 - s) * 0.22, 0) + CASE WHEN y < 1 THEN -(1 - y) * 0.18 ELSE 0 END + CASE WHEN l < 0.25 THEN -(0.25 - l) * 0.38 ELSE 0 END + CASE WHEN d < 0.2 THEN -(0.2 - d) * 0.32 WHEN d >= 0.45 THEN (d - 0.45) * 0.1 ELSE 0 END + (t - 0.4) * 0.12 AS v FROM f) SELECT event_id, round(CASE WHEN abs(greatest(-0.45, least(0.1, v))) < 0.005 THEN 0 ELSE greatest(-0.45, least(0.1, v)) END, 6) AS step FROM x"


@query(_FITS, "z AS (SELECT 1)")
def profile_steps(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(e % 7 != 0, (e % 11) / 10).alias("seniority_fit"), ((e % 13) / 12).alias("years_fit"), F.when(e % 5 != 0, (e % 17) / 16).alias("lane_fit"),
        ((e % 19) / 18).alias("domain_fit"), ((e % 23) / 22).alias("tech_fit"),
    )
    return rows.select("event_id", F.round(S.profile_adjust(), 6).alias("step"))
