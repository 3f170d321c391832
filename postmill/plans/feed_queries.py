"""Queries of the feeds: bodies as job boards give them, made from the postings by Spark, and mapped back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.plans.derived import postings, query
from postmill.sources import feeds
from postmill.streaming import jobs

_PLACE = "CASE WHEN contains(lower(location), 'remote') THEN 'remote' ELSE 'unknown' END"
_DAY = "CAST(epoch(posted_date) AS BIGINT)"
_BODY = "md5(trim(description))"
_PAY = "CASE WHEN salary_min > 0 AND salary_max > 0 THEN '$' || format('{:,}', salary_min) || '-$' || format('{:,}', salary_max) END"


def mapped(df):
    """The columns that the queries compare."""
    return df.select("title", "company", "location", "remote", "job_type", "url", F.unix_timestamp("posted_date").alias("posted_s"), "salary_text", F.md5("description").alias("body_md5"), F.concat_ws("|", "technologies").alias("skills"), "source")


def sql(company: str, remote: str, source: str, *, job_type: str = "NULL", url: str = "url", posted: str = _DAY, pay: str = "NULL", body: str = _BODY, skills: str = "''", where: str = "true", location: str = "location") -> str:
    return f"SELECT title, {company} AS company, {location} AS location, {remote} AS remote, {job_type} AS job_type, {url} AS url, {posted} AS posted_s, {pay} AS salary_text, {body} AS body_md5, {skills} AS skills, {source} AS source FROM postings WHERE {where}"


def bodies(spark, sf, one, field: str | None = "jobs", each: int = 50):
    """Bodies (slug, page, body) of about ``each`` postings: {field: [...]}, or a bare list; ``one`` is the struct of a posting."""
    p = postings(spark, sf).withColumns({"slug": F.concat(F.lit("acme-"), (F.col("job_id") % 7).cast("string")), "page": F.floor(F.col("job_id") / (7 * each)), "day": F.date_format("posted_date", "yyyy-MM-dd")})
    lists = p.groupBy("slug", "page").agg(F.collect_list(one).alias("j"))  # ``each`` postings to a body
    return lists.select("slug", "page", F.to_json(F.struct(F.col("j").alias(field)) if field else F.col("j")).alias("body"))


_SLUG = "'Acme ' || CAST(job_id % 7 AS VARCHAR)"
_FROM = lambda kind: f"'{kind}:acme-' || CAST(job_id % 7 AS VARCHAR)"


@query(sql(_SLUG, _PLACE, _FROM("greenhouse")))
def feed_greenhouse(spark, sf):
    one = F.struct("title", F.col("url").alias("absolute_url"), F.col("day").alias("updated_at"), F.concat(F.lit("<p>"), F.col("description"), F.lit("</p>")).alias("content"), F.struct(F.col("location").alias("name")).alias("location"))
    return mapped(feeds.from_greenhouse(bodies(spark, sf, one)))


@query(sql(_SLUG, _PLACE, _FROM("lever"), body="md5(description)", pay="'from $' || CAST(salary_min AS VARCHAR)"))
def feed_lever(spark, sf):
    paid = F.concat(F.lit("Benefits\nfrom $"), F.col("salary_min").cast("string"), F.lit(" \nmore $"))
    one = F.struct(F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.unix_millis(F.col("posted_date").cast("timestamp")).alias("createdAt"), F.col("description").alias("descriptionPlain"), paid.alias("additionalPlain"), F.struct("location").alias("categories"))
    return mapped(feeds.from_lever(bodies(spark, sf, one, None)))


@query(sql("company", "'remote'", "'remoteok'", pay=_PAY, skills="CASE WHEN job_id % 7 = 0 THEN 'python|kubernetes|aws' ELSE '' END"))
def feed_remoteok(spark, sf):
    """Each list has a legal note among its rows."""
    legal = F.when(F.col("job_id") < 0, "note")
    one = F.struct(legal.alias("legal"), F.col("title").alias("position"), "company", "location", "url", F.col("day").alias("date"), "description", "salary_min", "salary_max", F.col("technologies").alias("tags"))
    rows = bodies(spark, sf, one, None)
    return mapped(feeds.from_remoteok(rows.withColumn("body", F.concat(F.lit('[{"legal":"terms"},'), F.substring("body", 2, 1 << 30)))))


@query(sql(_SLUG, _PLACE, _FROM("ashby"), job_type="CASE job_id % 3 WHEN 0 THEN 'Contract' ELSE 'full-time' END", url="CASE WHEN trim(url) = '' THEN 'https://jobs.ashbyhq.com/acme-' || CAST(job_id % 7 AS VARCHAR) || '/' || CAST(job_id AS VARCHAR) ELSE url END"))
def feed_ashby(spark, sf):
    """Places are plain text in half of the postings, objects with a name in the others: a variant tells."""
    odd = F.col("job_id") % 2 == 1
    place = F.when(odd, F.to_variant_object(F.struct(F.col("location").alias("name")))).otherwise(F.parse_json(F.to_json(F.struct("location"))).cast("variant"))
    place = F.when(odd, place).otherwise(F.variant_get(place, "$.location", "variant"))
    one = F.struct(F.col("job_id").cast("string").alias("id"), "title", place.alias("location"), F.lit("Sales").alias("department"), F.when(F.col("job_id") % 5 == 0, " ").otherwise(F.col("description")).alias("descriptionHtml"), F.col("description").alias("descriptionPlain"), F.when(F.col("job_id") % 3 == 0, "Contract").alias("employmentType"), F.col("url").alias("jobUrl"), F.col("day").alias("publishedAt"))
    return mapped(feeds.from_ashby(bodies(spark, sf, one)))


@query(sql(_SLUG, _PLACE, _FROM("workday"), job_type="'full-time'", url="'https://acme-' || CAST(job_id % 7 AS VARCHAR) || '.wd1.myworkdayjobs.com/ext/job/' || CAST(job_id AS VARCHAR)", posted="CAST(NULL AS BIGINT)", body="CASE WHEN job_id % 4 <> 0 THEN md5(trim(description)) ELSE md5('') END"))
def feed_workday(spark, sf):
    """Cards, of which a quarter have no detail page."""
    one = F.struct(F.concat(F.lit(" "), F.col("title")).alias("title"), F.concat(F.lit("/job/"), F.col("job_id").cast("string")).alias("externalPath"), F.col("location").alias("locationsText"), F.lit("Posted 3 Days Ago").alias("postedOn"))
    cards = bodies(spark, sf, one, "jobPostings").select(F.col("slug").alias("tenant"), F.lit("wd1").alias("region"), F.lit("ext").alias("board"), "body")
    p = postings(spark, sf).filter("job_id % 4 <> 0")
    detail = F.to_json(F.struct(F.struct(F.col("description").alias("jobDescription")).alias("jobPostingInfo")))
    details = p.select(F.concat(F.lit("acme-"), (F.col("job_id") % 7).cast("string")).alias("tenant"), F.concat(F.lit("job/"), F.col("job_id").cast("string")).alias("path"), detail.alias("body"))
    return mapped(feeds.from_workday(cards, details)).withColumn("body_md5", F.coalesce("body_md5", F.md5(F.lit(""))))


@query("+u AS (SELECT *, row_number() OVER (PARTITION BY title, job_id % 50 ORDER BY job_id // 350, job_id) AS r FROM postings) " + sql("'Amazon'", "'unknown'", "'amazon'", job_type="'full-time'", url="'https://www.amazon.jobs/jobs/' || CAST(job_id % 50 AS VARCHAR)", skills="CASE WHEN job_id % 7 = 0 THEN 'python' ELSE '' END", where="r = 1").replace("FROM postings", "FROM u"))
def feed_amazon(spark, sf):
    """Equal titles and addresses come again on later pages; dates are written out in words."""
    p = postings(spark, sf)
    day = F.when(F.col("job_id") % 2 == 0, F.date_format("posted_date", "MMMM d, yyyy")).otherwise(F.date_format("posted_date", "yyyy-MM-dd"))
    one = F.struct("job_id", "title", F.when(F.col("job_id") % 3 == 0, "").otherwise(F.col("location")).alias("normalized_location"), "location", "description", F.when(F.col("job_id") % 7 == 0, "python").alias("basic_qualifications"), F.concat(F.lit("/jobs/"), (F.col("job_id") % 50).cast("string")).alias("job_path"), day.alias("posted_date"))
    pages = p.groupBy(F.floor(F.col("job_id") / 350).alias("page")).agg(F.array_sort(F.collect_list(one)).alias("j"))  # 350 postings to a page
    return mapped(feeds.from_amazon(pages.select("page", F.to_json(F.struct(F.col("j").alias("jobs"))).alias("body"))))


@query(sql("company", "'remote'", "'jobicy'", job_type="CASE job_id % 3 WHEN 0 THEN 'full-time, contract' WHEN 1 THEN '[draft' ELSE 'full-time' END", pay=_PAY))
def feed_jobicy(spark, sf):
    """Job types are a list, plain text (some of which looks like a list), or absent."""
    kind = F.when(F.col("job_id") % 3 == 0, F.parse_json(F.lit('["full-time", "contract"]'))).when(F.col("job_id") % 3 == 1, F.parse_json(F.lit('"[draft"')))
    one = F.struct(F.col("title").alias("jobTitle"), F.col("company").alias("companyName"), F.col("location").alias("jobGeo"), F.col("salary_min").cast("string").alias("annualSalaryMin"), F.col("salary_max").cast("string").alias("annualSalaryMax"), F.col("description").alias("jobDescription"), kind.alias("jobType"), "url", F.col("day").alias("pubDate"))
    return mapped(feeds.from_jobicy(bodies(spark, sf, one)))


@query(sql("company", "'remote'", "'remotive'", job_type="CASE job_id % 3 WHEN 0 THEN 'contract' ELSE 'full-time' END", pay="'$' || CAST(salary_min AS VARCHAR)", body="md5(substring(trim(description), 1, 500))", skills="CASE WHEN job_id % 7 = 0 THEN 'python|kubernetes|aws' ELSE '' END"))
def feed_remotive(spark, sf):
    one = F.struct("title", F.col("company").alias("company_name"), F.col("location").alias("candidate_required_location"), F.concat(F.lit(" $"), F.col("salary_min").cast("string")).alias("salary"), "description", F.col("technologies").alias("tags"), F.when(F.col("job_id") % 3 == 0, "contract").alias("job_type"), "url", F.concat(F.col("day"), F.lit("T10:00:00")).alias("publication_date"))
    return mapped(feeds.from_remotive(bodies(spark, sf, one)))


@query("+b AS (SELECT DISTINCT job_id % 7 AS slug, job_id // 350 AS page FROM postings) SELECT 'posting' AS kind, count(*) AS n FROM postings WHERE job_id % 7 <> 3 UNION ALL SELECT 'dead letter', count(*) FROM b WHERE slug = 3")
def stream_feeds(spark, sf):
    """Bodies as a stream of text files; those of one board are cut off and land among the dead letters."""
    one = F.struct("title", F.col("url").alias("absolute_url"), F.col("day").alias("updated_at"), F.col("description").alias("content"), F.struct(F.col("location").alias("name")).alias("location"))
    cut = F.when(F.col("slug") == "acme-3", F.expr("substring(body, 1, length(body) - 5)")).otherwise(F.col("body"))
    folder = jobs.shared_folder(spark)
    bodies(spark, sf, one).select("slug", F.to_json(F.struct("slug", cut.alias("body"))).alias("value")).repartition(4, "slug").select("value").write.text(f"{folder}/landed")
    good, bad = jobs.feed_cycles(spark, f"{folder}/landed", folder, feeds.from_greenhouse)
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("posting").alias("kind"), "n").unionAll(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead letter"), "n"))
