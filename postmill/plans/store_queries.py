"""Queries of what a cycle stores and reads back, of logs, the role taxonomy, preferences and model batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import profiles as U
from postmill.operators import registry as R
from postmill.operators import scoring as S
from postmill.operators import taxonomy as TX
from postmill.plans.derived import APPLICATIONS_CTE, application_events, postings, query, sql_first, table
from postmill.sources import feeds, sinks
from postmill.streaming import jobs


@query(f"SELECT job_id, coalesce(nullif({sql_first('lower(title)', K.GUESSED_SENIORITY)}, ''), 'mid') AS band FROM postings")
def guessed_seniority(spark, sf):
    return postings(spark, sf).select("job_id", X.guess_seniority(F.col("title")).alias("band"))


@query("SELECT batch_id, job_id, (job_id * 31) % 1000 / 1000e0 AS match_score FROM postings WHERE batch_id < 3 AND job_id % 2 = batch_id % 2")
def stored_matches(spark, sf):
    """Three cycles' matches as partitions of a table; the second cycle runs twice and replaces its own."""
    folder = jobs.shared_folder(spark)
    p = postings(spark, sf).withColumn("match_score", (F.col("job_id") * 31) % 1000 / 1000)
    for k, odd in ((0, 0), (1, 0), (1, 1), (2, 0)):
        sinks.write_matches(p.filter((F.col("batch_id") == k) & (F.col("job_id") % 2 == odd)), folder, k)
    return sinks.read_batches(spark, folder).select("batch_id", "job_id", "match_score")


@query("+a AS (SELECT app_id, arg_max(state, seq) AS state FROM applications GROUP BY 1) SELECT 'applications' AS part, count(*) AS n FROM a UNION ALL SELECT 'decisions', count(*) FROM applications WHERE state = 'rejected' UNION ALL SELECT 'metrics', 1 UNION ALL SELECT 'company_signals', count(DISTINCT app_id % 10) FROM a", APPLICATIONS_CTE)
def exported_tracker(spark, sf):
    """Rows of each table of a tracker's export, written and read back."""
    e, folder = application_events(spark, sf), jobs.shared_folder(spark)
    tables = sinks.export_tracker(R.latest_states(e), e.filter("state = 'rejected'"), F.lit("2024-02-05").cast("timestamp"))
    sinks.write_export(tables, folder)
    parts = [spark.read.json(f"{folder}/{name}").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name in tables]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("""+r AS (SELECT event_id, 'log' || CAST(user_id % 3 AS VARCHAR) AS file, ['DEBUG', 'INFO', 'WARNING', 'ERROR'][CAST(event_id % 4 AS INT) + 1] AS level, 'app.m' || CAST(user_id % 5 AS VARCHAR) AS logger,
 'event ' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN chr(10) || '  at step ' || CAST(event_id AS VARCHAR) || chr(10) || '  again' ELSE '' END AS message FROM events)
SELECT file, level, logger, message FROM r WHERE level IN ('WARNING', 'ERROR') ORDER BY file DESC, event_id DESC LIMIT 300""", "z AS (SELECT 1)")
def log_tail(spark, sf):
    """Log lines made from events, some records of three lines: the last 300 records of a warning or more."""
    c, e = F.col, table(spark, sf, "events")
    head = F.concat_ws(" ", F.lit("2024-01-01 10:00:00,5"), F.concat(F.lit("["), F.get(F.array(*map(F.lit, ("DEBUG", "INFO", "WARNING", "ERROR"))), (c("event_id") % 4).cast("int")), F.lit("]")), F.concat(F.lit("app.m"), (c("user_id") % 5).cast("string"), F.lit(":")), F.concat(F.lit("event "), c("event_id").cast("string")))
    more = F.when(c("event_id") % 3 == 0, F.array(F.concat(F.lit("  at step "), c("event_id").cast("string")), F.lit("  again"))).otherwise(F.array().cast("array<string>"))
    lines = e.select(F.concat(F.lit("log"), (c("user_id") % 3).cast("string")).alias("file"), "event_id", F.posexplode(F.concat(F.array(head), more)).alias("at", "value"))
    records = feeds.read_logs(lines.select("file", (c("event_id") * 3 + c("at")).alias("line_no"), "value")).withColumn("record", c("record"))
    return feeds.tail_logs(records, 300, "WARNING").select("file", "level", "logger", "message")


TAXONOMY = '{"archetypes": {"pm": {"aliases": ["Product Manager", "head of product"], "exclude": ["software engineer"]}, "eng": {"aliases": ["engineer"], "exclude": ["product"]}}}'


@query("SELECT job_id FROM postings WHERE regexp_matches(lower(title), '\\b(product manager|head of product|tpm)\\b') OR NOT regexp_matches(lower(title), '\\b(software engineer|steel)\\b')")
def filtered_roles(spark, sf):
    """Postings by a landed taxonomy, with phrases of the user's own."""
    folder = jobs.shared_folder(spark)
    spark.createDataFrame([(TAXONOMY,)], "value string").coalesce(1).write.text(folder)
    own = spark.createDataFrame([("pm", "aliases", "TPM", 0), ("pm", "aliases", " product MANAGER ", 1), ("pm", "exclude", "steel", 0)], "archetype string, kind string, phrase string, place int")
    return TX.filter_roles(postings(spark, sf), TX.merged(TX.read_taxonomy(spark, folder), own), ("pm",)).select("job_id")


@query("SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN CAST(event_id % 4 AS INT) ELSE CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(event_id % 20 AS INT) END END AS years, CASE event_id % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'staff' ELSE 'staff' END AS level FROM events", "")
def preferences_filled(spark, sf):
    """Years and level as set, else those of the profile."""
    k = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", F.when(k % 4 == 0, None).otherwise(k % 4).cast("int").alias("y"), F.when(k % 5 == 0, None).otherwise(k % 20).cast("int").alias("p_years"),
        F.when(k % 3 == 0, " senior").when(k % 3 == 1, " ").alias("level"), F.lit("staff ").alias("p_seniority"))
    rows = rows.withColumn("years", F.when(F.col("y") == 3, 0).otherwise(F.col("y"))).drop("y")
    return U.fill_preferences(rows).select("event_id", "years", "level")


def letters_of(items: list[tuple]) -> list:
    """A stand-in for a model: how many characters and how many of "e" each text has."""
    return [[float(len(t)), float(t.count("e"))] for t in items]


def shared_letters(items: list[tuple]) -> list:
    return [float(len(set(a) & set(b))) for a, b in items]


@query("+t AS (SELECT doc_id, substring(coalesce(text, ''), 1, 1500) AS s FROM documents) SELECT doc_id, CAST(length(s) AS DOUBLE) AS size, CAST(length(s) - length(replace(s, 'e', '')) AS DOUBLE) AS e FROM t", "z AS (SELECT 1)")
def encoded_texts(spark, sf):
    """A caller's model over batches of 32 texts."""
    out = S.encode(table(spark, sf, "documents").select("doc_id", "text"), letters_of)
    return out.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("size"), F.get("embedding", F.lit(1)).cast("double").alias("e"))


@query("SELECT job_id, CAST(len(list_intersect(list_distinct(string_split(lower(title), '')), ['p', 'r', 'o', 'd'])) AS DOUBLE) AS pair_score FROM postings")
def pair_scores(spark, sf):
    rows = postings(spark, sf).select("job_id", F.lit("prod").alias("profile_text"), F.lower("title").alias("text"))
    return S.score_pairs(rows, shared_letters).select("job_id", "pair_score")
