"""Posting-shaped views over the given tables, as SQL that Spark and the oracle both run, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2001-08-02"

POSTINGS = """SELECT o.o_orderkey AS job_id, o.o_orderkey AS ingest_seq, CAST(o.o_orderkey % 12 AS INT) AS batch_id,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Senior Product Manager, ' WHEN '2-HIGH' THEN 'Staff Product Manager, '
       WHEN '3-MEDIUM' THEN 'Product Manager, ' WHEN '4-NOT SPECIFIED' THEN 'Director of Product, '
       ELSE 'Software Engineer, ' END || p.p_name AS title,
  CASE WHEN o.o_orderkey % 97 = 0 THEN '' ELSE 'Company ' || CAST(o.o_custkey % 10 AS STRING) END AS company,
  CASE CAST(c.c_nationkey % 6 AS INT) WHEN 0 THEN 'Remote - US' WHEN 1 THEN 'San Francisco, CA' WHEN 2 THEN 'London, UK'
       WHEN 3 THEN 'United States' WHEN 4 THEN 'Bangalore, India' ELSE 'Worldwide' END AS location,
  CASE CAST(o.o_orderkey % 4 AS INT) WHEN 0 THEN 'greenhouse:co' WHEN 1 THEN 'lever:co' WHEN 2 THEN 'ashby:co' ELSE 'amazon' END
   || CASE WHEN o.o_orderkey % 4 < 3 THEN CAST(o.o_custkey % 10 AS STRING) ELSE '' END AS source,
  CASE CAST(o.o_orderkey % 5 AS INT) WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS remote,
  CASE CAST(o.o_orderkey % 7 AS INT) WHEN 0 THEN 'senior' WHEN 1 THEN 'Associate' WHEN 2 THEN 'staff' WHEN 3 THEN 'unknown' END AS seniority,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderdate END AS posted_date,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST(80000 + (o.o_orderkey % 40) * 5000 AS BIGINT) END AS salary_min,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL
       ELSE CAST((80000 + (o.o_orderkey % 40) * 5000) * (1 + o.o_custkey % 7) AS BIGINT) END AS salary_max,
  'You will need ' || CAST(o.o_orderkey % 16 AS STRING) || '+ years of product experience. Salary $'
   || CAST(80 + o.o_orderkey % 40 AS STRING) || 'k - $' || CAST(100 + o.o_orderkey % 60 AS STRING) || 'k. '
   || CASE WHEN o.o_orderkey % 5 = 0 THEN 'rockstar ninja fast-paced synergy ' ELSE '' END
   || CASE WHEN o.o_orderkey % 7 = 0 THEN 'python kubernetes aws ' ELSE '' END
   || CASE WHEN o.o_orderkey % 101 = 0 THEN 'wire transfer ' WHEN o.o_orderkey % 53 = 0 THEN 'talent pool evergreen ' ELSE '' END
   || repeat('roadmap delivery scope ', CAST(o.o_orderkey % 40 AS INT)) AS description,
  CASE WHEN o.o_orderkey % 13 = 0 THEN ''
       ELSE 'https://Jobs.Example.com:443/p/' || CAST(o.o_orderkey % 5000 AS STRING) || '/?utm_source=x&b=2&a=1#apply' END AS url,
  CAST(o.o_orderkey % (SELECT COUNT(*) FROM {embeddings}) AS BIGINT) AS vec_id
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {part} p ON p.p_partkey = o.o_orderkey % (SELECT COUNT(*) FROM {part})"""

_NAMES = ("orders", "customer", "part", "embeddings")
_PLAIN = POSTINGS.format(**{n: n for n in _NAMES})

#: CTE text for oracles: the postings with technologies.
P_CTE = f"postings AS MATERIALIZED (SELECT *, CASE WHEN job_id % 7 = 0 THEN ['python', 'kubernetes', 'aws'] END AS technologies FROM ({_PLAIN}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all tasks while they are narrow, as a table of one file may be one split: to four for each core, or as many
    as the session sets by ``postmill.spread``."""
    spark = df.sparkSession
    return df.repartition(int(spark.conf.get("postmill.spread", "0")) or 4 * spark.sparkContext.defaultParallelism)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {n: table(spark, sf_dir, n) for n in _NAMES}
    rows = spark.sql(POSTINGS, **(given | {"orders": spread(given["orders"])}))
    return rows.withColumn("technologies", F.when(F.col("job_id") % 7 == 0, F.array(F.lit("python"), F.lit("kubernetes"), F.lit("aws"))))


APPLICATIONS_CTE = """applications AS (SELECT user_id AS app_id, 'Company ' || CAST(user_id % 10 AS VARCHAR) AS company, 'Role ' || CAST(user_id AS VARCHAR) AS title, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'view' THEN 'evaluated' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'interview' ELSE 'rejected' END AS state FROM events)"""


def application_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_applications(table(spark, sf_dir, "events"))


def as_applications(e: DataFrame) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "discovered").when(F.col("event_type") == "view", "evaluated").when(F.col("event_type") == "click", "applied").when(F.col("event_type") == "purchase", "interview").otherwise("rejected")
    user = F.col("user_id")
    return e.select(user.alias("app_id"), F.concat(F.lit("Company "), (user % 10).cast("string")).alias("company"), F.concat(F.lit("Role "), user.cast("string")).alias("title"), F.col("event_id").alias("seq"), "ts", state.alias("state"))


def query(sql: str | None = None, ctes: str = P_CTE):
    """Register a query with its SQL; ``sql`` is put after the common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {ctes}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}" if ctes else sql
        return f

    return add


def sql_any(column: str, words) -> str:
    quoted = (w.replace("'", "''") for w in words)
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in quoted) + ")"


def sql_in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_case(column: str, table_: dict, default: str) -> str:
    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table_.items()) + f" ELSE {default} END"


def sql_first(column: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{t}') THEN '{v}'" for t, v in pairs) + " ELSE '' END"
