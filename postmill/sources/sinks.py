"""Tables that a cycle writes: matches, histories, audits, snapshots and the tracker's export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import registry as R


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A cycle's rows as one partition of a table; a cycle that runs again replaces its own."""
    df.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All cycles of a table; a filter on batch_id reads only their partitions."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_matches(df: DataFrame, path: str, batch_id: int) -> None:
    """A cycle's matches, best first and then newest, undated last, by ranges of the order."""
    order = [F.coalesce("match_score", F.lit(0.0)).desc(), F.col("posted_date").desc_nulls_last(), F.col("ingest_seq").asc()]
    write_batch(df.orderBy(*order), path, batch_id)


def write_snapshot(df: DataFrame, folder: str, kind: str, batch_id: int) -> None:
    """Parsed postings or fit reports of a cycle, under their kind."""
    write_batch(df, f"{folder}/{kind}", batch_id)


def audit_rows(postings: DataFrame, batch_id: int) -> DataFrame:
    """What the risk rules took out or marked: (batch_id, seq, action, title, company, url, flags)."""
    action = F.when(F.col("risk") == "high", "removed").when(F.col("risk") == "medium", "flagged")
    rows = postings.select(F.lit(batch_id).alias("batch_id"), F.col("ingest_seq").alias("seq"), action.alias("action"), "title", "company", "url", "flags")
    return rows.filter("action is not null")


def last_audit(audit: DataFrame, n: int = 200) -> DataFrame:
    """The n last rows of an audit, in the order in which they came."""
    return audit.orderBy(F.desc("batch_id"), F.desc("seq")).limit(n).orderBy("batch_id", "seq")


def append_audit(audit: DataFrame, new: DataFrame, n: int = 200) -> DataFrame:
    """The audit with new rows, cut to its n last; a batch that runs again replaces its own."""
    rest = audit.join(F.broadcast(new.select("batch_id").distinct()), "batch_id", "left_anti")  # ids of one run
    return last_audit(rest.unionByName(new), n)


def export_tracker(applications: DataFrame, decisions: DataFrame, now) -> dict[str, DataFrame]:
    """The tables of a tracker's export: applications, decisions, metrics and company signals."""
    return {"applications": applications, "decisions": decisions, "metrics": R.funnel(applications, decisions), "company_signals": R.company_signals(applications, now)}


def write_export(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
