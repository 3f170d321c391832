"""Role taxonomy: phrases that stand for an archetype or rule it out, with a user's own added."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T

SCHEMA = "archetypes map<string, struct<aliases: array<string>, exclude: array<string>>>"


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(archetype, kind, phrase, place) of a landed JSON file: an object archetypes of names with aliases and exclude."""
    one = spark.read.schema(SCHEMA).option("multiLine", "true").json(path).select(F.explode("archetypes").alias("archetype", "a"))
    kinds = [one.select("archetype", F.lit(kind).alias("kind"), F.posexplode(f"a.{kind}").alias("place", "phrase")) for kind in ("aliases", "exclude")]
    return kinds[0].unionAll(kinds[1]).select("archetype", "kind", "phrase", "place")


def merged(taxonomy: DataFrame, extra: DataFrame) -> DataFrame:
    """Both phrase tables as one: of phrases that differ by case or outer spaces alone the first stays, the shipped before
    the user's."""
    both = taxonomy.withColumn("own", F.lit(0)).unionByName(extra.withColumn("own", F.lit(1)))
    key = F.lower(F.trim("phrase"))
    first = both.filter(key != "").groupBy("archetype", "kind", key.alias("__key")).agg(F.min(F.struct("own", "place", "phrase")).alias("f"))
    return first.select("archetype", "kind", F.col("f.phrase").alias("phrase"), (F.col("f.own") * 1_000_000 + F.col("f.place")).cast("int").alias("place"))


def phrases_of(taxonomy: DataFrame, targets: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Allowed and denied phrases of the target archetypes, which are few; unknown names give none."""
    rows = taxonomy.filter(F.col("archetype").isin(*targets)).select("kind", F.trim(F.lower("phrase")).alias("p")).filter("p <> ''").distinct().collect()
    return tuple(sorted(r["p"] for r in rows if r["kind"] == kind) for kind in ("aliases", "exclude"))


def whole_phrase(title: Column, phrases) -> Column:
    """Whether one of the phrases stands in the title as whole words."""
    if not phrases:
        return F.lit(False)
    return T.text(title).rlike(r"(?i)\b(?:" + "|".join(map(re.escape, phrases)) + r")\b")


def filter_roles(df: DataFrame, taxonomy: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """Postings whose title an allowed phrase of a target claims, or no denied one rules out; without targets all pass."""
    allow, deny = phrases_of(taxonomy, targets) if targets else ([], [])
    title = F.col("title")
    return df.filter((T.text(title) == "") | whole_phrase(title, allow) | ~whole_phrase(title, deny))
