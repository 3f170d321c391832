"""Figures for digests: skill gaps, matched postings, the latest batch, failed sources, seed labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import text as T
from postmill.operators.aggregates import counts


def skill_gap_frequency(reports: DataFrame, n: int = 15) -> DataFrame:
    """skill, n, pct of all reports and severities (a map) of the most frequent gaps.

    reports: gaps (array of skill and severity) and missing_skills (array of texts); each mention counts, and only gaps have
    a severity.
    """
    clean = lambda c: F.lower(F.trim(T.text(c)))
    gaps = reports.select(F.explode("gaps").alias("g")).select(clean(F.col("g.skill")).alias("skill"), F.lower(F.coalesce(F.nullif("g.severity", F.lit("")), F.lit("unknown"))).alias("severity"))
    missing = reports.select(F.explode("missing_skills").alias("s")).select(clean(F.col("s")).alias("skill"), F.lit(None).cast("string").alias("severity"))
    per = gaps.unionAll(missing).filter("skill <> ''").groupBy("skill", "severity").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.collect_list(F.when(F.col("severity").isNotNull(), F.struct("severity", "n")))  # a row a severity
    top = per.groupBy("skill").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(pairs)).alias("severities")).orderBy(F.desc("n"), F.asc("skill")).limit(n)
    total = F.broadcast(reports.agg(F.count(F.lit(1)).alias("reports")))  # one row
    return top.join(total).select("skill", "n", F.round(100 * F.col("n") / F.col("reports"), 1).alias("pct_of_reports"), "severities")


def top_gaps(reports: DataFrame, n: int = 5) -> DataFrame:
    """The missing skills that most reports' lists name."""
    rows = reports.select(F.explode("missing_skills").alias("s")).select(F.trim(F.lower("s")).alias("skill"))
    return counts(rows, "skill").orderBy(F.desc("n"), F.asc("skill")).limit(n)


def digest_tables(matched: DataFrame, reports: DataFrame, companies: int = 8, gaps: int = 5) -> DataFrame:
    """(part, name, n): the companies of most matches, the most frequent missing skills, and matches by source."""
    named = lambda df, part, column: df.select(F.lit(part).alias("part"), F.col(column).alias("name"), "n")
    company = counts(matched, F.coalesce("company", F.lit("Unknown")).alias("company")).orderBy(F.desc("n"), F.asc("company")).limit(companies)
    source = counts(matched, F.coalesce("source", F.lit("unknown")).alias("source"))
    return named(company, "company", "company").unionByName(named(top_gaps(reports, gaps), "gap", "skill")).unionByName(named(source, "source", "source"))


def matched_skills(matched: DataFrame, n: int = 12) -> DataFrame:
    """Skills by mentions in matched postings: their technologies, or the words of a description where they have none."""
    words = F.filter(F.regexp_extract_all(F.lower(T.text(F.col("description"))), F.lit(r"\b[a-z][a-z+\-.]{2,}\b"), F.lit(0)), lambda t: ~t.isin(*K.NON_SKILL_WORDS))
    own = F.transform(F.filter("technologies", lambda t: T.text(t) != ""), lambda t: F.lower(F.trim(t)))
    skills = F.when(F.size("technologies") > 0, own).otherwise(words)
    return counts(matched.select(F.explode(skills).alias("skill")), "skill").orderBy(F.desc("n"), F.asc("skill")).limit(n)


def matched_work_model(matched: DataFrame) -> DataFrame:
    """Matched postings by work model; any other value is unknown."""
    mode = F.lower(F.coalesce("remote", F.lit("unknown")))
    return counts(matched, F.when(mode.isin(*K.WORK_MODES), mode).otherwise("unknown").alias("work_model"))


def matched_summary(matched: DataFrame, skills: int = 12, companies: int = 10) -> DataFrame:
    """(part, name, n) of matched postings: how many there are, their skills, work models and the companies of most of them."""
    total = matched.agg(F.lit("total").alias("part"), F.lit("matched").alias("name"), F.count(F.lit(1)).alias("n"))
    name = F.coalesce(F.nullif("company", F.lit("")), F.lit("Unknown"))
    company = counts(matched, name.alias("company")).orderBy(F.desc("n"), F.asc("company")).limit(companies)
    parts = [("skill", matched_skills(matched, skills), "skill"), ("work model", matched_work_model(matched), "work_model"), ("company", company, "company")]
    for part, rows, column in parts:
        total = total.unionByName(rows.select(F.lit(part).alias("part"), F.col(column).alias("name"), "n"))
    return total


def latest_batch(history: DataFrame, n: int = 5) -> DataFrame:
    """Of the newest batch of (batch_id, company, source): the n companies of most postings, and how many came in at all."""
    newest = F.broadcast(history.agg(F.max("batch_id").alias("newest")))  # one row
    rows = history.join(newest).filter("batch_id = newest")
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total_ingested")))  # one row
    return counts(rows, "company").orderBy(F.desc("n"), F.asc("company")).limit(n).join(total)


def dead_by_source(failures: DataFrame) -> DataFrame:
    """Failed slugs of each source, each once, with the time of the last failure, as a sorted list."""
    last = failures.groupBy("source", "slug").agg(F.max("ts").alias("ts"))
    return last.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("slug", "ts"))).alias("slugs"), F.count(F.lit(1)).alias("n"))


SEED = "seed"


def seed_hash(profile_text: str, role_keywords: tuple[str, ...] = ()) -> str | None:
    """Digest of what seeds are made from; the order of keywords doesn't matter. None without a profile."""
    import hashlib

    text, words = (profile_text or "").strip(), sorted(k.strip() for k in role_keywords if k and k.strip())
    return hashlib.sha256("\x1f".join([text, *words]).encode()).hexdigest() if text else None


def wanted_labels(registry: DataFrame) -> DataFrame:
    """(key, state) of the registry rows that are labels: starred, else dismissed."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(on("starred"), "starred").when(on("dismissed"), "dismissed")
    return registry.select("key", state.alias("state")).filter("state is not null")


def refresh_labels(cache: DataFrame, registry: DataFrame, encoded: DataFrame) -> DataFrame:
    """The label cache (key, state, embedding) after a change of the registry: labels no longer wanted or of another state
    go, new ones come with the vectors of ``encoded`` (key, embedding), seeds stay."""
    wanted = wanted_labels(registry)
    seeds = cache.filter(F.col("state") == SEED)
    kept = cache.filter(F.col("state") != SEED).join(wanted, ["key", "state"], "left_semi")
    new = wanted.join(kept.select("key"), "key", "left_anti").join(encoded.select("key", "embedding"), "key")
    return seeds.unionByName(kept).unionByName(new.select("key", "state", "embedding"))


def reseed(cache: DataFrame, old_hash: str | None, new_hash: str | None, seeds: DataFrame) -> DataFrame:
    """The cache with ``seeds`` (key, embedding) in place of its own, if the profile's hash has changed; else as it is."""
    if new_hash is None or (new_hash == old_hash and not cache.filter(F.col("state") == SEED).isEmpty()):
        return cache
    new = seeds.select(F.concat(F.lit("seed:"), "key").alias("key"), F.lit(SEED).alias("state"), "embedding")
    return cache.filter(F.col("state") != SEED).unionByName(new)
