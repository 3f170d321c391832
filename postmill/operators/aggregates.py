"""Market, quality and usage figures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import text as T


def counts(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return counts(df, column).orderBy(F.desc("n"), F.asc(column)).limit(n)


def work_model(df: DataFrame) -> DataFrame:
    """Counts by work model; the four fixed ones always appear."""
    spine = df.sparkSession.createDataFrame([(m,) for m in ("remote", "hybrid", "onsite", "unknown")], "remote string")
    return spine.join(counts(df, "remote"), "remote", "full_outer").select("remote", F.coalesce("n", F.lit(0)).alias("n"))


def salary_samples(df: DataFrame, n: int = 50) -> DataFrame:
    """The first n salary texts with a dollar sign, by arrival."""
    return df.filter(F.contains("salary_text", F.lit("$"))).orderBy("ingest_seq").limit(n).select("ingest_seq", "salary_text")


def live(df: DataFrame, *more: str) -> DataFrame:
    """Rows that are not removed, nor marked by ``more`` columns; a column that is absent marks nothing."""
    for name in ("removed", *more):
        if name in df.columns:
            df = df.filter(~F.coalesce(F.col(name), F.lit(False)))
    return df


def salary_mid() -> Column:
    """Middle of the band, or its one end."""
    return F.coalesce((F.col("salary_min") + F.col("salary_max")) / 2, F.col("salary_min").cast("double"), F.col("salary_max").cast("double"))


def salary_histogram(df: DataFrame, lo: int = 80_000, hi: int = 300_000, width: int = 20_000) -> DataFrame:
    """Live postings by middle of the band: out-of-range ones go to the edge bins, empty bins appear.

    Amounts under 1,000 are no salaries. Without any salary there are no rows.
    """
    last = (hi - lo) // width - 1
    at = F.greatest(F.lit(0), F.least(F.lit(last), F.floor((salary_mid() - lo) / width).cast("int")))
    n = counts(live(df).filter(salary_mid() >= 1000), at.alias("bin"))  # a row a bin
    spine = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    some = n.agg(F.sum("n").alias("total")).filter("total > 0")
    out = spine.join(F.broadcast(n), "bin", "left").join(F.broadcast(some))  # one row or none
    return out.select((F.col("bin") * width + lo).cast("int").alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def ghost_trend(df: DataFrame, threshold: float = 0.45, seen: str = "first_seen_at") -> DataFrame:
    """Share of suspects among live postings by the week (from Monday) in which they were first seen."""
    week = F.date_trunc("week", seen)
    rows = live(df).filter(F.col(seen).isNotNull())
    out = rows.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("ghost", F.lit(0.0)) >= threshold).alias("suspects"))
    return out.withColumn("pct", F.floor(100 * F.col("suspects") / F.col("n") + 0.5).cast("int"))


def ghost_rate(df: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Rounded share of suspects among all live postings, and their number; 0 without any."""
    n = F.count(F.lit(1))
    pct = F.floor(100 * F.count_if(F.coalesce("ghost", F.lit(0.0)) >= threshold) / F.greatest(n, F.lit(1)) + 0.5)
    return live(df).agg(pct.cast("int").alias("pct"), n.alias("n"))


def ghost_by_company(df: DataFrame, least: int = 3, threshold: float = 0.45) -> DataFrame:
    """Companies of ``least`` postings or more (no company is "Unknown"): suspects, their share and the mean score, worst first."""
    name = F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("Unknown"))
    ghost = F.coalesce("ghost", F.lit(0.0))
    out = df.groupBy(name.alias("company")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ghost >= threshold).alias("suspects"), F.round(F.avg(ghost), 3).alias("mean_ghost"))
    out = out.filter(F.col("n") >= least).withColumn("suspect_pct", F.round(100 * F.col("suspects") / F.col("n"), 1))
    return out.orderBy(F.desc("suspect_pct"), F.desc("suspects"), F.asc("company"))


def posting_age(df: DataFrame, now: Column) -> DataFrame:
    """Counts and shares by age of posting; a future date is fresh."""
    d = X.elapsed_days(now, F.col("posted_date"))
    label = F.when(d.isNull(), "unknown").when(d <= 7, "0-7").when(d <= 30, "8-30").when(d <= 60, "31-60").otherwise("61+")
    out = counts(df, label.alias("age"))
    return out.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))  # five rows


def skill_rank(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """Skills by number of live, not dismissed rows that name them, each once a row; shown, and ties ranked, as first written."""
    pairs = live(df, "dismissed").select("ingest_seq", F.posexplode(column).alias("at", "skill")).withColumn("skill", F.trim("skill"))
    pairs = pairs.withColumn("key", F.lower("skill")).filter("key <> ''")
    once = pairs.groupBy("ingest_seq", "key").agg(F.min(F.struct("ingest_seq", "at", "skill")).alias("first"))
    out = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    return out.orderBy(F.desc("n"), "first.ingest_seq", "first.at").limit(n).select("key", "n", "first.skill")


def triage_tokens(title: Column) -> Column:
    """Distinct words of over two characters that start with a letter, without the words that all titles share."""
    words = F.regexp_extract_all(T.text(title), F.lit(r"[A-Za-z][A-Za-z0-9\-\+]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: (F.char_length(w) > 2) & ~w.isin(*K.TRIAGE_STOP_WORDS)))


def learned_keywords(reactions: DataFrame, n: int = 15, least_skips: int = 3, least_uses: int = 2) -> DataFrame:
    """Title words that tell postings skipped ("down") from those kept ("up"): token, skips, keeps and add-one log odds.

    reactions: title and action, one row a posting. The odds compare shares of all words of skipped and of kept titles.
    Nothing with under ``least_skips`` skips; only words of ``least_uses`` skips and positive odds.
    """
    judged = reactions.filter(F.col("action").isin("up", "down")).select((F.col("action") == "down").alias("skipped"), triage_tokens(F.col("title")).alias("words"))
    size = lambda cond: F.greatest(F.lit(1), F.coalesce(F.sum(F.when(cond, F.size("words"))), F.lit(0)))
    totals = judged.agg(F.count_if("skipped").alias("skipped_titles"), size(F.col("skipped")).alias("all_skips"), size(~F.col("skipped")).alias("all_keeps"))
    per = judged.select("skipped", F.explode("words").alias("token")).groupBy("token").agg(F.count_if("skipped").alias("skips"), F.count_if(~F.col("skipped")).alias("keeps"))
    odds = F.log(((F.col("skips") + 1) / (F.col("all_skips") + 2)) / ((F.col("keeps") + 1) / (F.col("all_keeps") + 2)))
    out = per.join(F.broadcast(totals)).filter((F.col("skipped_titles") >= least_skips) & (F.col("skips") >= least_uses))  # totals is one row
    out = out.withColumn("odds", odds).filter("odds > 0").select("token", "skips", "keeps", F.round("odds", 3).alias("score"))
    return out.orderBy(F.desc("score"), F.desc("skips"), F.asc("token")).limit(n)


def label_separation(df: DataFrame) -> DataFrame:
    """Mean gap and AUC (ties count half) of score between positive rows and the others.

    Scores are counted first: ranks come from running sums over distinct scores in ranges of bounded size.
    """
    per = in_ranges(df.filter("score is not null").groupBy(F.col("score").alias("value")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q")))
    w = W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    inner = per.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    parts = inner.groupBy("part").agg(F.sum("q").alias("part_q"))
    before = parts.withColumn("base", F.coalesce(F.sum("part_q").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    u = inner.join(before.select("part", "base"), "part").agg(F.sum(F.col("p") * (F.col("base") + F.col("below") + F.col("q") / 2)).alias("u"))
    means = df.agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nq"), F.avg(F.when(F.col("positive"), F.col("score"))).alias("mp"), F.avg(F.when(~F.col("positive"), F.col("score"))).alias("mq"))
    return means.join(F.broadcast(u)).select(F.round(F.col("mp") - F.col("mq"), 6).alias("gap"), F.round(F.try_divide(F.col("u"), F.col("np") * F.col("nq")), 6).alias("auc"))


def engagement(events: DataFrame, now: Column, users: DataFrame | None = None) -> DataFrame:
    """Tier of each user by hours since the last and the first event: lapsed, dormant, new or active.

    Of ``users`` (user_id), those without a dated event are unknown. Times ahead of ``now`` count as now.
    """
    per = events.filter("ts is not null").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    per = per if users is None else users.select("user_id").distinct().join(per, "user_id", "left")
    hours = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)) / 3600
    idle = F.greatest(F.lit(0.0), hours("last"))
    tier = F.when(F.col("last").isNull(), "unknown").when(idle >= K.LAPSED_HOURS, "lapsed").when(idle >= K.DORMANT_HOURS, "dormant")
    return per.select("user_id", tier.when(hours("first") < K.NEW_HOURS, "new").otherwise("active").alias("tier"))


def idle_gaps(events: DataFrame, hours: int = 72, cooldown: int = 48) -> DataFrame:
    """Gaps between a user's events of over ``hours``, as alerts."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return events.withColumn("gap_s", gap).filter(F.col("gap_s") > hours * 3600).select("user_id", "event_id", "gap_s", F.floor((F.col("gap_s") - hours * 3600) / (cooldown * 3600) + 1).alias("alerts"))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value, a row for each column."""
    filled = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[filled(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.round(F.try_divide(F.col(c), F.col("n")), 4).alias("rate")) for c in columns])).alias("r")).select("r.*")


def source_health(tallies: DataFrame) -> DataFrame:
    """Jobs and errors by provider and tenant, and a row for each provider (tenant null) with its tenants and those that have jobs.

    tallies: (source, jobs, errors), a row a source. A source without a colon is a provider with one tenant of its name.
    """
    has = F.contains("source", F.lit(":"))
    part = lambda i: F.when(has, F.split_part("source", F.lit(":"), F.lit(i))).otherwise(F.col("source"))
    split = tallies.filter("source is not null").select(part(1).alias("provider"), part(2).alias("tenant"), "jobs", "errors")
    one = lambda c: F.when(F.grouping("tenant") == 1, c)
    out = split.rollup("provider", "tenant").agg(
        F.sum("jobs").alias("jobs"), F.sum("errors").alias("errors"), one(F.count_if(F.col("jobs") > 0)).alias("productive"), one(F.count(F.lit(1))).alias("tenants"),
    )
    return out.filter("provider is not null")


def velocity(history: DataFrame, now: Column) -> DataFrame:
    """This week against the last, by source and for "all" of them: sums of n over the batches of (ts, source, n), and the change in percent.

    A week is the seven days before ``now``, whose own moment is outside. From nothing to something is 100.
    """
    ago = lambda days: F.col("ts") >= now - F.make_dt_interval(F.lit(days))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    rows = history.filter((F.col("ts") < now) & ago(14))
    out = rows.rollup("source").agg(F.grouping("source").alias("__all"), total(ago(7))("this_week"), total(~ago(7))("last_week"))
    out = out.withColumn("source", F.when(F.col("__all") == 1, "all").otherwise(F.col("source"))).drop("__all")
    t, before = F.col("this_week"), F.col("last_week")
    change = F.when(before > 0, F.round(100 * (t - before) / F.nullif(before, F.lit(0)), 1)).when(t > 0, 100.0).otherwise(0.0)
    return out.withColumn("delta_pct", change)


def new_companies(df: DataFrame, back: int) -> DataFrame:
    """Companies of the newest batch that none of the ``back`` batches before it has, whatever their numbers, most postings first.

    With how many companies the newest batch has (active) and how many batches it was compared with. One batch alone has no news.
    """
    batches = df.select("batch_id").distinct().orderBy(F.desc("batch_id")).limit(back + 1)
    last = batches.agg(F.max("batch_id").alias("newest"), (F.count(F.lit(1)) - 1).alias("compared"))
    rows = df.filter("company <> ''").join(F.broadcast(batches), "batch_id", "left_semi").join(F.broadcast(last))  # at most back + 1 rows; one row
    per = rows.groupBy("company").agg(F.count_if(F.col("batch_id") == F.col("newest")).alias("n"), F.max("compared").alias("compared")).filter((F.col("n") > 0) & (F.col("compared") > 0))
    known = rows.filter("batch_id < newest").select(F.lower("company").alias("__known")).distinct()
    active = F.broadcast(per.agg(F.count(F.lit(1)).alias("active")))  # one row
    fresh = per.join(known, F.lower("company") == F.col("__known"), "left_anti")
    return fresh.join(active).select("company", "n", "active", "compared").orderBy(F.desc("n"), F.asc("company"))


def in_ranges(per: DataFrame, parts: int = 200) -> DataFrame:
    """Adds part: the range of the row's value, of ranges of about equal numbers of rows in the order of values."""
    bounds = F.percentile_approx("value", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts))
    cuts = F.broadcast(per.agg(bounds.alias("cuts")))  # one row
    return per.join(cuts).withColumn("part", F.size(F.filter("cuts", lambda b: b < F.col("value")))).drop("cuts")


def cumulative(df: DataFrame, column: str, parts: int = 200) -> DataFrame:
    """value, n (rows with it) and before (rows of lesser values), of the non-null values of a column.

    Values are counted first; ranges of about equal numbers of values get running sums of their own, to which the sums of
    the ranges before are added, so no task sorts them all.
    """
    per = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = in_ranges(per, parts)
    base = ranged.groupBy("part").agg(F.sum("n").alias("m"))  # a row a range
    base = base.select("part", F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("own", own).join(F.broadcast(base), "part").select("value", "n", (F.col("base") + F.col("own")).alias("before"))


def _at(index: Column) -> Column:
    """The value with that index, of rows of ``cumulative``."""
    return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col("value")))


def percentile_by_index(df: DataFrame, column: str, points: list[int]) -> DataFrame:
    """Values at index int(n * p / 100) - 1 (0 at least) of the sorted column, its mean and sample deviation."""
    totals = df.agg(F.count(column).alias("rows"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("sd"))
    index = lambda p: F.greatest(F.lit(0), F.expr(f"rows * {p} div 100") - 1)
    rows = cumulative(df, column).join(F.broadcast(totals))  # one row
    return rows.groupBy("mean", "sd").agg(*[F.round(_at(index(p)), 6).alias(f"p{p}") for p in points]).select(*[f"p{p}" for p in points], "mean", "sd")


def median(df: DataFrame, column: str) -> DataFrame:
    """One row: the median, the mean of two middle values."""
    rows = cumulative(df, column).join(F.broadcast(df.agg(F.count(column).alias("rows"))))  # one row
    return rows.agg(((_at(F.expr("(rows - 1) div 2")) + _at(F.expr("rows div 2"))) / 2).alias("median"))


def trimmed_latency(df: DataFrame, column: str, factor: float = 2.5) -> DataFrame:
    """Mean and maximum without values above factor times the median."""
    middle = F.broadcast(median(df, column))  # one row
    return df.join(middle).filter(F.col(column) <= factor * F.col("median")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(column), 4).alias("mean"), F.max(column).alias("worst"))


def query_words(query: str) -> list[str]:
    """Words of a query that start with a letter and have over two characters, repeats included; dots that end a word are no part of it."""
    words = (w.rstrip(".").lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9+\-.]{1,}", query))
    return [w for w in words if len(w) > 2]


def keyword_search(df: DataFrame, query: str, text: str | Column, n: int, tie: list[str], every: bool = False) -> DataFrame:
    """The n rows whose text holds the most query words, a repeated word counting as often as it is repeated.

    A query without words finds the first rows; ``every``: rows without a hit are found too, after the others.
    """
    words = query_words(query)
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    score = sum((F.contains(low, F.lit(w)).cast("int") * words.count(w) for w in dict.fromkeys(words)), F.lit(0))
    rows = df.withColumn("hits", score)
    return (rows if every or not words else rows.filter("hits > 0")).orderBy(F.desc("hits"), *tie).limit(n)


def retrieve(query: str, matches: DataFrame, gaps: DataFrame, reactions: DataFrame) -> DataFrame:
    """What a question is answered from, (collection, rank, id): 6 matches and 3 fit-gap reports with hits, and 5 reactions.

    Each has an id, which tells the order of arrival, and the fields that are searched: matches title, company, description,
    location and technologies, reports their JSON, reactions title, company and notes.
    """
    words = lambda *names: F.concat_ws(" ", *names)
    found = [
        ("matches", keyword_search(matches, query, words("title", "company", "description", "location", "technologies"), 6, ["id"])),
        ("fit_gaps", keyword_search(gaps, query, "json", 3, ["id"])),
        ("reactions", keyword_search(reactions, query, words("title", "company", "notes"), 5, ["id"], every=True)),
    ]
    place = F.row_number().over(W.partitionBy("collection").orderBy(F.desc("hits"), "id"))  # six rows at most
    rows = [f.select(F.lit(name).alias("collection"), "id", "hits") for name, f in found]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).select("collection", place.alias("rank"), "id", "hits")


def recent_means(stats: DataFrame, columns: list[str], n: int = 10, positive: tuple[str, ...] = ()) -> DataFrame:
    """Means over the n newest batches without nulls; zeros of the ``positive`` columns are left out too."""
    last = stats.orderBy(F.desc("batch_id")).limit(n)
    return last.agg(*[F.round(F.avg(F.when(F.col(c) != 0, F.col(c)) if c in positive else F.col(c)), 4).alias(c) for c in columns])


def latest_median(df: DataFrame, column: str, order: str, n: int, *, upper: bool = False) -> DataFrame:
    """Median of the n last values (``upper``: the higher of two middle ones), and how many rows there are in all."""
    last = df.filter(F.col(column).isNotNull()).orderBy(F.desc(order)).limit(n)
    middle = F.max("x").alias("median") if upper else F.percentile(column, F.lit(0.5)).alias("median")
    if upper:  # at most n rows
        values = last.agg(F.array_sort(F.collect_list(column)).alias("v"))
        got = values.select(F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("x")).agg(middle)
    else:
        got = last.agg(middle)
    return got.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("lifetime"))))  # one row each


def match_rate(df: DataFrame) -> DataFrame:
    """Per batch: percent of the ingested postings that match; null if none came in."""
    return df.withColumn("match_pct", F.when(F.col("ingested") > 0, F.round(100 * F.col("matches") / F.nullif("ingested", F.lit(0)), 1)))


def source_effectiveness(ingested: DataFrame, matched: DataFrame) -> DataFrame:
    """Postings and matches of each provider (the source up to its colon), and the share that matches."""
    provider = F.split_part("source", F.lit(":"), F.lit(1)).alias("provider")
    a, b = counts(ingested, provider).withColumnRenamed("n", "ingested"), counts(matched, provider).withColumnRenamed("n", "matched")
    both = a.join(b, "provider", "full_outer").na.fill(0, ["ingested", "matched"])
    return both.withColumn("rate", F.round(F.try_divide(F.col("matched"), F.col("ingested")), 4)).orderBy(F.desc("rate"), F.desc("ingested"), F.asc("provider"))


def nearest_bucket(histogram: DataFrame, target: float) -> DataFrame:
    """The histogram's low edge nearest the target; the lower of two."""
    return histogram.agg(F.min_by("low", F.struct(F.abs(F.col("low") - target), "low")).alias("low"))


def usage(calls: DataFrame, n: int = 100) -> DataFrame:
    """Calls, characters / 4 as tokens, and the mean of the n last latencies, by task and model.

    Each of 32 parts of a pair keeps its n last, so that a busy pair is never ranked in one task.
    """
    pair = ["task", "model"]
    totals = calls.groupBy(*pair).agg(F.count(F.lit(1)).alias("calls"), F.floor(F.sum("chars") / 4).alias("tokens"))
    part = F.pmod(F.xxhash64("seq"), F.lit(32)).alias("part")
    local = calls.select(*pair, "seq", "latency", part).withColumn("r", F.row_number().over(W.partitionBy(*pair, "part").orderBy(F.desc("seq")))).filter(F.col("r") <= n)
    last = local.withColumn("r", F.row_number().over(W.partitionBy(*pair).orderBy(F.desc("seq")))).filter(F.col("r") <= n)
    return totals.join(last.groupBy(*pair).agg(F.round(F.avg("latency"), 4).alias("mean_latency")), pair, "left")


def rank_moves(df: DataFrame, n: int) -> DataFrame:
    """The n rows that rise and the n that fall most from old_rank to new_rank; ties by ingest_seq."""
    moved = df.withColumn("move", F.col("old_rank") - F.col("new_rank")).filter("move <> 0")
    up = moved.filter("move > 0").orderBy(F.desc("move"), F.asc("ingest_seq")).limit(n)
    return up.unionByName(moved.filter("move < 0").orderBy(F.asc("move"), F.asc("ingest_seq")).limit(n))


def batch_stats(df: DataFrame) -> DataFrame:
    """Per batch: postings, those that pass the checks, those removed as a risk, and distinct titles of a company."""
    return df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("ingested"), F.count_if(F.size("issues") == 0).alias("qa_passed"),
        F.count_if(F.col("risk") == "high").alias("blocked"), F.countDistinct("job_key").alias("unique_jobs"),
    )
