"""The registry of matches, cross-listed merges, applications and reactions: joins and keyed state in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.operators.shared import spread_absent

FLAGS = ("seen", "dismissed", "starred", "removed")


def merge_crosslisted(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row a dedupe key: the most complete posting, its blanks filled from the others in order of completeness,
    and provenance, the distinct sources in that order.

    All is aggregation with partial results: for each column the best non-blank value by (completeness, arrival),
    for provenance the best rank of each source. No group of postings is sorted in one task.
    """
    key = T.dedupe_key(F.col("company"), F.col("title"), F.col("location"))
    ranked = df.withColumns({"dedupe_key": key, "__rank": F.struct((-T.completeness()).alias("c"), F.col("ingest_seq").alias("s"))})
    best = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("__rank"))).alias(c) for c in columns]
    rows = ranked.groupBy("dedupe_key").agg(*best, F.min_by("job_id", "__rank").alias("job_id"), F.count(F.lit(1)).alias("n"))
    sources = ranked.filter(F.col("source") != "").groupBy("dedupe_key", "source").agg(F.min("__rank").alias("__rank"))
    order = sources.groupBy("dedupe_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "source"))), lambda s: s["source"]).alias("provenance"))
    return rows.join(order, "dedupe_key", "left")


def merge_stats(df: DataFrame) -> DataFrame:
    """Counts of input, unique keys and folded rows, and the two shares of cross-listing."""
    key = T.dedupe_key(F.col("company"), F.col("title"), F.col("location"))
    n = df.groupBy(key.alias("k")).count()
    out = n.agg(F.sum("count").alias("n_input"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("count") > 1).alias("groups"))
    return out.select(
        "n_input", "n_unique", (F.col("n_input") - F.col("n_unique")).alias("merged"),
        F.round(100 * F.try_divide("groups", "n_input"), 1).alias("cross_listed_groups_pct"),
        F.round(100 * F.try_divide(F.col("n_input") - F.col("n_unique"), "n_unique"), 1).alias("cross_listed_rows_pct"),
    )


def keyed_urls(cards: DataFrame) -> DataFrame:
    """Adds url_key, the normalised URL; null where there is none."""
    return cards.withColumn("url_key", F.nullif(T.norm_url(F.col("url")), F.lit("")))


def skip_seen(cards: DataFrame, seen: DataFrame) -> DataFrame:
    """Cards to go on with: pages (kind "html", or no column kind) whose URL is not in seen and the first with it in this
    batch; cards without URL, and all of other kinds, pass. A URL counts as seen after a card of any kind.

    Needs ingest_seq and url, and url_key if ``keyed_urls`` was called; seen has url_key.
    """
    keyed = cards if "url_key" in cards.columns else keyed_urls(cards)
    first = keyed.filter("url_key is not null").groupBy("url_key").agg(F.min("ingest_seq").alias("__first"))
    fresh = first.join(seen.select("url_key"), "url_key", "left_anti")
    page = F.coalesce(F.col("kind") == "html", F.lit(False)) if "kind" in cards.columns else F.lit(True)
    fresh = fresh.withColumnRenamed("url_key", "__fresh")
    joined = keyed.join(fresh, spread_absent(keyed, F.col("url_key")) == F.col("__fresh"), "left").drop("__fresh")
    return joined.filter(~page | F.col("url_key").isNull() | (F.col("ingest_seq") == F.col("__first"))).drop("__first")


def seen_after(cards: DataFrame, seen: DataFrame) -> DataFrame:
    """url_key of all that was seen and of all cards of this batch, each once."""
    keyed = cards if "url_key" in cards.columns else keyed_urls(cards)
    return seen.select("url_key").unionAll(keyed.filter("url_key is not null").select("url_key")).distinct()


def mark_new(df: DataFrame, seen_jobs: DataFrame) -> DataFrame:
    """Adds is_new: the title and company were not seen before."""
    keyed = df.withColumn("job_key", T.job_key(F.col("title"), F.col("company")))
    known = seen_jobs.select("job_key").distinct().withColumn("__known", F.lit(True))
    return keyed.join(known, "job_key", "left").withColumn("is_new", F.col("__known").isNull()).drop("__known")


def upsert(registry: DataFrame, scored: DataFrame, batch_id: int, profile_version: str) -> DataFrame:
    """The next registry snapshot. Both sides have key, score and payload; scored may repeat keys (newest by ingest_seq).

    The best score stays and its profile_version with it; the newest payload stays; first_seen, flags and the count of
    batches are carried on; flags of new rows are false.
    """
    s = scored.groupBy("key").agg(F.max("score").alias("s_score"), F.max_by("payload", "ingest_seq").alias("s_payload"))
    both = registry.join(s, "key", "full_outer")
    better = F.col("score").isNull() | (F.col("s_score") > F.col("score"))
    hit = F.col("s_score").isNotNull()
    return both.select(
        "key", F.greatest("score", "s_score").alias("score"),
        F.when(hit & better, F.lit(profile_version)).otherwise(F.col("profile_version")).alias("profile_version"),
        F.coalesce("s_payload", "payload").alias("payload"),
        F.coalesce("first_seen", F.lit(batch_id)).alias("first_seen"),
        F.when(hit, F.lit(batch_id)).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("n_batches", F.lit(0)) + F.when(hit & (F.coalesce("last_seen", F.lit(-1)) != batch_id), 1).otherwise(0)).alias("n_batches"),
        *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS],
    )


COMMON = 200


def _tokens(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.lower(F.trim(T.text(F.col("company")))).alias("co"), T.norm_location(F.col("location")).alias("loc"), F.array_sort(T.title_tokens(F.col("title"))).alias(f"{side}_tokens"), "*")


def _alike(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(co, loc, a_tokens, b_tokens, overlap) of the distinct token sets of ``_tokens`` that reach the threshold.

    Sets meet on the first of their tokens in an order that is the same for all: the ``COMMON`` most frequent tokens come
    last, so that words of most titles do not gather whole companies. Any order gives the same pairs.
    """
    frequent = b.select(F.explode("b_tokens").alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(COMMON)
    listed = F.array(*[F.lit(r["t"]) for r in frequent.collect()]).cast("array<string>")  # at most COMMON words

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        tokens = F.col(f"{side}_tokens")
        n = F.size(tokens)
        rare = F.array_sort(F.transform(tokens, lambda t: F.struct((F.coalesce(F.array_position(listed, t), F.lit(0)) > 0).alias("common"), t.alias("token"))))
        head = F.transform(F.slice(rare, F.lit(1), n - F.ceil(least * n).cast("int") + 1), lambda s: s["token"])
        return df.select("co", "loc", tokens).distinct().filter(n > 0).withColumn("token", F.explode(head))

    pairs = prefixes(a, "a").join(prefixes(b, "b"), ["co", "loc", "token"]).select("co", "loc", "a_tokens", "b_tokens").distinct()
    return pairs.withColumn("overlap", T.jaccard(F.col("a_tokens"), F.col("b_tokens"))).filter(F.col("overlap") >= least)


def near_dupes(new: DataFrame, registry: DataFrame, least: float = 0.75) -> DataFrame:
    """For each new row (ingest_seq, company, title, location) the registry row (key and the same) most alike by title
    tokens, among those of the same company and place: (ingest_seq, key, overlap).

    Rows that reach the threshold share one of the first n - ceil(least * n) + 1 of their ordered tokens, so they meet
    on (company, place, token) and not in whole buckets; distinct token sets are compared once.
    """
    a, b = _tokens(new, "a"), _tokens(registry, "b")
    pairs = _alike(a, b, least)
    earliest = b.groupBy("co", "loc", "b_tokens").agg(F.min(F.struct("ingest_seq", "key")).alias("e"))
    best = pairs.join(earliest, ["co", "loc", "b_tokens"]).groupBy("co", "loc", "a_tokens").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col("e"))).alias("m"))
    return a.join(best, ["co", "loc", "a_tokens"]).select("ingest_seq", F.col("m.e.key").alias("key"), (-F.col("m.o")).alias("overlap"))


def collapse_new(new: DataFrame, registry: DataFrame, least: float = 0.75) -> DataFrame:
    """Like near_dupes, and new rows that match nothing in the registry collapse to the earliest new row alike.

    (ingest_seq, key, overlap, in_batch): where in_batch is true, key is the ingest_seq, as text, of the earliest
    earlier new row of the threshold or more. Among new rows the earliest counts, not the most alike, and a row that
    itself collapses can be the earliest.
    """
    known = near_dupes(new, registry, least).select("ingest_seq", F.col("key").cast("string").alias("key"), "overlap", F.lit(False).alias("in_batch"))
    rest = new.join(known.select("ingest_seq"), "ingest_seq", "left_anti")
    a, b = _tokens(rest, "a"), _tokens(rest, "b")
    earliest = b.groupBy("co", "loc", "b_tokens").agg(F.min("ingest_seq").alias("first"))
    alike = _alike(a, b, least).join(earliest, ["co", "loc", "b_tokens"]).groupBy("co", "loc", "a_tokens").agg(F.min(F.struct("first", "overlap")).alias("m"))
    own = a.join(alike, ["co", "loc", "a_tokens"]).filter(F.col("m.first") < F.col("ingest_seq"))
    return known.unionByName(own.select("ingest_seq", F.col("m.first").cast("string").alias("key"), F.col("m.overlap").alias("overlap"), F.lit(True).alias("in_batch")))


def latest_states(events: DataFrame) -> DataFrame:
    """Current state of each application and how many changes it had, from (app_id, seq, state) in order of seq."""
    return events.groupBy("app_id").agg(F.max_by("state", "seq").alias("state"), F.count(F.lit(1)).alias("n_changes"), F.min("ts").alias("first_ts"), F.max_by("company", "seq").alias("company"))


def funnel(states: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """One row: totals, counts by state (a map), passes among ``decisions``, and the two rates."""
    known = ("discovered", "evaluated", *K.APPLICATION_WEIGHTS)
    n = lambda *names: F.count_if(F.col("state").isin(*names))
    applied, responded = n("applied", "responded", "interview", "offer"), n("responded", "interview", "offer")
    pct = lambda a, b: F.format_string("%.1f%%", F.round(100 * a / F.greatest(b, F.lit(1)), 1))
    total = F.count(F.lit(1))
    by_state = F.create_map(*[x for s in known for x in (F.lit(s), n(s))], F.lit("unknown"), F.count_if(~F.coalesce(F.col("state").isin(*known), F.lit(False))))
    out = states.agg(
        total.alias("total"), F.map_filter(by_state, lambda _, v: v > 0).alias("by_state"), applied.alias("applied"), responded.alias("responded"),
        pct(applied, total).alias("discovery_to_apply"), pct(responded, applied).alias("apply_to_response"),
    )
    if decisions is None:
        return out.withColumn("total_passed", F.lit(0).cast("long"))
    return out.join(F.broadcast(decisions.agg(F.count(F.lit(1)).alias("total_passed"))))  # one row each


def registry_stats(registry: DataFrame) -> DataFrame:
    """One row: total, seen, unseen, dismissed and starred."""
    marked = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    total = F.count(F.lit(1))
    return registry.agg(total.alias("total"), marked("seen").alias("seen"), (total - marked("seen")).alias("unseen"), marked("dismissed").alias("dismissed"), marked("starred").alias("starred"))


def company_signals(states: DataFrame, now) -> DataFrame:
    """company_key and bonus from the states of its applications."""
    weight = T.mapped(F.col("state"), K.APPLICATION_WEIGHTS, F.lit(0.0))
    stale = (F.col("state") == "discovered") & (X.elapsed_days(now, F.col("first_ts")) >= K.STALE_DAYS)
    keyed = states.withColumn("company_key", F.lower(F.trim(T.text(F.col("company"))))).filter("company_key <> ''")
    total = F.sum(F.when(stale, K.STALE_WEIGHT).otherwise(weight))
    return keyed.groupBy("company_key").agg(F.round(F.tanh(total / 10) * 0.08, 4).alias("bonus"))


def discover(applications: DataFrame, scored: DataFrame) -> DataFrame:
    """Applications to add: one a new (title, company), the first to arrive."""
    first = scored.withColumn("job_key", T.job_key(F.col("title"), F.col("company"))).groupBy("job_key").agg(F.min_by("job_id", "ingest_seq").alias("job_id"))
    have = applications.select(T.job_key(F.col("title"), F.col("company")).alias("job_key")).distinct()
    return first.join(have, "job_key", "left_anti").withColumn("state", F.lit("discovered"))


def with_applied(df: DataFrame, applications: DataFrame, states=("applied", "responded", "interview", "offer")) -> DataFrame:
    """Adds applied: an application in one of ``states`` has the posting's title and company. Blank ones match nothing."""
    key = F.when((F.trim(T.text(F.col("title"))) != "") & (F.trim(T.text(F.col("company"))) != ""), T.job_key(F.col("title"), F.col("company")))
    have = applications.filter(F.col("state").isin(*states)).select(key.alias("__key")).filter("__key is not null").distinct().withColumn("__have", F.lit(True))
    return df.join(have, spread_absent(df, key) == F.col("__key"), "left").withColumn("applied", F.coalesce("__have", F.lit(False))).drop("__key", "__have")


def fold_reactions(reactions: DataFrame) -> DataFrame:
    """Flags of each posting after its reactions (key, ts, seq, action) in order.

    up sets starred, down sets dismissed, star and dismiss toggle theirs, clear resets both; every action but clear
    marks as seen, which nothing resets. A flag is what its last setting action (up or down, or clear) left, flipped once
    for each later toggle: aggregation, no ordered walk.
    """
    order = F.struct("ts", "seq")
    sets = lambda name: F.max(F.when(F.col("action").isin(name, "clear"), F.struct("ts", "seq", (F.col("action") == name).alias("on"))))
    last = reactions.groupBy("key").agg(sets("up").alias("__up"), sets("down").alias("__down"))
    rows = reactions.join(last, "key")

    def flag(last_set: str, toggle: str):
        after = F.col(last_set).isNull() | (order > F.struct(f"{last_set}.ts", f"{last_set}.seq"))
        flips = F.count_if((F.col("action") == toggle) & after)
        return (F.coalesce(F.bool_or(F.col(f"{last_set}.on")), F.lit(False)).cast("int") + flips) % 2 == 1

    return rows.groupBy("key").agg(
        flag("__up", "star").alias("starred"), flag("__down", "dismiss").alias("dismissed"),
        F.bool_or(F.col("action") != "clear").alias("seen"), F.count_if(F.col("action") == "up").alias("n_up"),
    )


def sync_labels(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and change (added, dropped, kept, changed) between two label sets (key, state); seeds are left alone."""
    old = cache.filter("state <> 'seed'").select("key", F.col("state").alias("old"))
    both = old.join(wanted.select("key", F.col("state").alias("new")), "key", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").when(F.col("old") == F.col("new"), "kept").otherwise("changed")
    return both.select("key", change.alias("change"))


def split_cached(df: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text_key has a vector of this model, with it, and rows that must be encoded."""
    own = cache.filter(F.col("model") == model).select("text_key", F.col("embedding").alias("cached")).dropDuplicates(["text_key"])
    both = df.join(own, "text_key", "left")
    return both.filter("cached is not null"), both.filter("cached is null").drop("cached")


def merge_reports(df: DataFrame, reports: DataFrame) -> DataFrame:
    """The last report of each url (by seq, failed ones apart) joined to postings; talking points of at most 1000 characters."""
    last = reports.filter("error is null and url <> ''").groupBy(F.col("url").alias("__url")).agg(F.max_by(F.struct("gaps", "points"), "seq").alias("r"))
    return df.join(last, spread_absent(df, F.nullif(df["url"], F.lit(""))) == F.col("__url"), "left").select(df["*"], F.col("r.gaps").alias("gaps"), F.substring(F.array_join("r.points", "; "), 1, 1000).alias("rationale"))


def patch(registry: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """A column set anew by url where there is an update (the last by seq)."""
    last = updates.groupBy(F.col("url").alias("__url")).agg(F.max_by(column, "seq").alias("__new"))
    same = spread_absent(registry, F.col("url")) == F.col("__url")
    return registry.join(last, same, "left").withColumn(column, F.coalesce("__new", column)).drop("__new", "__url")


def rescore(registry: DataFrame, scores: DataFrame) -> DataFrame:
    """Registry with the scores of (key, score, profile_version) in place of its own, not the better of both.

    Rows without a new score stay as they are; marks and dates always do.
    """
    new = scores.select("key", F.col("score").alias("__score"), F.col("profile_version").alias("__version"))
    out = registry.join(new, "key", "left")
    return out.withColumns({"score": F.coalesce("__score", "score"), "profile_version": F.coalesce("__version", "profile_version")}).drop("__score", "__version")


def visible(df: DataFrame) -> DataFrame:
    """Rows to show: of the match tier or starred; without a tier, those marked as a match. Removed ones never."""
    by_tier = F.coalesce(F.col("tier") == "match", F.coalesce("is_match", F.lit(False)))
    return df.filter(~F.coalesce("removed", F.lit(False)) & (F.coalesce("starred", F.lit(False)) | by_tier))


def keep_last(history: DataFrame, n: int, batch: str = "batch_id") -> DataFrame:
    """Rows of the n newest batches that the table has."""
    kept = history.select(batch).distinct().orderBy(F.desc(batch)).limit(n)
    return history.join(F.broadcast(kept), batch, "left_semi")  # at most n rows


def append_batch(history: DataFrame, batch: DataFrame, n: int = 2000) -> DataFrame:
    """History with a batch in place of an earlier run of it, cut to the n newest batches."""
    rest = history.join(F.broadcast(batch.select("batch_id").distinct()), "batch_id", "left_anti")  # ids of one run
    return keep_last(rest.unionByName(batch, allowMissingColumns=True), n)


def react(registry: DataFrame, flags: DataFrame) -> DataFrame:
    """Registry with the marks of (url, starred, dismissed, seen); a url marks its best row only, ties by key."""
    best = registry.filter("url <> ''").groupBy("url").agg(F.max_by("key", F.struct("score", F.struct("key"))).alias("key"))
    named = flags.join(best, "url").select("key", *[F.col(f).alias(f"__{f}") for f in ("starred", "dismissed", "seen")])
    out = registry.join(named, "key", "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in ("starred", "dismissed", "seen")}).drop("__starred", "__dismissed", "__seen")
