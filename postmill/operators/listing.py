"""Lists of matches and of the registry: filters with counts of what they hide, sorts, facets, recent ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.operators.aggregates import counts, live
from postmill.operators.filters import first_reason


@dataclass(frozen=True)
class MatchFilters:
    """What a list of matches shows."""

    archetype: str | None = None
    starred_only: bool = False
    unseen_only: bool = False
    show_dismissed: bool = False
    hide_foreign_remote: bool = True


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def hidden_by(f: MatchFilters) -> Column:
    """Name of the first filter that hides a row, or null. Needs removed, tier, starred, dismissed, seen, archetype, location and remote."""
    place = F.coalesce("location", "remote", F.lit(""))
    tier = F.nullif(F.col("tier"), F.lit(""))
    never = F.lit(False)
    return first_reason({
        "removed": _is("removed"),
        "tier": tier.isNotNull() & (tier != "match") & ~_is("starred"),
        "dismissed": never if f.show_dismissed else _is("dismissed"),
        "not starred": ~_is("starred") if f.starred_only else never,
        "seen": _is("seen") if f.unseen_only else never,
        "archetype": ~F.coalesce(F.col("archetype") == f.archetype, never) if f.archetype else never,
        "foreign remote": X.remote_region(place) == "foreign" if f.hide_foreign_remote else never,
    })


def filter_matches(df: DataFrame, f: MatchFilters = MatchFilters()) -> DataFrame:
    return df.filter(hidden_by(f).isNull())


def match_filter_counts(df: DataFrame, f: MatchFilters = MatchFilters()) -> DataFrame:
    """Rows by the first filter that hides them; those shown are "kept"."""
    return counts(df, F.coalesce(hidden_by(f), F.lit("kept")).alias("reason"))


def by_score(df: DataFrame, then: str, score: str = "score", tie: str = "key") -> DataFrame:
    """Highest score first, then the latest of a date column, undated last; ties by ``tie``."""
    return df.orderBy(F.coalesce(F.col(score), F.lit(0)).desc(), F.col(then).desc_nulls_last(), F.col(tie).asc())


def page(ordered: DataFrame, n: int, first: int = 0) -> DataFrame:
    """``n`` rows of an ordered table after the ``first`` ones, with their place from 1. A page is one task's rows."""
    return ordered.offset(first).limit(n).coalesce(1).withColumn("place", F.monotonically_increasing_id() + F.lit(first + 1))


SORTS = {
    "role": "title", "company": "company", "location": "location", "posted": "posted_date", "ghost": "ghost",
    "score": "match_score",
}


def sorted_table(df: DataFrame, by: str = "score", ascending: bool = False, tie: str = "ingest_seq") -> DataFrame:
    """Rows by any column of ``SORTS``, starred ones above all others.

    Texts sort without case and a missing one as blank; a missing ghost score is -1, a missing score 0 and a missing date
    the oldest (the first time seen counts before that).
    """
    if by in ("role", "company", "location"):
        key = F.lower(T.text(F.col(SORTS[by])))
    elif by == "posted":
        dates = [F.col(c) for c in ("posted_date", "first_seen_at") if c in df.columns]
        key = F.coalesce(F.unix_timestamp(F.coalesce(*dates)), F.lit(0))
    else:
        key = F.coalesce(F.col(SORTS[by]), F.lit(-1.0 if by == "ghost" else 0.0))
    starred = _is("starred") if "starred" in df.columns else F.lit(False)
    return df.orderBy(starred.desc(), key.asc() if ascending else key.desc(), F.col(tie).asc())


def recent_matches(matches: DataFrame, n: int = 20, files: int = 5) -> DataFrame:
    """The n best rows of the newest batches: those of at most ``files``, none beyond what gives n rows.

    Only counts by batch are ranked: a batch is read if the newer ones have fewer than n rows.
    """
    from pyspark.sql import Window as W

    sizes = matches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("batch_id")).limit(files)
    newer = F.coalesce(F.sum("n").over(W.orderBy(F.desc("batch_id")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # ``files`` rows
    wanted = sizes.withColumn("newer", newer).filter(F.col("newer") < n).select("batch_id")
    rows = matches.join(F.broadcast(wanted), "batch_id", "left_semi")
    return rows.orderBy(F.coalesce("match_score", F.lit(0.0)).desc(), F.desc("batch_id"), F.asc("ingest_seq")).limit(n)


def reactions_list(reactions: DataFrame, action: str | None = None) -> DataFrame:
    """The latest reaction of each posting, of one action if given, newest first."""
    last = reactions.groupBy("key").agg(F.max(F.struct("ts", "seq", "action")).alias("r")).select("key", "r.ts", "r.seq", "r.action")
    last = last if action is None else last.filter(F.col("action") == action)
    return last.orderBy(F.desc("ts"), F.desc("seq"))


def facet_counts(df: DataFrame) -> DataFrame:
    """(facet, value, n): all, unseen, dismissed and starred rows, and live ones by archetype, before any filter."""
    n = lambda cond: F.count_if(cond).alias
    one = df.agg(F.count(F.lit(1)).alias("total"), n(~_is("seen"))("unseen"), n(_is("dismissed"))("dismissed"), n(_is("starred"))("starred"))
    names = ("total", "unseen", "dismissed", "starred")
    flags = one.select(F.explode(F.array(*[F.struct(F.lit("registry").alias("facet"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in names])).alias("f")).select("f.*")
    kinds = counts(live(df), F.coalesce("archetype", F.lit("uncategorised")).alias("value")).select(F.lit("archetype").alias("facet"), "value", "n")
    return flags.unionByName(kinds)


def top_archetypes(df: DataFrame, n: int = 5) -> DataFrame:
    """The archetypes of most live, not dismissed rows; ties by name."""
    rows = counts(live(df, "dismissed"), F.coalesce("archetype", F.lit("uncategorised")).alias("archetype"))
    return rows.orderBy(F.desc("n"), F.asc("archetype")).limit(n)
