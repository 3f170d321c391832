"""Keyed state of streams: reactions, applications, dead sources and stale discoveries as state processors.

State lives in Spark's state store (RocksDB) and goes on from the checkpoint after a restart; what a batch costs depends on
the batch, not on the history. Rows of a key may come in any order within a batch; batches come in the order of time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postmill.functions import constants as K
from postmill.functions import text as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGED = "key long, starred boolean, dismissed boolean, seen boolean, n_up long, n_actions long"


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need the RocksDB store, which is set for the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def in_order(rows, *columns: str) -> list[tuple]:
    """(ts, seq, ``columns``) of all rows of a key of this batch, by time and then sequence; plain tuples, as keys have few rows."""
    found = [r for frame in rows for r in zip(*(frame[c].tolist() for c in ("ts", "seq", *columns)), strict=True)]
    return sorted(found, key=lambda r: (True, 0, r[1]) if r[0] is pd.NaT else (False, r[0], r[1]))


class Reactions(StatefulProcessor):
    """Flags of a posting; a batch that changes them puts out the new ones.

    up sets starred, down sets dismissed, star and dismiss toggle theirs, clear resets both; all but clear mark as seen.
    The state begins with the registry's flags where there are some.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", "starred boolean, dismissed boolean, seen boolean, n_up long, n_actions long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        one = initialState.iloc[0]
        self.flags.update((bool(one["starred"]), bool(one["dismissed"]), bool(one["seen"]), 0, 0))

    def handleInputRows(self, key, rows, timerValues):
        known = self.flags.exists()
        before = tuple(self.flags.get()) if known else (False, False, False, 0, 0)
        starred, dismissed, seen, n_up, n = before
        for _, _, action in in_order(rows, "action"):
            n += 1
            seen = seen or action != "clear"
            if action == "up":
                starred, n_up = True, n_up + 1
            elif action == "down":
                dismissed = True
            elif action == "star":
                starred = not starred
            elif action == "dismiss":
                dismissed = not dismissed
            elif action == "clear":
                starred = dismissed = False
        after = (bool(starred), bool(dismissed), bool(seen), int(n_up), int(n))
        self.flags.update(after)
        if not known or after[:4] != before[:4]:
            yield pd.DataFrame([(key[0], *after)], columns=["key", "starred", "dismissed", "seen", "n_up", "n_actions"])

    def close(self) -> None:
        pass


def reaction_changes(reactions: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Changed flags (key, starred, dismissed, seen, n_up, n_actions) of a stream of (key, ts, seq, action).

    ``flags`` (key, starred, dismissed, seen), a batch table with a row a key, is the state to begin with.
    """
    use_rocksdb(reactions.sparkSession)
    rows = reactions.select(F.col("key").cast("long").alias("key"), "ts", "seq", "action").groupBy("key")
    begin = None if flags is None else flags.select(F.col("key").cast("long").alias("key"), "starred", "dismissed", "seen").groupBy("key")
    return rows.transformWithStateInPandas(Reactions(), CHANGED, "Append", "None", begin)


class Applications(StatefulProcessor):
    """The states that an application went through, as a list; a step that is known by its sequence number changes nothing.

    Steps of applications that were never discovered are ignored, as is a second discovery.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "state string, ts timestamp, seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.history.put([(r.state, r.ts, int(r.seq)) for r in initialState.itertuples()])

    def handleInputRows(self, key, rows, timerValues):
        known = list(self.history.get()) if self.history.exists() else []
        seqs, new = {r[2] for r in known}, []
        for ts, seq, state in in_order(rows, "state"):
            if seq in seqs or (state == "discovered") == bool(known or new):
                continue
            seqs.add(seq)
            new.append((state, ts.to_pydatetime(), int(seq)))
        if new:
            self.history.appendList(new)
            yield pd.DataFrame([(key[0], len(known) + k + 1, *step) for k, step in enumerate(new)], columns=["app_key", "step", "state", "ts", "seq"])

    def close(self) -> None:
        pass


def application_steps(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """History rows (app_key, step, state, ts, seq) of a stream of (title, company, state, ts, seq), as they are taken.

    An application is known by its title and company. ``known`` are history rows (app_key, state, ts, seq) to begin with.
    """
    use_rocksdb(events.sparkSession)
    rows = events.select(T.job_key(F.col("title"), F.col("company")).alias("app_key"), "state", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    begin = None if known is None else known.select("app_key", "state", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq")).groupBy("app_key")
    return rows.groupBy("app_key").transformWithStateInPandas(Applications(), "app_key string, step int, state string, ts timestamp, seq long", "Append", "None", begin)


def latest_steps(history: DataFrame) -> DataFrame:
    """(app_key, state, n_changes, first_ts) of history rows."""
    return history.groupBy("app_key").agg(F.max_by("state", "step").alias("state"), F.max("step").cast("long").alias("n_changes"), F.min("ts").alias("first_ts"))


class Cooldowns(StatefulProcessor):
    """When a source failed last; a success clears it, and event time ends it after ``days``.

    Puts out the source's new standing whenever it changes: suppressed until a time, or free (null).
    """

    def __init__(self, days: float):
        self.length = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dead = handle.getValueState("dead", "failed_ms long, version long")
        self.version = handle.getValueState("version", "version long")

    def _next(self) -> int:
        n = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((n,))
        return n

    def _say(self, key, failed: int | None) -> pd.DataFrame:
        until = None if failed is None else failed + self.length
        return pd.DataFrame({"source": [key[0]], "slug": [key[1]], "until_ms": pd.array([until], dtype="Int64"), "version": [self._next()]})

    def handleInputRows(self, key, rows, timerValues):
        before = self.dead.get()[0] if self.dead.exists() else None
        failed = before
        for _, _, ts_ms, bad in in_order(rows, "ts_ms", "failed"):
            failed = int(ts_ms) if bad else None
        if failed is not None and failed + self.length <= timerValues.getCurrentWatermarkInMs():
            failed = None
        if failed == before:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if failed is None:
            self.dead.clear()
        else:
            self.dead.update((failed, 0))
            self.handle.registerTimer(failed + self.length)
        yield self._say(key, failed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.dead.clear()
        yield self._say(key, None)

    def close(self) -> None:
        pass


def cooldown_changes(results: DataFrame, days: float = 7, late: str = "1 hour") -> DataFrame:
    """(source, slug, until_ms, version) for each change of a stream of (source, slug, ts, seq, failed)."""
    use_rocksdb(results.sparkSession)
    ts = F.col("ts").cast("timestamp")
    rows = results.select(F.col("source").cast("string").alias("source"), F.col("slug").cast("string").alias("slug"), ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"), F.col("seq").cast("long").alias("seq"), "failed")
    return rows.withWatermark("ts", late).groupBy("source", "slug").transformWithStateInPandas(Cooldowns(days), "source string, slug string, until_ms long, version long", "Append", "EventTime")


def suppressed(changes: DataFrame, now) -> DataFrame:
    """(source, slug) of what is in its cooldown at ``now``, from all changes so far: one row a source is kept."""
    last = changes.groupBy("source", "slug").agg(F.max_by("until_ms", "version").alias("until_ms"))
    return last.filter(F.col("until_ms") > F.unix_millis(now)).select("source", "slug")


class StaleSignals(StatefulProcessor):
    """What an application adds to its company's signal: the weight of its state, or a little less than nothing once it has
    stood at "discovered" until ``days`` after its first event. Puts out each difference to what it added before.

    An event-time timer tells when that is; it always lies ahead of the watermark, for what is stale on arrival is put out at once.
    """

    def __init__(self, days: float):
        self.length = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.added = handle.getValueState("added", "company string, weight double, first_ms long")

    def _say(self, company: str, weight: float, first: int, at_ms: int):
        before = self.added.get()[1] if self.added.exists() else 0.0
        self.added.update((company, weight, first))
        if weight != before:
            yield pd.DataFrame({"company_key": [company], "delta": [weight - before], "at": [pd.Timestamp(at_ms, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues):
        own = in_order(rows, "ts_ms", "state", "company_key")
        _, _, at, state, company = own[-1]
        first = min(self.added.get()[2] if self.added.exists() else at, min(r[2] for r in own))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        weight = float(K.APPLICATION_WEIGHTS.get(state, 0.0))
        if state == "discovered":
            if first + self.length <= timerValues.getCurrentWatermarkInMs():
                weight = float(K.STALE_WEIGHT)
            else:
                self.handle.registerTimer(first + self.length)
        yield from self._say(company, weight, first, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        company, _, first = self.added.get()
        yield from self._say(company, float(K.STALE_WEIGHT), first, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def signal_changes(states: DataFrame, days: float = K.STALE_DAYS, late: str = "1 hour") -> DataFrame:
    """(company_key, delta, at) of a stream of application states (app_id, company, state, ts, seq)."""
    use_rocksdb(states.sparkSession)
    ts = F.col("ts").cast("timestamp")
    rows = states.select(F.col("app_id").cast("long").alias("app_id"), F.lower(F.trim(T.text(F.col("company")))).alias("company_key"), "state", ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"), F.col("seq").cast("long").alias("seq"))
    rows = rows.filter("company_key <> ''").withWatermark("ts", late)
    return rows.groupBy("app_id").transformWithStateInPandas(StaleSignals(days), "company_key string, delta double, at timestamp", "Append", "EventTime", eventTimeColumnName="at")


def weekly_signals(states: DataFrame, days: float = K.STALE_DAYS, late: str = "1 hour") -> DataFrame:
    """(week, company_key, delta): changes summed by company and week, a windowed aggregation over the timers' output."""
    changes = signal_changes(states, days, late)
    week = F.window("at", "7 days", startTime="4 days")
    return changes.groupBy(week, "company_key").agg(F.sum("delta").alias("delta")).select(F.col("window.start").alias("week"), "company_key", "delta")


def bonuses(changes: DataFrame) -> DataFrame:
    """company_key and bonus of all changes so far."""
    return changes.groupBy("company_key").agg(F.round(F.tanh(F.sum("delta") / 10) * 0.08, 4).alias("bonus"))
