"""Polling cycles as Structured Streaming: each job reads what arrives, keeps state, and writes Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from postmill.functions import text as T
from postmill.operators import registry as R
from postmill.operators.shared import checkpoint_dir
from postmill.streaming import state as Y
from postmill.streaming.buckets import BUCKETS, BucketedTable


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors see (spark.checkpoint.dir); in local mode a temporary one may stand in."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Process all that is there (a manual cycle), appending to ``folder``; returns what was written."""
    spark = stream.sparkSession
    job = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def unseen_urls(cards: DataFrame, *, arrival: str = "ingest_ts", keep: str = "2 days") -> DataFrame:
    """Pages (kind "html", or no column kind) whose URL no card had within ``keep`` before, and all cards of other kinds or without
    a URL; url_key is null for those.

    A URL counts as seen after a card of any kind. State is dropped by arrival time, not by a cap.
    """
    keyed = cards.withColumn("url_key", F.nullif(T.norm_url(F.col("url")), F.lit(""))).withWatermark(arrival, keep)
    page = F.coalesce(F.col("kind") == "html", F.lit(False)) if "kind" in cards.columns else F.lit(True)
    fresh = keyed.filter("url_key is not null").dropDuplicatesWithinWatermark(["url_key"]).filter(page)
    return fresh.unionByName(keyed.filter(F.col("url_key").isNull() | ~page))


def weekly_counts(rows: DataFrame, *, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Rows by week from Monday; late rows count until the watermark passes."""
    week = F.window(ts, "7 days", startTime="4 days")
    return rows.withWatermark(ts, late).groupBy(week).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week"), "n")


REGISTRY = "key string, score long, profile_version string, payload long, first_seen int, last_seen int, n_batches int, " + ", ".join(f"{f} boolean" for f in R.FLAGS)


def registry_table(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> BucketedTable:
    """The registry as a table in hash buckets of its keys, with versions."""
    return BucketedTable(spark, folder, REGISTRY, buckets)


def read_registry(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A registry snapshot, the last unless ``version`` names one; empty where there is none yet."""
    return registry_table(spark, folder).read(version)


def upsert_registry(batch: DataFrame, folder: str, version: int, profile_version: str, buckets: int = BUCKETS) -> int:
    """Upsert scored rows (key, score, payload, ingest_seq) as a version of the registry; returns the buckets rewritten."""
    return registry_table(batch.sparkSession, folder, buckets).merge(batch, version, lambda old, new: R.upsert(old, new, version, profile_version))


def each_batch(stream: DataFrame, folder: str, write) -> None:
    """Run ``write(batch, batch_id)`` on all that is there; state and progress are kept in ``folder``."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def registry_cycles(stream: DataFrame, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """Upsert each micro-batch of scored rows into the registry, in the buckets that it touches; returns the last version.

    Version n is made from the version before and batch n, so a batch that runs again gives the same rows; a cycle without
    data returns the last version there is.
    """
    each_batch(stream, folder, lambda batch, n: upsert_registry(batch, folder, n, f"v{n}", buckets))
    return read_registry(stream.sparkSession, folder)


FLAGGED = Y.CHANGED


def reaction_cycles(stream: DataFrame, folder: str, flags: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Keep the flags of postings by keyed state; a cycle writes only the buckets of the keys whose flags changed.

    Returns the flags of all keys that had reactions.
    """
    table = BucketedTable(stream.sparkSession, folder, FLAGGED, buckets)

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new)
        return both.groupBy("key").agg(F.max_by(F.struct(*[c for c in both.columns if c != "key"]), "n_actions").alias("r")).select("key", "r.*")

    each_batch(Y.reaction_changes(stream, flags), folder, lambda batch, n: table.merge(batch, n, newest))
    return table.read()


class IdleAlerts(StatefulProcessor):
    """A user without events for ``idle`` hours gives an alert, and another after each ``cooldown`` hours until the next event.

    Event-time timers: a later event moves the timer, so alerts come from the watermark and not from the clock.
    """

    def __init__(self, idle: float, cooldown: float):
        self.idle, self.cooldown = int(idle * 3_600_000), int(cooldown * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long, alerts int")

    def _arm(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        newest = max(int(frame["ts_ms"].max()) for frame in rows)
        state = self.last.get() if self.last.exists() else None
        if state is None or newest > state[0]:
            self.last.update((newest, 0))
            self._arm(newest + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        last, before = self.last.get()
        due = 1 + max(before, (timerValues.getCurrentWatermarkInMs() - last - self.idle) // self.cooldown)  # event time may leap
        self.last.update((last, due))
        self.handle.registerTimer(last + self.idle + due * self.cooldown)
        yield pd.DataFrame({"user_id": key[0], "last_ms": last, "alert": range(before + 1, due + 1)})

    def close(self) -> None:
        pass


def idle_alerts(events: DataFrame, idle: float = 72, cooldown: float = 48, late: str = "1 hour") -> DataFrame:
    """Alert rows (user_id, last_ms, alert) of a stream of (user_id, ts).

    State with timers needs the RocksDB store, which is set for the session.
    """
    Y.use_rocksdb(events.sparkSession)
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(
        IdleAlerts(idle, cooldown), "user_id long, last_ms long, alert int", "Append", "EventTime")


class CycleCounter(StreamingQueryListener):
    """Counts of rows and batches of the queries of this session, as they go on."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        name = str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + int(event.progress.numInputRows)
        self.batches[name] = self.batches.get(name, 0) + 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


LETTER = "slug string, body string, file string, batch long"


def feed_cycles(spark: SparkSession, landed: str, folder: str, parse, files: int = 100) -> tuple[DataFrame, DataFrame]:
    """Landed text files, a JSON line {slug, body} for each fetched body, to postings and dead letters as they arrive.

    ``parse`` maps (slug, body) to postings. A line or a body that is no JSON goes to the dead letters as it is, with its file and
    batch; an empty body is one too. At most ``files`` files make a batch, and a batch that runs again replaces itself.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(landed).select("value", F.col("_metadata.file_path").alias("file"))

    def write(batch: DataFrame, n: int) -> None:
        got = batch.select(F.from_json("value", "slug string, body string").alias("j"), "value", "file").select("j.slug", F.coalesce("j.body", "value").alias("body"), F.col("j.body").isNotNull().alias("whole"), "file")
        good = F.col("whole") & F.try_parse_json("body").isNotNull()
        parse(got.filter(good).select("slug", "body")).write.mode("overwrite").parquet(f"{folder}/postings/batch={n}")
        got.filter(~good).select("slug", "body", "file", F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{folder}/dead/batch={n}")

    each_batch(lines, folder, write)
    empty = parse(spark.createDataFrame([], "slug string, body string"))
    return spark.read.schema(empty.schema).parquet(f"{folder}/postings"), spark.read.schema(LETTER).parquet(f"{folder}/dead")
