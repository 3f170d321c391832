"""Bucketed tables and keyed state of streams against batch operators, over random walks cut into micro-batches."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import registry as R
from postmill.streaming import jobs
from postmill.streaming import state as Y
from postmill.streaming.buckets import BucketedTable

START = datetime.datetime(2024, 1, 1)
SCORED = "key string, score long, payload long, ingest_seq long"


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/data/**/part-*", recursive=True)}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(f"k{i}", i, i, i) for i in range(300)] + [(None, 1, 1, 1)], SCORED)
    assert jobs.upsert_registry(rows, folder, 0, "v0", 16) == 16
    before = files(folder)
    batch = spark.createDataFrame([("k3", 500, 1, 1), ("new", 1, 2, 2)], SCORED)
    touched = jobs.upsert_registry(batch, folder, 1, "v1", 99)  # the first version fixed the number of buckets
    assert touched <= 2 and {f: t for f, t in files(folder).items() if f in before} == before
    assert len({os.path.dirname(f) for f in files(folder)} - {os.path.dirname(f) for f in before}) == touched
    plain = R.upsert(jobs.read_registry(spark, folder, 0), batch, 1, "v1").orderBy("key").collect()
    assert jobs.read_registry(spark, folder).orderBy("key").collect() == plain
    jobs.upsert_registry(batch, folder, 1, "v1")  # a batch that runs again
    assert jobs.read_registry(spark, folder).orderBy("key").collect() == plain


def test_old_versions_are_pruned_and_kept_ones_read(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "key string, n long", 8, keep=2)
    newest = lambda old, new: old.join(new, "key", "left_anti").unionByName(new)
    table.merge(spark.createDataFrame([(f"k{i}", 0) for i in range(50)], "key string, n long"), 0, newest)
    for v in range(1, 6):
        table.merge(spark.createDataFrame([("k1", v)], "key string, n long"), v, newest)
        table.merge(spark.createDataFrame([], "key string, n long"), v + 100, newest) if v == 5 else None
    assert table.versions() == [5, 105]
    for v in table.versions():
        got = {r.key: r.n for r in table.read(v).collect()}
        assert len(got) == 50 and got["k1"] == 5
    assert len({os.path.dirname(f) for f in files(str(tmp_path))}) == 8  # one folder for each bucket
    with pytest.raises(ValueError):
        table.read(3)


def stream_of(spark, folder, batches, schema):
    """Each batch as one file, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def cut(rows, n, rnd):
    edges = sorted(rnd.sample(range(1, len(rows)), n - 1))
    out = [rows[a:b] for a, b in zip([0, *edges], [*edges, len(rows)], strict=True)]
    for own in out:
        rnd.shuffle(own)
    return out


def test_reactions_by_state_equal_the_fold(spark, tmp_path):
    rnd = random.Random(2)
    actions = ["up", "down", "star", "dismiss", "clear", "seen"]
    rows = [(rnd.randrange(12), START + datetime.timedelta(minutes=i // 2), i, rnd.choice(actions)) for i in range(200)]
    schema = "key long, ts timestamp, seq long, action string"
    want = {r.key: r for r in R.fold_reactions(spark.createDataFrame(rows, schema)).collect()}
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    batches = cut(rows, 5, rnd)
    jobs.reaction_cycles(stream_of(spark, source, batches[:3], schema), folder, buckets=4)
    got = jobs.reaction_cycles(stream_of(spark, source, batches[3:], schema), folder, buckets=4).collect()  # a restart in between
    assert {r.key for r in got} == set(want)
    assert all((r.starred, r.dismissed, r.seen, r.n_up) == (w.starred, w.dismissed, w.seen, w.n_up) for r in got for w in [want[r.key]])


def test_reactions_begin_with_the_registry_and_put_out_changes_only(spark, tmp_path):
    flags = spark.createDataFrame([(1, True, False, True), (2, False, False, True)], "key long, starred boolean, dismissed boolean, seen boolean")
    rows = [[(1, START, 1, "seen"), (2, START, 2, "up"), (3, START, 3, "clear")]]
    stream = stream_of(spark, str(tmp_path / "in"), rows, "key long, ts timestamp, seq long, action string")
    got = jobs.run_once(Y.reaction_changes(stream, flags), str(tmp_path / "out")).collect()
    assert sorted((r.key, r.starred, r.dismissed, r.seen) for r in got) == [(2, True, False, True), (3, False, False, False)]


def test_applications_ignore_what_is_unknown_or_known(spark, tmp_path):
    schema = "title string, company string, state string, ts timestamp, seq long"
    at = lambda i: START + datetime.timedelta(hours=i)
    first = [("PM", "A", "applied", at(0), 1), ("PM", "A", "discovered", at(1), 2), ("pm ", "a", "applied", at(2), 3), ("X", "B", "offer", at(1), 4)]
    second = [("PM", "A", "applied", at(2), 3), ("PM", "A", "discovered", at(3), 5), ("PM", "A", "interview", at(4), 6), ("Y", "C", "rejected", at(4), 7)]
    known = spark.createDataFrame([("y||c", "discovered", at(0), 0)], "app_key string, state string, ts timestamp, seq long")
    got = jobs.run_once(Y.application_steps(stream_of(spark, str(tmp_path / "in"), [first, second], schema), known), str(tmp_path / "out"))
    assert sorted((r.app_key, r.step, r.state, r.seq) for r in got.collect()) == [("pm||a", 1, "discovered", 2), ("pm||a", 2, "applied", 3), ("pm||a", 3, "interview", 6), ("y||c", 2, "rejected", 7)]
    assert {r.app_key: (r.state, r.n_changes) for r in Y.latest_steps(got).collect()} == {"pm||a": ("interview", 3), "y||c": ("rejected", 2)}


def test_cooldowns_expire_clear_and_go_on_after_a_restart(spark, tmp_path):
    schema = "source string, slug string, ts timestamp, seq long, failed boolean"
    at = lambda d: START + datetime.timedelta(days=d)
    batches = [[("g", "dead", at(0), 1, True), ("g", "back", at(0), 2, True)], [("g", "back", at(1), 3, False), ("g", "again", at(1), 4, True)], [("g", "again", at(6), 5, True)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    off = lambda c, day: sorted(r.slug for r in Y.suppressed(c, F.lit(str(at(day))).cast("timestamp")).collect())
    changes = jobs.run_once(Y.cooldown_changes(stream_of(spark, source, batches[:1], schema)), out)
    assert off(changes, 1) == ["back", "dead"] and off(changes, 7) == []
    changes = jobs.run_once(Y.cooldown_changes(stream_of(spark, source, batches[1:], schema)), out)
    assert off(changes, 6) == ["again", "dead"] and off(changes, 8) == ["again"] and off(changes, 13) == []
    stream_of(spark, source, [[("g", "late", at(9), 6, True)], [("g", "late", at(9.1), 7, True)]], schema)
    changes = jobs.run_once(Y.cooldown_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)), out)
    last = {r.slug: r.until_ms for r in changes.groupBy("slug").agg(F.max_by("until_ms", "version").alias("until_ms")).collect()}
    assert last["dead"] is None and last["back"] is None and last["again"] is not None  # the timer has dropped what expired


def test_signals_equal_the_batch_form_at_the_watermark(spark, tmp_path):
    rnd = random.Random(6)
    states = ["discovered", "discovered", "applied", "rejected", "interview", "passed", "evaluated"]
    rows = [(rnd.randrange(60), f"Co {rnd.randrange(60) % 4}", rnd.choice(states), START + datetime.timedelta(hours=2 * i), i) for i in range(220)]
    rows = [(a, f"Co {a % 4}", s, t, i) for a, _, s, t, i in rows]
    schema = "app_id long, company string, state string, ts timestamp, seq long"
    stream = stream_of(spark, str(tmp_path / "in"), cut(rows, 4, rnd), schema)
    changes = jobs.run_once(Y.signal_changes(stream), str(tmp_path / "out"))
    now = F.lit(str(rows[-1][3] - datetime.timedelta(hours=1))).cast("timestamp")
    want = {r.company_key: r.bonus for r in R.company_signals(R.latest_states(spark.createDataFrame(rows, schema)), now).collect()}
    assert {r.company_key: r.bonus for r in Y.bonuses(changes).collect()} == want
    closed = jobs.run_once(Y.weekly_signals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), str(tmp_path / "weeks"))
    week = F.window("at", "7 days", startTime="4 days")["start"].alias("week")
    all_weeks = {(r.week, r.company_key): r.delta for r in changes.groupBy(week, "company_key").agg(F.sum("delta").alias("delta")).collect()}
    got = {(r.week, r.company_key): r.delta for r in closed.collect()}
    assert got and got == {k: v for k, v in all_weeks.items() if k[0] in {w for w, _ in got}}


def test_large_batches_of_events_are_written_by_many_tasks(spark, sf, monkeypatch):
    from postmill.plans import stream_queries

    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    folders = []
    monkeypatch.setattr(stream_queries.jobs, "shared_folder", lambda s, own=stream_queries.jobs.shared_folder: folders.append(own(s)) or folders[-1])
    stream_queries.event_batches(spark, sf)
    got = spark.read.parquet(f"{folders[0]}/events")
    assert len(got.inputFiles()) == 12 and got.count() == 1000


def test_rows_of_a_key_come_by_time_and_sequence():
    import pandas as pd

    from postmill.streaming.state import in_order

    day = pd.Timestamp("2024-01-02")
    frames = [pd.DataFrame({"ts": [day, pd.NaT], "seq": [2, 1], "x": ["b", "d"]}), pd.DataFrame({"ts": [day, pd.Timestamp("2024-01-03")], "seq": [1, 0], "x": ["a", "c"]})]
    assert [r[2] for r in in_order(iter(frames), "x")] == ["a", "b", "c", "d"]
