"""Stored tables that change safely: repeated appends, killed runs, upserts that touch few buckets."""

import os
from datetime import datetime

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardline.operators import decide
from wardline.session import work_path
from wardline.sources import commits, sinks, tag_store
from wardline.streaming import decisions as feed
from wardline.streaming import state, windows

KIND = "governance_decision_id string, timestamp timestamp_ntz, v int"


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def files(path):
    path = path.removeprefix("file:")
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_repeated_append_adds_nothing(spark):
    path = work_path(spark, "log")
    first = spark.createDataFrame([("a", at(1), 1), ("b", at(1), 2), ("b", at(1), 1), ("n", None, 5)], KIND)
    assert commits.logged(spark, path, first.schema).collect() == []
    assert commits.append_once(first, path, "one")
    assert not commits.append_once(first, path, "one")
    held = files(path)
    # Under another name all rows are known; a new day is appended without reading the old one.
    assert commits.append_once(first, path, "again")
    assert commits.append_once(spark.createDataFrame([("c", at(2), 1), ("a", at(1), 1)], KIND), path, "two")
    assert commits.append_once(first.limit(0), path, "none")
    want = [("a", at(1), 1), ("b", at(1), 1), ("c", at(2), 1), ("n", None, 5)]
    assert rows(commits.logged(spark, path, first.schema).drop("day")) == sorted(want, key=repr)
    assert held <= files(path) and len(files(path)) == len(held) + 1
    assert commits.batches(spark, path) == ["again", "none", "one", "two"]
    assert rows(commits.logged(spark, path, first.schema, "two"), "governance_decision_id") == [("c",)]


def test_rows_without_an_id(spark):
    path = work_path(spark, "log")
    frame = spark.createDataFrame([(None, at(1), 1), (None, at(1), 1), (None, at(1), 2)], KIND)
    commits.append_once(frame, path, "one")
    assert rows(commits.logged(spark, path, frame.schema), "v") == [(1,), (2,)]


def test_killed_runs_leave_no_trace(spark, monkeypatch):
    path, table = work_path(spark, "log"), work_path(spark, "table")
    frame = spark.createDataFrame([("a", at(1), 1)], KIND)
    keyed = commits.Keyed(spark, table, ["governance_decision_id"], 8)
    keyed.upsert(frame)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(commits.Folder, "commit", killed)
        for run in (lambda: commits.append_once(frame, path, "one"), lambda: keyed.upsert(frame.withColumn("v", F.lit(2)), "x")):
            with pytest.raises(KeyboardInterrupt):
                run()
    assert commits.batches(spark, path) == [] and rows(keyed.rows(frame.schema), "v") == [(1,)]
    assert commits.append_once(frame, path, "one") and keyed.upsert(frame.withColumn("v", F.lit(2)), "x")
    assert rows(commits.logged(spark, path, frame.schema), "v") == [(1,)]
    assert rows(keyed.rows(frame.schema), "v") == [(2,)]


def test_a_second_writer_fails_at_the_rename(spark):
    folder = commits.Folder(spark, work_path(spark, "race"))
    for _ in range(2):
        spark.range(1).write.parquet(f"{folder.path}/_staging/{_}")
    folder.commit("_staging/0", "batch=1")
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        folder.commit("_staging/1", "batch=1")


def test_an_upsert_rewrites_only_its_buckets(spark):
    path = work_path(spark, "table")
    start = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    keyed = commits.Keyed(spark, path, ["k"], 128)
    keyed.upsert(start)
    before = files(path)
    changes = spark.range(995, 1005).select(F.col("id").alias("k"), F.lit("new").alias("v"))
    buckets = {r[0] for r in changes.select(F.pmod(F.xxhash64("k"), F.lit(128))).collect()}
    assert keyed.upsert(changes, "ten")
    assert not keyed.upsert(changes.withColumn("v", F.lit("other")), "ten")
    added = files(path) - before
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in added} == buckets and len(buckets) <= 10
    assert before <= files(path)  # what was there stays until it is vacuumed
    want = [(i, "new" if i >= 995 else "old") for i in range(1005)]
    assert rows(keyed.rows(start.schema)) == sorted(want, key=repr)
    keyed.vacuum()
    assert rows(keyed.rows(start.schema)) == sorted(want, key=repr)
    assert len(files(path)) < len(before | added) and not keyed.upsert(changes, "ten")
    assert keyed.upsert(changes.limit(0), "nothing") and rows(keyed.rows(start.schema)) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="128 buckets"):
        commits.Keyed(spark, path, ["k"], 64)


def test_a_missing_key_is_a_key(spark):
    keyed = commits.Keyed(spark, work_path(spark, "table"), ["k"], 4)
    kind = "k string, v int"
    keyed.upsert(spark.createDataFrame([(None, 1), ("a", 1)], kind))
    keyed.upsert(spark.createDataFrame([(None, 2)], kind))
    assert rows(keyed.rows(spark.createDataFrame([], kind).schema)) == [("a", 1), (None, 2)]


def test_tag_writes_in_any_order(spark):
    columns = (*tag_store.PATH, *tag_store.VALUES)
    catalog = spark.createDataFrame(
        [("s", "t", c, "pii:ssn", "MASK", "P", "", "", "Classified", "STRING") for c in "abc"], ", ".join(f"{c} string" for c in columns))
    kind = "schema_name string, table_name string, column_name string, tag string, user_email string, ts timestamp_ntz, decision_id string"
    events = [("s", "t", "a", "x", "u", at(3), "1"), ("s", "t", "a", "y", "u", at(2), "2"), ("s", "t", "new", "z", "v", at(1), "3"),
              ("s", "t", "b", "p", "u", at(1), "4"), ("s", "t", "b", "q", "u", at(1), "5")]
    found = []
    for order in (events, events[::-1]):
        path = work_path(spark, "tags")
        tag_store.load(catalog, path, 4)
        for i, event in enumerate(order):
            assert tag_store.write_tags(spark.createDataFrame([event], kind), path, str(i), 4)
        assert not tag_store.write_tags(spark.createDataFrame(events, kind), path, "0", 4)
        found.append(rows(tag_store.read(spark, path, 4), "column_name", "tag", "masking_policy", "last_reviewer", "class_date"))
    assert found[0] == found[1] == [
        ("a", "x", "MASK", "u", "2024-01-03"), ("b", "q", "MASK", "u", "2024-01-01"), ("c", "pii:ssn", "MASK", "", ""),
        ("new", "z", "None", "v", "2024-01-01")]


# --- streams -----------------------------------------------------------------------------------------------------


def test_state_stream_after_restarts_and_crashes(spark, derived, monkeypatch):
    source, target, run = (work_path(spark, n) for n in ("events", "state", "run"))
    events = derived.table("events")

    def step():
        stream = decide.changing(derived.decisions_from(feed.feed(spark, source, events.schema, 1)))
        state.state_stream(stream, target, run, "item_key", 8).awaitTermination()
        return stream

    upsert = commits.Keyed.upsert
    calls = []

    def fails_once(self, *given):
        calls.append(given[1])
        if len(calls) == 2:
            raise RuntimeError("killed between the log and the state")
        return upsert(self, *given)

    monkeypatch.setattr(commits.Keyed, "upsert", fails_once)
    for part in range(3):
        # Every part repeats a tenth of the one before it.
        mine = (F.col("event_id") % 3 == part) | ((F.col("event_id") % 3 == part - 1) & (F.col("event_id") % 10 == 0))
        events.filter(mine).repartition(2).write.mode("append").parquet(source)
        try:
            stream = step()
        except PySparkException as error:
            assert "killed between" in str(error)
            stream = step()
    assert len(calls) == 7 and calls[1] == calls[2]
    want = decide.fold(derived.decisions, "item_key")
    assert rows(state.current(stream, target, "item_key", 8)) == rows(want)
    ids = commits.logged(spark, f"{target}/log", stream.schema).select("governance_decision_id")
    assert ids.count() == ids.distinct().count() == decide.effective(derived.decisions).count()


def test_days_close_once_and_late_rows_are_kept(spark):
    source, target, run = (work_path(spark, n) for n in ("decisions", "windows", "run"))
    kind = "governance_decision_id string, timestamp timestamp_ntz"
    schema = spark.createDataFrame([], kind).schema

    def step(listed=(), frame=None):
        frame = frame or spark.createDataFrame(list(listed), kind)
        frame.coalesce(1).write.mode("append").parquet(source)
        query = windows.window_stream(feed.feed(spark, source, schema), target, run, shards=3)
        query.awaitTermination()
        return (rows(windows.closed_days(spark, target)), rows(windows.late_rows(spark, target), "governance_decision_id"),
                query.lastProgress["stateOperators"][0]["numRowsTotal"])

    first = [(f"a{i}", at(1, i % 24)) for i in range(40)] + [("none", None)]
    assert step(first)[:2] == ([], [])
    assert step([("b1", at(2, 12))])[:2] == ([], [])
    # The watermark has passed the first day: its count is final, and what comes for it now is late.
    closed, late, held = step([("x", at(1, 5)), ("y", at(1, 23)), ("b2", at(2, 13)), *((f"c{i}", at(3, 1)) for i in range(20))])
    assert late == [("x",), ("y",)]
    beat = spark.createDataFrame([], kind)
    step(frame=windows.heartbeat(spark, beat, "2024-01-09 00:00:00"))
    closed, late, held = step(frame=windows.heartbeat(spark, beat, "2024-01-09 00:00:01"))
    assert closed == [(at(1).date(), 40), (at(2).date(), 2), (at(3).date(), 20)]
    assert late == [("x",), ("y",)] and held == 0
    assert step([("z", at(3, 9))])[1:] == ([("x",), ("y",), ("z",)], 0)


def test_k4_stores_each_row_once(spark, derived):
    path = work_path(spark, "audit")
    sinks.append_audit(derived.audit, path)
    sinks.append_audit(derived.audit, path)
    assert rows(sinks.stored_audit(spark, path)) == rows(derived.audit)
