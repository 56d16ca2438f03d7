"""Lookups and searches that read little, versions of the inventory, footers, alerts in time."""

import random
import re
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardline.session import work_path
from wardline.sources import commits, footers, schema_watch, search_index, tag_store
from wardline.streaming import breaches
from wardline.streaming import decisions as feed


def buckets_of(df):
    return {re.search(r"bucket=(\d+)", f)[1] for f in df.inputFiles()}


def test_a_lookup_reads_one_bucket(spark, derived):
    path = work_path(spark, "catalog")
    tag_store.load(derived.catalog, path)
    stored = rows(tag_store.read(spark, path))
    assert stored == rows(derived.catalog.select(*tag_store.PATH, *tag_store.VALUES))
    for entry in stored[:3]:
        found = tag_store.column_metadata(spark, path, *entry[:3])
        assert rows(found) == [entry] and len(buckets_of(found)) == 1
        plan = found._jdf.queryExecution().toString()
        assert "PushedFilters: [IsNotNull(schema_name)" in plan
    assert tag_store.column_metadata(spark, path, "no", "such", "column").collect() == []


def test_a_key_of_numbers_and_a_missing_key(spark):
    frame = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (None, None, "c")], "k int, j long, v string")
    table = commits.Keyed(spark, work_path(spark, "table"), ["k", "j"], 16)
    table.upsert(frame)
    for k, j, v in frame.collect():
        assert rows(table.get(frame.schema, k, j), "v") == [(v,)]
    assert table.get(frame.schema, 9, 9).collect() == []


def test_search_equals_a_scan(spark, derived):
    names = ("schema_name", "table_name", "column_name", "tag")
    catalog = derived.catalog.drop("data_type").unionByName(
        spark.createDataFrame([("x", None, "ÄÖÜ_Straße", "")], ", ".join(f"{n} string" for n in names)), allowMissingColumns=True)
    path = work_path(spark, "search")
    search_index.build(catalog, names, path, 32)
    index = search_index.Index(spark, path)
    held = [tuple(r) for r in catalog.collect()]
    for word in ("phone", "PHONE_home", "tbl_1", "no such text", "zzz", "e", "", "id", "äöü_s", "pii:ssn", "nical"):
        want = [r for r in held if any(word.lower() in (v or "").lower() for v in r[:4])]
        assert rows(index.search(word)) == sorted(want, key=repr), word
    assert len(buckets_of(index.postings("phone"))) == 1 and index.postings("phonq") is None
    # A search for one column reads the buckets of its texts, not the table.
    one = index._read("rows", index._buckets([held[0][2].lower()]))
    assert len(buckets_of(one)) == 1
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        search_index.build(catalog, names, path, 32)


def test_versions_and_their_changes_once(spark, monkeypatch):
    path = work_path(spark, "watch")
    kind = "schema_name string, table_name string, column_name string, data_type string"

    def inventory(**types):
        return spark.createDataFrame([("s", "t", c, k) for c, k in types.items()], kind)

    assert schema_watch.record(inventory(a="int", b="int"), path, "one", "2024-01-01 00:00:00")
    assert schema_watch.feed(spark, path).collect() == []
    with monkeypatch.context() as patch:
        patch.setattr(commits, "append_once", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            schema_watch.record(inventory(a="long", c="int"), path, "two", "2024-01-02 00:00:00")
    assert schema_watch.versions(spark, path) == ["one", "two"]
    # The next run brings what the killed one had left out; a version that is there already is not recorded again.
    assert schema_watch.record(inventory(a="int", b="int"), path, "three", "2024-01-03 00:00:00")
    for name in ("one", "two", "three"):
        assert not schema_watch.record(inventory(z="int"), path, name, "2024-01-09 00:00:00")
    assert schema_watch.catch_up(spark, path) == 0
    pairs = [schema_watch.changes(spark, path, a, b) for a, b in (("one", "two"), ("two", "three"))]
    assert rows(schema_watch.feed(spark, path)) == rows(pairs[0].unionByName(pairs[1]))
    assert rows(schema_watch.feed(spark, path, "two"), "event_type") == [("COLUMN_ADDED",), ("COLUMN_REMOVED",), ("TYPE_CHANGED",)]
    assert schema_watch.changes(spark, path, "one", "three").collect() == []


def test_footers_of_many_files(spark, tmp_path):
    for i in range(400):
        value = pa.array([i], pa.int64() if i % 4 else pa.int32())
        place = tmp_path / f"many/day={i % 5}"
        place.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"k": value, "t": pa.array([datetime(2024, 1, 1)])}), place / f"{i}.parquet")
    (tmp_path / "many/broken.parquet").write_bytes(b"PAR1 no footer")
    (tmp_path / "one").mkdir()
    spark.range(5).selectExpr("id", "cast(id AS decimal(7, 2)) AS price", "named_struct('a', id) AS s").coalesce(1).write.mode(
        "overwrite").parquet(f"{tmp_path}/one")
    read = footers.footers(footers.files_of(spark, {"many": f"{tmp_path}/many", "one": f"{tmp_path}/one"})).cache()
    assert rows(footers.table_sizes(read), "table_name", "n_files", "n_rows", "n_unreadable") == [("many", 401, 400, 1), ("one", 1, 5, 0)]
    assert rows(footers.file_columns(read), "table_name", "column_name", "data_type", "n_files", "n_types") == [
        ("many", "k", "bigint", 300, 2), ("many", "k", "int", 100, 2), ("many", "t", "timestamp_ntz", 400, 1),
        ("one", "id", "bigint", 1, 1), ("one", "price", "decimal(7,2)", 1, 1), ("one", "s", "struct<a:bigint>", 1, 1)]
    assert rows(footers.disagreeing(read), "table_name", "schema", "n_files") == [
        ("many", "k bigint, t timestamp_ntz", 300), ("many", "k int, t timestamp_ntz", 100)]
    assert "broken.parquet" in read.filter("error IS NOT NULL").first()["path"]


def test_alerts_and_their_end(spark):
    source, target, state = (work_path(spark, n) for n in ("rows", "alerts", "run"))
    kind = "item string, event_time timestamp, decision string, status string, category string, hours int"
    schema = spark.createDataFrame([], kind).schema

    def hour(h):
        return datetime(2024, 1, 1 + h // 24, h % 24)

    def step(*listed):
        frame = spark.createDataFrame(list(listed), kind) if isinstance(listed[0], tuple) else listed[0]
        frame.coalesce(1).write.mode("append").parquet(source)
        breaches.breach_stream(feed.feed(spark, source, schema), target, state, "0 seconds").awaitTermination()
        return rows(breaches.breached_now(spark, target), "item", "due_time", "status")

    beat = lambda h: breaches.heartbeat(spark, str(hour(h)))
    assert step(("a", hour(0), None, "PENDING", "PHI", 24), ("b", hour(1), None, "PENDING", "PHI", 24),
                ("c", hour(1), None, "PENDING", "Other", None)) == []
    assert step(("a", hour(20), "d1", "APPROVED", None, None)) == []
    assert step(beat(26)) == [("b", hour(25), "PENDING")]
    # Escalated after the alert: the old one is cleared, a new deadline begins; then it is approved.
    assert step(("b", hour(27), "d2", "ESCALATED", None, 4)) == []
    assert step(beat(32)) == [("b", hour(31), "ESCALATED")]
    assert step(("b", hour(33), "d3", "APPROVED", None, None)) == []
    found = rows(breaches.alerts(spark, target).orderBy("batch"), "item", "kind", "due_time")
    assert found == sorted([("b", "breached", hour(25)), ("b", "cleared", hour(25)), ("b", "breached", hour(31)),
                            ("b", "cleared", hour(31))], key=repr)


def test_alerts_equal_the_batch_answer_at_several_times(spark, derived):
    from wardline.operators import decide, monitor

    source, target, state = (work_path(spark, n) for n in ("rows", "alerts", "run"))
    items = breaches.item_rows(derived.queue, "item_key")
    log = breaches.decision_rows(decide.changing(derived.decisions), "item_key")
    items.unionByName(log).write.parquet(source)
    schema = items.schema
    for as_of in ("2024-01-30 07:00:00", "2024-02-01 00:00:00", "2024-02-05 00:00:00"):
        breaches.heartbeat(spark, as_of).write.mode("append").parquet(source)
        breaches.breach_stream(feed.feed(spark, source, schema), target, state, "0 seconds").awaitTermination()
        if as_of > "2024-02-01":  # before, the watermark stands at the newest row
            want = monitor.with_deadline(derived.state, F.lit(as_of).cast("timestamp_ntz")).filter("is_breached")
            assert rows(breaches.breached_now(spark, target), "item") == rows(want.select(F.col("item_key").cast("string")))


def test_alerts_go_by_buckets_of_items(spark):
    """Many items in few calls: at one call for each item, their number and not their rows made the time."""
    source, target, state = (work_path(spark, n) for n in ("rows", "alerts", "run"))
    kind = "item string, event_time timestamp, decision string, status string, category string, hours int"
    start = datetime(2024, 1, 1)
    listed = [(f"i{n}", start, None, "PENDING", "PHI", 1 + n % 3) for n in range(300)]
    listed += [(f"i{n}", start, f"d{n}", "APPROVED", None, None) for n in range(0, 300, 2)]
    frame = spark.createDataFrame([*listed, ("late", start, "x", "ESCALATED", None, 4)], kind)
    frame.write.mode("append").parquet(source)

    def run():
        stream = feed.feed(spark, source, frame.schema)
        breaches.breach_stream(stream, target, state, "0 seconds", buckets=3).awaitTermination()
        held = spark.read.format("statestore").load(state)
        assert held.count() <= 4
        return rows(breaches.breached_now(spark, target), "item")

    assert run() == []
    breaches.heartbeat(spark, str(datetime(2024, 1, 1, 2, 30))).write.mode("append").parquet(source)
    assert run() == sorted((f"i{n}",) for n in range(1, 300, 2) if n % 3 < 2)
    breaches.heartbeat(spark, str(datetime(2024, 1, 1, 9))).write.mode("append").parquet(source)
    assert run() == sorted((f"i{n}",) for n in range(1, 300, 2))


def test_a_bucket_of_the_index_has_few_files(spark, tmp_path):
    """However many tasks write: one file for each task and bucket made most of the index."""
    frame = spark.range(0, 4000, 1, 6).select(F.concat(F.lit("name_"), "id").alias("a"), F.lit("same").alias("b"))
    path = f"{tmp_path}/index"
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search_index.build(frame, ("a", "b"), path, 8)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    index = search_index.Index(spark, path)
    for part in ("rows", "postings"):
        assert len(index._read(part, None).inputFiles()) <= 8
    assert index.search("SAME").count() == 4000 and rows(index.search("name_399"), "a") == sorted(
        (f"name_{n}",) for n in (399, *range(3990, 4000)))
