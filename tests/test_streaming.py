"""The decision feed: duplicates, restarts, late rows, daily counts."""

from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from wardline.session import work_path
from wardline.streaming import decisions as feed

SCHEMA = "governance_decision_id string, timestamp timestamp_ntz"


def put(spark, folder, listed):
    spark.createDataFrame(listed, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_feed(spark):
    source, target, state = (work_path(spark, n) for n in ("source", "target", "state"))
    noon = datetime(2024, 1, 1, 12)
    put(spark, source, [("a", noon), ("b", noon + timedelta(minutes=1)), ("a", noon)])
    schema = spark.read.parquet(source).schema

    def run():
        feed.append_stream(feed.feed(spark, source, schema, 1), target, state).awaitTermination()
        return spark.read.schema(schema).parquet(target)

    assert rows(run(), "governance_decision_id") == [("a",), ("b",)]
    # A repeat within the watermark, a row of the next day, then one that is too late.
    put(spark, source, [("b", noon + timedelta(minutes=1)), ("c", noon + timedelta(days=1))])
    assert rows(run(), "governance_decision_id") == [("a",), ("b",), ("c",)]
    put(spark, source, [("late", noon), ("d", noon + timedelta(days=1, minutes=5))])
    taken = run()
    assert rows(taken, "governance_decision_id") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(run(), "governance_decision_id") == [("a",), ("b",), ("c",), ("d",)]  # nothing new: nothing changes
    assert rows(feed.late_rows(spark.read.parquet(source), taken), "governance_decision_id") == [("late",)]

    assert feed.daily_counts(spark, work_path(spark, "nothing")).collect() == []
    counts, count_state = work_path(spark, "counts"), work_path(spark, "count-state")
    for _ in range(2):
        feed.count_stream(feed.feed(spark, target, schema, 1), counts, count_state).awaitTermination()
    batch = taken.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(feed.daily_counts(spark, counts), "day", "n_decisions") == rows(batch) == [
        (datetime(2024, 1, 1).date(), 2), (datetime(2024, 1, 2).date(), 2)]
    compacted = work_path(spark, "compacted")
    feed.compact_counts(spark, counts, compacted)
    assert rows(feed.daily_counts(spark, compacted)) == rows(feed.daily_counts(spark, counts))


def test_late_rows_are_laid_out_by_the_tables_own_partitions(spark, tmp_path, monkeypatch):
    import os

    from conftest import SF

    from wardline.plans import queries

    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = rows(queries.registered()["t2_late_rows"](spark, SF))
    places = {}
    given = queries.work_path
    monkeypatch.setattr(queries, "work_path", lambda s, name: places.setdefault(name, given(s, name)))
    found = rows(queries.registered()["t2_late_rows"](spark, str(tmp_path)))
    assert len([f for f in os.listdir(places["events"].removeprefix("file:")) if f.endswith(".parquet")]) > 2
    assert found and found == want
