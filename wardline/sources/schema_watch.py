"""Versions of the column inventory, and the feed of changes from one to the next, each change once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.monitor import PATH, schema_changes
from wardline.schemas import SCHEMA_EVENT
from wardline.sources import commits

COLUMNS = (*PATH, "data_type")


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the stored versions, in the order in which they were recorded."""
    found = commits.Folder(spark, f"{path}/snapshots").names()
    return [n.partition("-")[2] for n in found]


def _folder(spark: SparkSession, path: str, name: str) -> tuple[str, str]:
    """(folder of a version, time at which it was taken)."""
    folder = commits.Folder(spark, f"{path}/snapshots")
    found = next(n for n in folder.names() if n.partition("-")[2] == name)
    taken = folder.names(found)[0]
    return f"{folder.path}/{found}/{taken}", taken.removeprefix("taken=").replace("_", ":")


def snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).parquet(_folder(spark, path, name)[0])


def changes(spark: SparkSession, path: str, before: str, after: str) -> DataFrame:
    """What changed between any two versions, with the time of the second."""
    taken = F.lit(_folder(spark, path, after)[1]).cast("timestamp_ntz")
    return schema_changes(snapshot(spark, path, before), snapshot(spark, path, after), taken)


def record(inventory: DataFrame, path: str, name: str, taken: str) -> bool:
    """Store a version (``taken``: 'yyyy-MM-dd HH:mm:ss') and bring the feed up to date; False if there is one of this name."""
    spark = inventory.sparkSession
    folder = commits.Folder(spark, f"{path}/snapshots")
    known = versions(spark, path)
    new = name not in known
    if new:
        staged = folder.staging()
        inventory.select(*(F.col(c).cast("string").alias(c) for c in COLUMNS)).write.parquet(
            f"{folder.path}/{staged}/taken={taken.replace(':', '_')}")
        folder.commit(staged, f"{len(known):09d}-{name}")
    catch_up(spark, path)
    return new


def catch_up(spark: SparkSession, path: str) -> int:
    """Append the changes of each version that the feed does not have yet, such as one whose run was killed; how many versions
    that were."""
    known = versions(spark, path)
    done = set(commits.batches(spark, f"{path}/events"))
    todo = [(a, b) for a, b in zip(known, known[1:], strict=False) if b not in done]
    for before, after in todo:
        commits.append_once(changes(spark, path, before, after), f"{path}/events", after, "event_id", "ts")
    return len(todo)


def feed(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """All events, or those that led to one version."""
    return commits.logged(spark, f"{path}/events", SCHEMA_EVENT, version).drop("day")
