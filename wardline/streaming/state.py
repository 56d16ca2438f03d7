"""The current state of items, kept up to date by a stream of decisions.

Each batch is appended to a log that takes every decision once, and what was new in it is merged into a keyed table of one
row per item. Both remember the batch by name, so a batch that is run again after a crash, wherever that was, adds nothing twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardline.operators import decide
from wardline.sources import commits
from wardline.streaming.decisions import ALL_THERE_IS

BUCKETS = 64


def _table(spark: SparkSession, path: str, key: str, buckets: int) -> commits.Keyed:
    return commits.Keyed(spark, f"{path}/state", [key], buckets)


def state_stream(decisions: DataFrame, target: str, checkpoint: str, key: str = "id", buckets: int = BUCKETS,
                 trigger: Mapping = ALL_THERE_IS) -> StreamingQuery:
    """Keep ``<target>/log`` and ``<target>/state`` up to date with a stream of changing decisions (``decide.changing``).

    A batch reads and writes only the buckets of its items, whatever the number of items. No decision is too late: the last
    one by (timestamp, decision id) counts, in whatever order they come.
    """
    # Another stream into the same target counts its batches anew.
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    schema = decisions.schema

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        label = f"{stream}_{batch_id:09d}"
        commits.append_once(batch, f"{target}/log", label)
        new = commits.logged(spark, f"{target}/log", schema, label)
        _table(spark, target, key, buckets).upsert(
            decide.fold_parts(new, key), label, lambda old, more: decide.added_parts(old, more, key))

    return (
        decisions.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(save).start()
    )


def current(decisions: DataFrame, target: str, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """The state as ``decide.fold`` gives it, from the table. ``decisions`` gives the columns: any frame of ``decide.changing``."""
    spark = decisions.sparkSession
    schema = decide.fold_parts(spark.createDataFrame([], decisions.schema), key).schema
    return decide.from_parts(_table(spark, target, key, buckets).rows(schema), key)


def queue_now(queue: DataFrame, decisions: DataFrame, target: str, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """The queue with the state that the stream has reached."""
    return decide.with_state(queue, current(decisions, target, key, buckets), key)
