"""Decisions per day by event time: a day's count is given once, when the watermark has passed the day, and rows that come later are
given as late, row by row, so that closed counts and late rows add up to the log.

Rows are dealt by a hash of their id to a fixed number of shards, so a busy day is split. A shard's state is one number for each day
that is still open. Spark's own window aggregation drops late rows without a trace; here the operator sees them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.streaming.decisions import ALL_THERE_IS, ID, WATERMARK

SHARDS = 16
DAY_MS = 86_400_000
OUT = "kind string, number long, n_decisions long, governance_decision_id string"
STATE = "days array<long>, counts array<long>"


def _days(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mark = state.getCurrentWatermarkMs()
    open_days = dict(zip(*state.get, strict=True)) if state.exists else {}
    for part in rows:
        part = part[part[ID].notna()]
        late = (part["number"] + 1) * DAY_MS <= mark
        if late.any():
            yield pd.DataFrame({"kind": "late", "number": part.loc[late, "number"], "n_decisions": 1, ID: part.loc[late, ID]})
        for day, n in part.loc[~late, "number"].value_counts().items():
            open_days[int(day)] = open_days.get(int(day), 0) + int(n)
    closed = sorted(d for d in open_days if (d + 1) * DAY_MS <= mark)
    if closed:
        yield pd.DataFrame({"kind": "closed", "number": closed, "n_decisions": [open_days.pop(d) for d in closed], ID: None})
    if open_days:
        state.update((list(open_days), list(open_days.values())))
    elif state.exists:
        state.remove()


def window_stream(decisions: DataFrame, target: str, checkpoint: str, watermark: str = WATERMARK, shards: int = SHARDS,
                  trigger: Mapping = ALL_THERE_IS) -> StreamingQuery:
    """Write closed days and late rows of a stream of decisions, each with its batch, below ``target``.

    The stream has each decision once, such as the log that ``state_stream`` fills. Days are those of UTC. A batch's folder is overwritten if the batch is run again. Rows without an id are not counted: they
    move the watermark only (see ``heartbeat``). A day is closed by the next batch that brings its shard a row.
    """
    timed = decisions.select(ID, F.col("timestamp").cast("timestamp").alias("event_time"))
    timed = timed.filter(F.col("event_time").isNotNull()).withWatermark("event_time", watermark)
    # Rows without an id go to all shards, so that each learns of the new watermark.
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.array(F.pmod(F.xxhash64(ID), F.lit(shards)).cast("int"))
    dealt = timed.withColumn("number", F.expr(f"cast(floor(unix_millis(event_time) / {DAY_MS}) AS bigint)")).withColumn(
        "shard", F.explode(F.when(F.col(ID).isNull(), every).otherwise(own)))
    counted = dealt.groupBy("shard").applyInPandasWithState(_days, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{target}/batch={batch_id}")

    return (
        counted.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger)
        .foreachBatch(save).start()
    )


def heartbeat(spark: SparkSession, like: DataFrame, as_of: str) -> DataFrame:
    """A row without an id, to be put among the stream's files: time has come to ``as_of`` though no decision was made."""
    return spark.range(1).select(*(
        (F.lit(as_of) if f.name == "timestamp" else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields))


def _written(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.schema(f"{OUT}, batch long").option("basePath", target).parquet(f"{target}/batch=*")
    return rows.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("number").cast("int")))


def closed_days(spark: SparkSession, target: str) -> DataFrame:
    """day, n_decisions: the counts of closed days, each final."""
    return _written(spark, target).filter("kind = 'closed'").groupBy("day").agg(F.sum("n_decisions").alias("n_decisions"))


def late_rows(spark: SparkSession, target: str) -> DataFrame:
    """Decisions that came after their day was closed."""
    return _written(spark, target).filter("kind = 'late'").select(ID, "day")
