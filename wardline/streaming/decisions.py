"""The decision feed: new decision files become audit rows and daily counts, in one run or continuously.

``trigger`` takes what ``DataStreamWriter.trigger`` takes: everything that is there (default), or an interval such as
``{"processingTime": "1 minute"}`` for a query that goes on.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardline.operators.joins import top_per_key

WATERMARK = "1 hour"
ALL_THERE_IS = {"availableNow": True}
ID = "governance_decision_id"


def feed(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Files that appear below the path, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def deduplicated(decisions: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each decision id once. State is kept only as long as the watermark allows.

    Rows older than the watermark are dropped here; ``late_rows`` reports them.
    """
    timed = decisions.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([ID]).drop("event_time")


def append_stream(decisions: DataFrame, target: str, checkpoint: str, watermark: str = WATERMARK,
                  trigger: Mapping = ALL_THERE_IS) -> StreamingQuery:
    """Append the deduplicated decisions to a Parquet folder, each exactly once across restarts."""
    return (
        deduplicated(decisions, watermark)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(target)
    )


def count_stream(decisions: DataFrame, target: str, checkpoint: str, trigger: Mapping = ALL_THERE_IS) -> StreamingQuery:
    """Decisions per day of an already deduplicated stream, such as the folder that ``append_stream`` fills.

    The state is one row per day, so it needs no watermark and counts late rows too. Every batch writes the days it
    changed to its own folder; a repeated batch overwrites it.
    """
    daily = decisions.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n_decisions"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{target}/batch={batch_id}"
        )

    return (
        daily.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(save)
        .start()
    )


def daily_counts(spark: SparkSession, target: str) -> DataFrame:
    """The last count written for each day; no rows before the first batch."""
    schema = "day date, n_decisions long, batch_id long"
    try:
        written = spark.read.schema(schema).parquet(f"{target}/batch=*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        written = spark.createDataFrame([], schema)
    return top_per_key(written, ["day"], [F.desc("batch_id")]).select("day", "n_decisions", "batch_id")


def compact_counts(spark: SparkSession, target: str, compacted: str) -> None:
    """Write the newest count of each day, with its batch, as one folder that ``daily_counts`` reads; later batches of the
    stream go beside it when ``count_stream`` is pointed there."""
    daily_counts(spark, target).coalesce(1).write.mode("overwrite").parquet(f"{compacted}/batch=0-compacted")


def late_rows(decisions: DataFrame, appended: DataFrame) -> DataFrame:
    """Decisions of the batch log that the stream dropped as too late; the batch log stays the source of truth."""
    return decisions.join(appended.select(ID), ID, "left_anti")


def write_late(decisions: DataFrame, appended: DataFrame, target: str) -> None:
    """Write the late rows of a run beside its target, after the run has ended."""
    late_rows(decisions, appended).write.mode("overwrite").parquet(target)
