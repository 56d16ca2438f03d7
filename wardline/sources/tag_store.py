"""The catalog as a stored table that tag writes change: an upsert by column, which rewrites only the buckets it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from wardline.functions import columns as c
from wardline.operators.catalog import PATH, current_tags
from wardline.operators.joins import top_per_key
from wardline.sources.commits import Keyed

VALUES = ("tag", "masking_policy", "abac_policy", "class_date", "last_reviewer", "status", "data_type")
SCHEMA = StructType([
    *(StructField(n, StringType()) for n in (*PATH, *VALUES)),
    StructField("tag_time", TimestampNTZType()), StructField("tag_decision", StringType())])
BUCKETS = 64


def _table(spark: SparkSession, path: str, buckets: int) -> Keyed:
    return Keyed(spark, path, PATH, buckets)


def load(catalog: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store a catalog view, one row per column; of repeated rows the smallest. Rows of columns that are stored already are replaced."""
    none = {"tag_time": F.lit(None).cast("timestamp_ntz"), "tag_decision": F.lit(None).cast("string")}
    rows = top_per_key(catalog.select(*PATH, *VALUES), PATH, [F.col(n) for n in VALUES]).withColumns(none)
    _table(catalog.sparkSession, path, buckets).upsert(rows)


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known columns keep their policies, new ones start with policy 'None'. A write older than the stored one changes nothing."""
    def both(name: str) -> tuple:
        return F.col(f"n.{name}"), F.col(f"o.{name}")

    same = F.lit(True)
    for name in PATH:
        same = same & F.col(f"o.{name}").eqNullSafe(F.col(f"n.{name}"))
    place = [F.struct(f"{side}.tag_time", f"{side}.tag_decision") for side in "no"]
    newer = F.col("n.status").isNotNull() & (F.col("o.tag_time").isNull() | (place[0] > place[1]))
    joined = old.alias("o").join(new.alias("n"), same, "full_outer")
    picked = {n: F.when(newer, both(n)[0]).otherwise(both(n)[1])
              for n in ("tag", "class_date", "last_reviewer", "status", "tag_time", "tag_decision")}
    kept = {n: F.coalesce(both(n)[1], both(n)[0]) for n in PATH} | {
        n: F.coalesce(both(n)[1], F.lit(c.NONE)) for n in ("masking_policy", "abac_policy")} | {
        "data_type": F.col("o.data_type")}
    columns = picked | kept
    return joined.select(*(columns[n].alias(n) for n in SCHEMA.names))


def write_tags(events: DataFrame, path: str, batch: str = "", buckets: int = BUCKETS) -> bool:
    """Put tag events (schema_name, table_name, column_name, tag, user_email, ts, decision_id) into the stored catalog.

    The last event of a column by (ts, decision_id) counts, in whatever batches and order they come, so a repeated batch changes
    nothing; False if a batch of this name was written before. A run that is killed leaves the table as it was.
    """
    last = current_tags(events)
    none = F.lit(None).cast("string")
    rows = last.select(
        *PATH, "tag", none.alias("masking_policy"), none.alias("abac_policy"), F.date_format("ts", "yyyy-MM-dd").alias("class_date"),
        F.col("user_email").alias("last_reviewer"), F.lit("Classified").alias("status"), none.alias("data_type"),
        F.col("ts").cast("timestamp_ntz").alias("tag_time"), F.col("decision_id").alias("tag_decision"))
    shaped = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA.fields))
    return _table(events.sparkSession, path, buckets).upsert(shaped, batch, _merged)


def read(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored catalog, in the shape of the catalog view."""
    return _table(spark, path, buckets).rows(SCHEMA).drop("tag_time", "tag_decision")


def column_metadata(spark: SparkSession, path: str, schema: str, table: str, column: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored entry of one column, from the files of one bucket."""
    return _table(spark, path, buckets).get(SCHEMA, schema, table, column).drop("tag_time", "tag_decision")
