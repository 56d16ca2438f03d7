"""Writes: create-if-absent, append by name, tag write-back, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from wardline.operators.joins import top_per_key
from wardline.schemas import COLUMN_TAG_EVENT, GOVERNANCE_AUDIT
from wardline.sources import commits


def shaped(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema, by name, in its order and with its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _save(df: DataFrame, target: str, mode: str) -> None:
    writer = df.write.mode(mode)
    if "/" in target:
        writer.parquet(target)
    else:
        writer.format("parquet").saveAsTable(target)


def bootstrap(df: DataFrame, schema: StructType, target: str) -> None:
    """Create the table with these rows if it does not exist; leave an existing one alone."""
    _save(shaped(df, schema), target, "ignore")


def append(df: DataFrame, schema: StructType, target: str) -> None:
    """Append by column name, in one job."""
    _save(shaped(df, schema), target, "append")


def append_audit(audit: DataFrame, target: str, batch: str | None = None) -> bool:
    """Append audit rows to the stored log, each decision id once: a batch or a row that is there already adds nothing.

    A path is a log of named batches (see ``commits``). A table of the session catalog remembers no batches: its ids are read.
    """
    rows = shaped(audit, GOVERNANCE_AUDIT)
    if "/" in target:
        return commits.append_once(rows, target, batch)
    name = "governance_decision_id"
    known = audit.sparkSession.table(target).select(name)
    new = top_per_key(rows, [name], [F.col(n) for n in rows.columns]).join(known, name, "left_anti")
    append(new, GOVERNANCE_AUDIT, target)
    return True


def stored_audit(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the stored log, as they are."""
    return commits.logged(spark, target, GOVERNANCE_AUDIT).drop("day") if "/" in target else spark.table(target)


def append_tag_events(events: DataFrame, target: str) -> None:
    append(events, COLUMN_TAG_EVENT, target)


def with_outcome(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tag events with ``outcome``: WRITTEN, or why the write can't be done (no tag, or no such column)."""
    path = ["schema_name", "table_name", "column_name"]
    known = inventory.select(*path).distinct().withColumn("__known", F.lit(True))
    blank = F.coalesce(F.length(F.trim("tag")), F.lit(0)) == 0
    outcome = F.when(blank, "FAILED: no tag").when(F.col("__known").isNull(), "FAILED: no such column").otherwise("WRITTEN")
    return events.join(known, path, "left").withColumn("outcome", outcome).drop("__known")


def write_tags(events: DataFrame, inventory: DataFrame, target: str) -> DataFrame:
    """Append the events that can be written and return the others, with their outcome."""
    judged = with_outcome(events, inventory)
    append_tag_events(judged.filter(F.col("outcome") == "WRITTEN"), target)
    return judged.filter(F.col("outcome") != "WRITTEN")


def comment_column(spark: SparkSession, table: str, column: str, tag: str) -> None:
    """Show the tag as the column comment, where the catalog has no tags of its own."""
    text = tag.replace("\\", "\\\\").replace("'", "\\'")

    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    place = ".".join(quoted(part) for part in table.split("."))
    spark.sql(f"ALTER TABLE {place} ALTER COLUMN {quoted(column)} COMMENT '{text}'")


CSV = {"header": True, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def export_csv(df: DataFrame, path: str) -> None:
    """A CSV folder with headers, written by all tasks; nested columns become JSON text.

    As in any CSV, missing and empty texts look the same.
    """
    nested = (ArrayType, MapType, StructType)
    flat = df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
    flat.write.mode("errorifexists").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)
