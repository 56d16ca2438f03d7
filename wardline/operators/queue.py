"""The review queue: filters, lookups, alerts, links and display rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import reference_data as ref
from wardline.operators.joins import top_per_key


def one_of(choices: dict[str, Sequence]) -> Column:
    """AND over 'column is one of the chosen values'; an empty choice does not restrict."""
    test = F.lit(True)
    for name, values in choices.items():
        if values:
            test = test & F.col(name).isin(*values)
    return test


def matches(column: Column | str, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive search for a regular expression, or for plain text if ``literal``."""
    value = c.as_column(column)
    return F.lower(value).contains(pattern.lower()) if literal else value.rlike(f"(?i){pattern}")


def filter_queue(queue: DataFrame, schemas: Sequence[str] = (), priorities: Sequence[str] = (),
                 domains: Sequence[str] = (), categories: Sequence[str] = (), statuses: Sequence[str] = ("PENDING",),
                 column_pattern: str = "", min_confidence: float = 0.0, literal: bool = False) -> DataFrame:
    test = one_of({"schema_name": schemas, "priority": priorities, "domain": domains, "category": categories,
                   "status": statuses})
    if column_pattern:
        test = test & matches("column_name", column_pattern, literal)
    return queue.filter(test & (F.col("confidence_score") >= min_confidence))


def by_id(queue: DataFrame, item_id: str | Column) -> DataFrame:
    return queue.filter(F.col("id") == item_id)


def pending(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("status") == "PENDING")


def alerts(queue: DataFrame, below: float = ref.ALERT_BELOW) -> DataFrame:
    return pending(queue).filter(F.col("confidence_score") < below)


def selected(queue: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Queue rows whose key was chosen. The chosen keys are made distinct first, with partial counts."""
    return queue.join(ids.select(key).distinct(), key, "left_semi")


def display_rows(queue: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return queue.select(
        *keep,
        F.col("id").alias("ID"),
        F.col("schema_name").alias("Schema"),
        F.col("table_name").alias("Table"),
        F.col("column_name").alias("Column"),
        F.col("suggested_tag").alias("Suggested Tag"),
        F.col("confidence_score").alias("Confidence"),
        F.col("priority").alias("Priority"),
        F.col("category").alias("Category"),
        F.col("domain").alias("Domain"),
        F.col("status").alias("Status"),
        c.minute_text("submitted_time").alias("Submitted"),
    )


def similar_links(queue: DataFrame) -> DataFrame:
    """Each similar column of each item with the queue item behind it; none means it was already reviewed."""
    links = queue.select("id", F.explode("similar_columns_metrics").alias("similar")).select(
        "id", F.col("similar.name").alias("name"), F.col("similar.similarity").alias("similarity")
    )
    paths = queue.select(
        c.qualified("schema_name", "table_name", "column_name").alias("name"), F.col("id").alias("linked_id")
    )
    targets = top_per_key(paths, ["name"], [F.asc("linked_id")])
    joined = links.join(targets, "name", "left")
    return joined.withColumn("already_reviewed", F.col("linked_id").isNull())


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns as (facet, value) rows, from one scan."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in columns])
    return df.select(F.explode(pairs).alias("pair")).select("pair.facet", "pair.value").distinct().orderBy(
        "facet", "value"
    )


QUEUE_FACETS = ("schema_name", "priority", "domain", "category", "status")
AUDIT_FACETS = ("user_email", "decision", "schema_name", "approval_method")
