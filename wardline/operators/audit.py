"""The audit log: order, filters, display rows, summary, change history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.operators.joins import top_per_key
from wardline.operators.queue import one_of

NEWEST = ("timestamp", "governance_decision_id")


def newest_first() -> list[Column]:
    return [F.desc(n) for n in NEWEST]


def decode(raw: DataFrame, as_of: Column) -> DataFrame:
    """Stored log rows to typed ones: the time text becomes a timestamp."""
    return raw.withColumn("timestamp", c.audit_time("timestamp", as_of))


def history(audit: DataFrame) -> DataFrame:
    return audit.orderBy(*newest_first())


def filter_audit(audit: DataFrame, reviewers: Sequence[str] = (), decisions: Sequence[str] = (),
                 schemas: Sequence[str] = (), methods: Sequence[str] = (), keyword: str = "",
                 literal: bool = False) -> DataFrame:
    test = one_of({"user_email": reviewers, "decision": decisions, "schema_name": schemas,
                   "approval_method": methods})
    if keyword:
        word = keyword.lower()
        found = F.lit(False)
        for name in ("column_name", "table_name", "comments"):
            low = F.lower(F.coalesce(F.col(name), F.lit("")))
            found = found | (low.contains(word) if literal else low.rlike(word))
        test = test & found
    return audit.filter(test)


def display_rows(audit: DataFrame) -> DataFrame:
    return audit.select(
        F.col("governance_decision_id").alias("Decision ID"),
        c.second_text("timestamp").alias("Timestamp"),
        F.col("user_email").alias("Reviewer"),
        F.col("schema_name").alias("Schema"),
        F.col("table_name").alias("Table"),
        F.col("column_name").alias("Column"),
        c.dash_if_empty("previous_tag").alias("Previous Tag"),
        c.dash_if_empty("new_tag").alias("New Tag"),
        F.col("ai_recommendation").alias("AI Suggestion"),
        c.percent_text("confidence_score", 0).alias("AI Confidence"),
        F.col("decision").alias("Decision"),
        F.col("approval_duration").alias("Duration"),
        F.col("approval_method").alias("Method"),
        c.dash_if_empty("comments").alias("Comments"),
    )


def summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("decision") == "APPROVE").alias("approvals"),
        F.count_if(F.col("decision") == "REJECT").alias("rejections"),
        F.count_if(F.col("decision") == "MODIFY").alias("modifications"),
    )


def once(audit: DataFrame) -> DataFrame:
    """The log with one row per decision id: a repeated append leaves no trace."""
    return top_per_key(audit, ["governance_decision_id"], [F.asc("timestamp")])


def with_new(audit: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new rows. A row that is already there (same decision id) is not added twice.

    The order comes from ``history``, not from the position.
    """
    return once(audit.unionByName(new))


def table_changes(audit: DataFrame, tables: Sequence[str] = (), limit: int = 10) -> DataFrame:
    """The newest changes of each table (all tables if none are named)."""
    chosen = audit.filter(one_of({"table_name": tables}))
    return top_per_key(chosen, ["schema_name", "table_name"], newest_first(), limit, "change_number")


def recent(audit: DataFrame, n: int, decision: str | None = None) -> DataFrame:
    """The newest ``n`` rows, of one kind of decision if given."""
    rows = audit if decision is None else audit.filter(F.col("decision") == decision)
    return rows.orderBy(*newest_first()).limit(n)
