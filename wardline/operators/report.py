"""Figures for dashboard and reports. Each one is an aggregation with partial results on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import reference_data as ref
from wardline.operators import audit as log
from wardline.operators import catalog as cat
from wardline.operators.joins import top_per_key
from wardline.operators.queue import pending


def _n() -> Column:
    return F.count(F.lit(1))


def tag_has(word: str, column: str = "suggested_tag") -> Column:
    return F.lower(F.col(column)).contains(word)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def item_counts(items: DataFrame, threshold: float = ref.AUTO_APPROVAL) -> DataFrame:
    status = F.col("status")
    return items.agg(
        _n().alias("total_items"),
        F.count_if(status == "PENDING").alias("pending_count"),
        F.count_if(status == "APPROVED").alias("approved_items"),
        F.count_if(status == "REJECTED").alias("rejected_items"),
        F.count_if(F.col("confidence_score") >= threshold).alias("auto_classified"),
        F.count_if(tag_has("pii")).alias("pii_count"),
        F.count_if(tag_has("phi")).alias("phi_count"),
    )


def audit_counts(audit: DataFrame) -> DataFrame:
    decision = F.col("decision")
    return audit.agg(
        _n().alias("total_decisions"),
        F.count_if(decision == "APPROVE").alias("approve_decisions"),
        F.count_if(decision == "REJECT").alias("reject_decisions"),
        F.count_if(decision == "MODIFY").alias("modify_decisions"),
    )


def counts(items: DataFrame, audit: DataFrame, threshold: float = ref.AUTO_APPROVAL) -> DataFrame:
    """All counts of queue and log as one row: two one-row frames, stacked and summed."""
    both = item_counts(items, threshold).unionByName(audit_counts(audit), allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in both.columns])


ITEM_FIGURES = ("pending_count", "approved_items", "auto_classified", "classified_cols", "pii_count", "phi_count",
                "coverage_pct", "other_count")
AUDIT_FIGURES = ("total_decisions", "ai_accuracy", "modify_override_pct", "non_approval_pct")


def _item_columns(base_classified: int, total_columns: int) -> dict[str, Column]:
    classified = F.col("approved_items") + base_classified
    return {
        "classified_cols": classified,
        "coverage_pct": classified / F.lit(total_columns) * 100,
        "other_count": F.lit(total_columns).cast("long") - F.col("pii_count") - F.col("phi_count"),
    }


def _audit_columns() -> dict[str, Column]:
    approvals = share(F.col("approve_decisions"), F.col("total_decisions"))
    return {
        "ai_accuracy": approvals,
        "modify_override_pct": share(F.col("modify_decisions"), F.col("total_decisions")) * 100,
        "non_approval_pct": F.when(F.col("total_decisions") > 0, 100 - approvals * 100).otherwise(0.0),
    }


def item_figures(items: DataFrame, threshold: float = ref.AUTO_APPROVAL, base_classified: int = ref.BASE_CLASSIFIED,
                 total_columns: int = ref.TOTAL_COLUMNS) -> DataFrame:
    """Figures that need the queue alone."""
    found = item_counts(items, threshold).withColumns(_item_columns(base_classified, total_columns))
    return found.select(*ITEM_FIGURES)


def audit_figures(audit: DataFrame) -> DataFrame:
    """Figures that need the log alone."""
    return audit_counts(audit).withColumns(_audit_columns()).select(*AUDIT_FIGURES)


def dashboard(items: DataFrame, audit: DataFrame, threshold: float = ref.AUTO_APPROVAL,
              base_classified: int = ref.BASE_CLASSIFIED, total_columns: int = ref.TOTAL_COLUMNS) -> DataFrame:
    """The figures of dashboard and report page in one row. Approvals and rejections count items and log together."""
    both = counts(items, audit, threshold).withColumns(
        {
            **_item_columns(base_classified, total_columns),
            **_audit_columns(),
            "approved_count": F.col("approved_items") + F.col("approve_decisions"),
            "rejected_count": F.col("rejected_items") + F.col("reject_decisions"),
        }
    )
    return both.select(*ITEM_FIGURES, *AUDIT_FIGURES, "approved_count", "rejected_count")


def _as_rows(df: DataFrame, label: str, pairs: dict[str, str]) -> DataFrame:
    """Turn named columns of a one-row frame into (label, n) rows."""
    entries = F.array(*[F.struct(F.lit(k).alias(label), F.col(v).alias("n")) for k, v in pairs.items()])
    return df.select(F.explode(entries).alias("entry")).select(f"entry.{label}", "entry.n")


def status_distribution(items: DataFrame, audit: DataFrame) -> DataFrame:
    return _as_rows(dashboard(items, audit), "status",
                    {"Pending": "pending_count", "Approved": "approved_count", "Rejected": "rejected_count"})


def sensitivity_distribution(items: DataFrame, total_columns: int = ref.TOTAL_COLUMNS) -> DataFrame:
    found = item_figures(items, total_columns=total_columns)
    return _as_rows(found, "sensitivity", {"PII": "pii_count", "PHI": "phi_count", "Other": "other_count"})


def pending_by(items: DataFrame, *columns: str) -> DataFrame:
    return pending(items).groupBy(*columns).agg(_n().alias("n_pending"))


def decisions_per_day(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.to_date("timestamp").alias("day")).agg(_n().alias("n_decisions"))


def first_pending(items: DataFrame, n: int = 3) -> DataFrame:
    return pending(items).orderBy("submitted_time", "id").limit(n)


def decision_text() -> Column:
    """One decision as a line of text."""
    return F.concat(
        F.lit("["), c.minute_text("timestamp"), F.lit("] "), F.col("user_email"), F.lit(" "), F.col("decision"),
        F.lit(" "), c.qualified("schema_name", "table_name", "column_name"), F.lit(" -> tag: "), F.col("new_tag"),
        F.lit(" (confidence: "), c.percent_text("confidence_score", 0), F.lit(")"),
    )


def notifications(items: DataFrame, n_alerts: int = 2, n_pending: int = 4, n_approved: int = 2) -> DataFrame:
    """The heads of three lists, oldest first, from one pass: a row is sent once for each list whose head it may be in."""
    is_pending = F.col("status") == "PENDING"
    sections = F.filter(
        F.array(
            F.when(is_pending & (F.col("confidence_score") < ref.ALERT_BELOW), F.lit("alert")),
            F.when(is_pending, F.lit("pending")),
            F.when(F.col("status") == "APPROVED", F.lit("approved")),
        ),
        lambda s: s.isNotNull(),
    )
    shown = ["id", "table_name", "column_name", "suggested_tag", "confidence_score"]
    listed = items.select(F.explode(sections).alias("section"), "submitted_time", *shown)
    most = {"alert": n_alerts, "pending": n_pending, "approved": n_approved}
    heads = top_per_key(listed, ["section"], [F.asc("submitted_time"), F.asc("id")], max(most.values()), "__rank")
    wanted = F.try_element_at(c.literal_map(most), F.col("section"))
    return heads.filter(F.col("__rank") <= wanted).select("section", *shown)


def average_review_seconds(audit: DataFrame) -> DataFrame:
    spent = c.seconds("approval_duration")
    return audit.agg(
        F.count(spent).alias("n_timed"), F.round(F.avg(spent), 6).alias("avg_review_seconds"),
    )


def highest_risk_schema(items: DataFrame, n: int = 1) -> DataFrame:
    urgent = pending(items).filter(F.col("priority").isin("Critical", "High"))
    return urgent.groupBy("schema_name").agg(_n().alias("n_urgent")).orderBy(F.desc("n_urgent"), "schema_name").limit(n)


def confidence_histogram(items: DataFrame, bins: int = 20) -> DataFrame:
    low = F.floor(F.col("confidence_score") * bins) / bins
    return items.groupBy(low.alias("bin_low")).agg(_n().alias("n_items"))


def top_tags(items: DataFrame, k: int = 10) -> DataFrame:
    per_tag = items.groupBy("suggested_tag").agg(_n().alias("n_items"))
    return per_tag.orderBy(F.desc("n_items"), "suggested_tag").limit(k)


def list_sizes(catalog: DataFrame, audit: DataFrame, items: DataFrame, query: str, decisions: Sequence[str]) -> DataFrame:
    """Sizes of four lists: search hits, hidden unclassified columns, filtered audit rows, notifications.

    Each source is read once; all its sizes are counts of conditions.
    """
    from_catalog = cat.explorer_masks(catalog).agg(
        F.count_if(cat.search_hit(query)).alias("search_hits"), F.count_if("is_unclassified").alias("hidden_unclassified"))
    from_log = audit.agg(F.count_if(F.col("decision").isin(*decisions)).alias("audit_rows"))
    from_items = items.agg(F.count_if(F.col("status") == "PENDING").alias("notifications"))
    out = None
    for df in (from_catalog, from_log, from_items):
        part = df.unpivot([], df.columns, "list", "n")
        out = part if out is None else out.unionByName(part)
    return out


def recent_decision_lines(audit: DataFrame, n: int = 5) -> DataFrame:
    return log.recent(audit, n).select("governance_decision_id", "timestamp", decision_text().alias("line"))
