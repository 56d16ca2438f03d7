"""Steward decisions: permission, action, state, timeline, audit rows and tag writes.

The decision log is append-only and the state of an item is a fold over it, so running a job twice is harmless.
Decisions carry: decision_key, <key of the item>, timestamp, user_email, action, steward_tag, comments,
approval_duration, approval_method.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import reference_data as ref
from wardline.operators.joins import running_last, top_per_key
from wardline.operators.queue import pending, selected

ORDER = ["timestamp", "governance_decision_id"]


def with_permission(df: DataFrame, permission: str | Column = "approve_reject") -> DataFrame:
    """Add role and allowed, from the e-mail address. Unknown roles and permissions are not allowed.

    The role matrix is a constant inside the expression, so there is no join.
    """
    wanted = F.lit(permission) if isinstance(permission, str) else permission
    granted = c.literal_map({f"{role}|{p}": True for role, given in ref.GRANTED.items() for p in given})
    asked = df.withColumn("role", c.role_of("user_email")).withColumn("permission", wanted)
    cell = F.try_element_at(granted, F.concat_ws("|", "role", "permission"))
    return asked.withColumn("allowed", F.coalesce(cell, F.lit(False)))


def accepted(decisions: DataFrame) -> DataFrame:
    return with_permission(decisions).filter("allowed").drop("role", "permission", "allowed")


def refused(decisions: DataFrame) -> DataFrame:
    return with_permission(decisions).filter("not allowed")


def resolved(decisions: DataFrame) -> DataFrame:
    """Add what each action means, and the decision id. Actions without effect have no status_after."""
    known = [a for a in ref.ACTIONS if a.status]

    def meaning(field: str) -> Column:
        return F.try_element_at(c.literal_map({a.action: getattr(a, field) for a in known}), F.col("action"))

    return decisions.withColumns(
        {
            "status_after": meaning("status"),
            "decision": meaning("decision"),
            "keeps_tag": F.coalesce(meaning("keeps_tag"), F.lit(False)),
            "writes_back": F.coalesce(meaning("writes_back"), F.lit(False)),
            "governance_decision_id": c.decision_id("decision_key", "user_email"),
        }
    )


def changing(decisions: DataFrame) -> DataFrame:
    """Permitted decisions that change something, as often as they come; works on a stream too."""
    return resolved(accepted(decisions)).filter(F.col("status_after").isNotNull())


def effective(decisions: DataFrame, unique: bool = False) -> DataFrame:
    """Permitted decisions that change something, each decision id once.

    ``unique`` says that the log holds each id once already, as one that ``append_once`` fills; then nothing is sorted. A log that holds a decision twice gives what it gives without the repetition. Of rows that share an id but differ, the
    smallest one counts; the choice is made before the shuffle as far as rows of an id are in one task.
    """
    rows = changing(decisions)
    return rows if unique else top_per_key(rows, ["governance_decision_id"], [F.col(n) for n in rows.columns])


def no_op(decisions: DataFrame) -> DataFrame:
    """Permitted decisions whose action changes nothing."""
    return resolved(accepted(decisions)).filter(F.col("status_after").isNull())


def new_steward_tag() -> Column:
    """The tag a decision sets, NULL if it leaves the tag alone."""
    return F.expr("CASE WHEN keeps_tag AND steward_tag <> '' THEN steward_tag END")


def fold_parts(decisions: DataFrame, key: str = "id") -> DataFrame:
    """Last decision, last tag and number per item, from changing decisions with each id once. Parts of a log add up."""
    place = [F.col(n) for n in ORDER]
    tag = new_steward_tag()
    return decisions.groupBy(key).agg(
        F.max(F.struct(*place, F.col("status_after"), F.col("user_email"))).alias("last"),
        F.max(F.when(tag.isNotNull(), F.struct(*place, tag.alias("tag")))).alias("last_tag"),
        F.count(F.lit(1)).alias("n_decisions"),
    )


def added_parts(some: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    return some.unionByName(more).groupBy(key).agg(
        F.max("last").alias("last"), F.max("last_tag").alias("last_tag"), F.sum("n_decisions").alias("n_decisions"))


def from_parts(parts: DataFrame, key: str = "id") -> DataFrame:
    return parts.select(
        key,
        F.col("last.status_after").alias("decided_status"),
        F.col("last_tag.tag").alias("decided_tag"),
        F.col("last.timestamp").alias("decided_at"),
        F.col("last.user_email").alias("decided_by"),
        "n_decisions",
    )


def fold(decisions: DataFrame, key: str = "id", unique: bool = False) -> DataFrame:
    """Last status and last tag per item. One aggregation with partial results, so hot items shrink first."""
    return from_parts(fold_parts(effective(decisions, unique), key), key)


def with_state(queue: DataFrame, folded: DataFrame, key: str = "id") -> DataFrame:
    """Queue with the decided status and tag. Both sides have one row per item, so the join cannot be skewed."""
    joined = queue.join(folded, key, "left")
    return joined.withColumns(
        {
            "status": F.coalesce("decided_status", "status"),
            "suggested_tag": F.coalesce("decided_tag", "suggested_tag"),
            "n_decisions": F.coalesce("n_decisions", F.lit(0).cast("long")),
        }
    ).drop("decided_status", "decided_tag")


def apply_decisions(queue: DataFrame, decisions: DataFrame, key: str = "id", unique: bool = False) -> DataFrame:
    """Queue with the state that the decisions give."""
    return with_state(queue, fold(decisions, key, unique), key)


def unknown_items(queue: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Effective decisions on items that the queue does not hold."""
    return effective(decisions).join(queue.select(key), key, "left_anti")


def timeline(queue: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """The governance timeline as rows: two entries per item at the start, one or three per decision.

    Rows instead of a growing array, so an item with very many decisions needs no large row.
    """
    columns = [key, "event_time", "governance_decision_id", "step", "stage"]

    def listed(df: DataFrame, stages: Column) -> DataFrame:
        return df.select("*", F.posexplode(stages).alias("step", "stage")).select(*columns)

    start = queue.select(
        key, F.col("submitted_time").alias("event_time"), F.lit("").alias("governance_decision_id")
    )
    known = effective(decisions).withColumnRenamed("timestamp", "event_time").join(queue.select(key), key, "left_semi")
    decided = F.concat(F.lit(ref.STAGE_DECISION), F.col("status_after"))
    applied = [F.lit(s) for s in ref.STAGES_APPROVED]
    stages = F.when(F.col("status_after") == "APPROVED", F.array(decided, *applied)).otherwise(F.array(decided))
    first = F.array(F.lit(ref.STAGE_DISCOVERED), F.lit(ref.STAGE_CLASSIFIED))
    return listed(start, first).unionByName(listed(known, stages))


def to_audit(queue: DataFrame, decisions: DataFrame, key: str = "id", unique: bool = False) -> DataFrame:
    """One audit row per effective decision on a known item.

    previous_tag is the tag in force just before the decision; an approval without a tag of its own confirms it.
    """
    steps = running_last(effective(decisions, unique), key, *ORDER, new_steward_tag(), "__before")
    items = queue.select(
        key, "schema_name", "table_name", "column_name", F.col("suggested_tag").alias("ai_recommendation"),
        "confidence_score",
    )
    return _audit_rows(steps.join(items, key).withColumn("previous_tag", F.coalesce("__before", "ai_recommendation")))


def _audit_rows(rows: DataFrame) -> DataFrame:
    """Audit rows from resolved decisions that carry their item's columns and previous_tag."""
    kept = F.coalesce(new_steward_tag(), F.col("previous_tag"))
    return rows.select(
        c.audit_id("decision_key").alias("id"),
        "governance_decision_id",
        "timestamp",
        "user_email",
        "schema_name",
        "table_name",
        "column_name",
        "previous_tag",
        F.when(F.col("keeps_tag"), kept).otherwise(F.lit(c.NONE)).alias("new_tag"),
        "decision",
        "comments",
        "ai_recommendation",
        "confidence_score",
        F.coalesce("approval_duration", F.lit(ref.DEFAULT_DURATION)).alias("approval_duration"),
        F.coalesce("approval_method", F.lit(ref.DEFAULT_METHOD)).alias("approval_method"),
        F.lit(ref.DEFAULT_SOURCE).alias("approval_source"),
    )


def tag_events(audit: DataFrame) -> DataFrame:
    """The tag writes that follow from audit rows: approvals and modifications."""
    return audit.filter(F.col("decision").isin("APPROVE", "MODIFY")).select(
        "schema_name", "table_name", "column_name", F.col("new_tag").alias("tag"), "user_email",
        F.col("timestamp").alias("ts"), F.col("governance_decision_id").alias("decision_id"),
    )


def item_timeline(queue: DataFrame, decisions: DataFrame, key: str = "id", last: int = 10) -> DataFrame:
    """The item's last ``last`` timeline entries, oldest first, as an array of (event_time, stage), beside its state.

    The entries are picked by rank before the shuffle, so an item with very many decisions sends no more than that.
    """
    newest = [F.desc("event_time"), F.desc("governance_decision_id"), F.desc("step")]
    entries = top_per_key(timeline(queue, decisions, key), [key], newest, last, "__rank")
    listed = entries.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("__rank")).alias("place"), "event_time", "stage"))).alias("__entries"))
    history = F.transform("__entries", lambda e: F.struct(e["event_time"].alias("event_time"), e["stage"].alias("stage")))
    state = apply_decisions(queue, decisions, key)
    return state.join(listed, key, "left").withColumn("governance_timeline", history).drop("__entries")


def bulk_audit(items: DataFrame, verdict: str, email: str, as_of: Column, key: str = "id") -> DataFrame:
    """Audit rows of one bulk decision on the selected items, straight from the items: ``verdict`` is approve or reject.

    Each item has one new decision and its present tag before it, so nothing needs to be joined.
    """
    made = (bulk_approve if verdict == "approve" else bulk_reject)
    own = ["schema_name", "table_name", "column_name", "suggested_tag", "confidence_score"]
    rows = made(items, None, email, as_of, key, own).withColumnRenamed("suggested_tag", "ai_recommendation")
    return _audit_rows(changing(rows).withColumn("previous_tag", F.col("ai_recommendation")))


def _as_decisions(items: DataFrame, key: str, prefix: str, action: str, email: str, as_of: Column, method: str,
                  comments: str | None, tag: Column, keep: Sequence[str] = ()) -> DataFrame:
    name = F.concat_ws("-", F.lit(prefix), F.col(key).cast("string"), c.second_text(as_of))
    return items.select(
        name.alias("decision_key"),
        key,
        as_of.alias("timestamp"),
        F.lit(email).alias("user_email"),
        F.lit(action).alias("action"),
        tag.cast("string").alias("steward_tag"),
        F.lit(comments).cast("string").alias("comments"),
        F.lit(None).cast("string").alias("approval_duration"),
        F.lit(method).alias("approval_method"),
        *keep,
    )


def bulk_approve(queue: DataFrame, ids: DataFrame | None, email: str, as_of: Column, key: str = "id",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Decisions that approve every selected item (all, without ``ids``) with its present tag. ``keep`` names item columns."""
    return _as_decisions(queue if ids is None else selected(queue, ids, key), key, "bulk-approve", "Approve Recommendation", email, as_of,
                         ref.BULK_METHOD, ref.BULK_COMMENTS["APPROVE"], F.col("suggested_tag"), keep)


def bulk_reject(queue: DataFrame, ids: DataFrame | None, email: str, as_of: Column, key: str = "id",
                keep: Sequence[str] = ()) -> DataFrame:
    """Decisions that reject every selected item (all, without ``ids``); no tag is written."""
    return _as_decisions(queue if ids is None else selected(queue, ids, key), key, "bulk-reject", "Reject Recommendation", email, as_of,
                         ref.BULK_METHOD, ref.BULK_COMMENTS["REJECT"], F.lit(None), keep)


AUTO_EMAIL = "auto-steward@system"
AUTO_METHOD = "Auto Approval"


def auto_approve(queue: DataFrame, as_of: Column, threshold: float = ref.AUTO_APPROVAL, key: str = "id") -> DataFrame:
    """Decisions that approve every pending item at or above the threshold."""
    items = pending(queue).filter(F.col("confidence_score") >= threshold)
    return _as_decisions(items, key, "auto", "Approve Recommendation", AUTO_EMAIL, as_of, AUTO_METHOD, None,
                         F.col("suggested_tag"))
