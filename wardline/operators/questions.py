"""Governance questions: intent, the lists behind the answers, and the context summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import reference_data as ref
from wardline.operators import audit as log
from wardline.operators import catalog as cat
from wardline.operators import report
from wardline.operators.queue import pending


def with_intent(questions: DataFrame) -> DataFrame:
    return questions.withColumn("intent", c.question_intent("question"))


def intent_counts(questions: DataFrame) -> DataFrame:
    return with_intent(questions).groupBy("intent").agg(F.count(F.lit(1)).alias("n_questions"))


def pending_with_tag(queue: DataFrame, word: str) -> DataFrame:
    """Pending items whose tag contains the word, as it is written (no change of case)."""
    return pending(queue).filter(F.col("suggested_tag").contains(word))


def pending_in_category(queue: DataFrame, word: str) -> DataFrame:
    return pending(queue).filter(F.lower("category").contains(word))


def fixed_answers(spark: SparkSession) -> DataFrame:
    """The answers that do not depend on data, as rows (fixed, fewer than 20)."""
    rows = [("approval_sla", name, f"{hours} h") for name, hours in ref.SLA_HOURS.items()]
    rows.append(("approval_sla", "ESCALATED", f"{ref.SLA_ESCALATED_HOURS} h"))
    rows += [("access_policy", tag, policy) for tag, policy in ref.POLICY_ANSWER]
    rows += [("masking", path, policy) for path, policy in ref.MASKING_ANSWER]
    return spark.createDataFrame(rows, "intent string, subject string, answer string")


def answer_sizes(queue: DataFrame, audit: DataFrame, recent: int = 5) -> DataFrame:
    """Number of lines in the answer to each intent: one row per intent (at most nine), from two aggregations."""
    is_pending = F.col("status") == "PENDING"
    tag = F.col("suggested_tag")
    items = queue.agg(
        F.count_if(is_pending & tag.contains("phi")).alias("pending_phi"),
        F.count_if(is_pending & tag.contains("pii")).alias("pending_pii"),
        F.count_if(is_pending & F.lower("category").contains("financial")).alias("pending_financial"),
        F.count_if(is_pending).alias("summary"),
    )
    approvals = audit.agg(
        F.least(F.count_if(F.col("decision") == "APPROVE"), F.lit(recent).cast("long")).alias("recent_approvals")
    )

    def listed(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "intent", "n_lines")

    fixed = fixed_answers(queue.sparkSession).groupBy("intent").agg(F.count(F.lit(1)).alias("n_lines"))
    return listed(items).unionByName(listed(approvals)).unionByName(fixed)


def answered(questions: DataFrame, queue: DataFrame, audit: DataFrame) -> DataFrame:
    """Each question with its intent and the number of lines its answer has; 0 where the answer is session state."""
    sizes = F.broadcast(answer_sizes(queue, audit))  # one row per intent
    return with_intent(questions).join(sizes, "intent", "left").withColumn(
        "n_lines", F.coalesce("n_lines", F.lit(0).cast("long"))
    )


def context_summary(queue: DataFrame, catalog: DataFrame, audit: DataFrame, recent: int = 5) -> DataFrame:
    """The facts an assistant would be given, as (section, key, value) rows."""
    by_category = report.pending_by(queue, "category").select(
        F.lit("pending").alias("section"), F.col("category").alias("key"), F.col("n_pending").cast("string").alias("value")
    )
    totals = cat.catalog_totals(catalog)
    sizes = totals.unpivot([], totals.columns, "key", "value").select(
        F.lit("catalog").alias("section"), "key", F.col("value").cast("string").alias("value")
    )
    lines = log.recent(audit, recent).select(
        F.lit("recent").alias("section"), F.col("governance_decision_id").alias("key"),
        report.decision_text().alias("value"),
    )
    return by_category.unionByName(sizes).unionByName(lines)
