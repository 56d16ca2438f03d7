"""Figures on the seed rows, worked out by hand."""

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardline.operators import audit as log
from wardline.operators import catalog as cat
from wardline.operators import decide, queue, questions, report
from wardline.sources import seeds, tables

AS_OF = datetime(2026, 7, 30, 12, 0, 0)


@pytest.fixture(scope="module")
def items(spark):
    return seeds.classification_items(spark, AS_OF).cache()


@pytest.fixture(scope="module")
def audit(spark):
    return seeds.governance_audit(spark, AS_OF).cache()


@pytest.fixture(scope="module")
def entries(spark):
    return seeds.catalog_entries(spark).cache()


def test_dashboard(items, audit):
    row = report.dashboard(items, audit).first()
    assert (row.pending_count, row.approved_count, row.rejected_count) == (6, 2, 0)
    assert (row.auto_classified, row.classified_cols) == (3, 20)
    assert (row.pii_count, row.phi_count, row.other_count) == (1, 3, 146)
    assert row.coverage_pct == pytest.approx(20 / 150 * 100)
    assert row.ai_accuracy == pytest.approx(2 / 3)
    assert row.modify_override_pct == pytest.approx(100 / 3)
    assert row.non_approval_pct == pytest.approx(100 - 200 / 3)


def test_empty_inputs_give_zeros(items, audit):
    row = report.dashboard(items.limit(0), audit.limit(0)).first()
    assert (row.pending_count, row.total_decisions, row.ai_accuracy, row.non_approval_pct) == (0, 0, 0.0, 0.0)
    assert cat.explorer_totals(items.limit(0).withColumn("tag", F.col("suggested_tag"))).first().classified_pct == 0.0


def test_pending_by(items):
    assert rows(report.pending_by(items, "schema_name")) == [("brz", 6)]
    assert rows(report.pending_by(items, "category")) == [("Financial", 2), ("PHI", 3), ("PII", 1)]


def test_explorer_after_fill(entries):
    row = cat.explorer_totals(cat.filled_tags(entries)).first()
    assert (row.total_columns, row.pii_columns, row.phi_columns, row.financial_columns) == (11, 5, 4, 2)
    assert row.classified_pct == 100.0
    filled = cat.filled_tags(entries).filter("table_name = 'classification_results'").first()
    assert (filled.tag, filled.status) == ("pii:name", "Unclassified")


def test_search(entries):
    assert cat.search(entries, "phone").count() == 1
    assert cat.search(entries, "PHI").count() == 5  # tags, and one table name
    assert cat.search(entries, "").count() == 11
    assert cat.column_metadata(entries, "brz", "claims_billing_phi", "patient_id").first().masking_policy == "MASK_PATIENT_ID"


def test_alerts_and_links(items):
    assert queue.alerts(items).count() == 0
    links = rows(queue.similar_links(items), "id", "linked_id", "already_reviewed")
    assert links == [("req-cbp-001", "req-hpf-003", False), ("req-hpf-003", "req-cbp-001", False)]
    left = queue.similar_links(items.filter("id <> 'req-hpf-003'"))
    assert rows(left, "id", "linked_id", "already_reviewed") == [("req-cbp-001", None, True)]


def test_display_rows(items, audit):
    first = queue.display_rows(items).filter("ID = 'req-cbp-001'").first()
    assert first["Submitted"] == "2026-07-30 10:00"
    shown = log.display_rows(log.history(audit)).first()
    assert (shown["Decision ID"], shown["AI Confidence"], shown["Timestamp"]) == ("GD-10494", "85%", "2026-07-28 12:00:00")


def test_audit_filters(audit):
    assert log.filter_audit(audit, reviewers=["steward@enterprise.com"]).count() == 2
    assert log.filter_audit(audit, decisions=["MODIFY"], schemas=["hr_db"]).count() == 1
    assert log.filter_audit(audit, keyword="ICD|base_").count() == 2
    assert log.filter_audit(audit, keyword="icd|base_", literal=True).count() == 0
    row = log.summary(audit).first()
    assert (row.total_records, row.approvals, row.rejections, row.modifications) == (3, 2, 0, 1)


def test_queue_filters(items):
    approved = items.withColumn("status", F.when(F.col("id") == "req-cbp-001", "APPROVED").otherwise(F.col("status")))
    assert queue.filter_queue(approved).count() == 5
    assert queue.filter_queue(approved, statuses=()).count() == 6
    assert queue.filter_queue(approved, column_pattern="PATIENT_id$").count() == 1
    assert queue.filter_queue(approved, column_pattern="(", literal=True).count() == 0
    assert queue.filter_queue(items, min_confidence=0.95).count() == 3
    assert queue.by_id(items, "req-hpf-001").count() == 1


def test_context_summary(items, entries, audit):
    found = {(r.section, r.key): r.value for r in questions.context_summary(items, entries, audit).collect()}
    assert found[("pending", "PHI")] == "3"
    assert found[("catalog", "unclassified")] == "1"
    assert found[("recent", "GD-10494")].endswith("MODIFY hr_db.salaries.base_rate -> tag: financial:salary (confidence: 85%)")


def test_review_time(audit):
    row = report.average_review_seconds(audit).first()
    assert (row.n_timed, row.avg_review_seconds) == (3, 44.0)


def test_audit_history_decodes_text(spark, audit):
    stored = audit.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"))
    as_of = F.lit("2026-07-30 12:00:00").cast("timestamp_ntz")
    assert [r.id for r in tables.audit_history(stored, as_of).collect()] == ["aud-003", "aud-002", "aud-001"]


def test_decide_on_seed(spark, items):
    as_of = F.lit("2026-07-30 12:00:00").cast("timestamp_ntz")
    ids = items.filter("category = 'PHI'")
    made = decide.bulk_approve(items, ids, "steward@enterprise.com", as_of)
    state = decide.apply_decisions(items, made)
    assert rows(state.groupBy("status").count()) == [("APPROVED", 3), ("PENDING", 3)]
    events = decide.tag_events(decide.to_audit(items, made))
    assert events.count() == 3
    assert decide.accepted(decide.bulk_approve(items, ids, "engineer@enterprise.com", as_of)).count() == 0


def test_schema_events_and_restored_fields(spark, items):
    assert rows(seeds.schema_events(spark), "event_id", "event_type") == [
        ("EVT-8092", "SCHEMA_CHANGE"), ("EVT-8093", "NEW_DATA_INGESTION")]
    row = items.filter("id = 'req-cbp-002'").first()
    assert (row.ontology_match, row.concept_match) == ("Monetary Dollar Value", "Adjudicated Claim Charge")
    assert [e.timestamp for e in row.governance_timeline] == ["2026-07-27 12:00", "2026-07-30 08:00"]
