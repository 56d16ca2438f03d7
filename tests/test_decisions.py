"""State, timeline, audit rows, log: ties, no-ops, refusals, unknown items, reruns."""

from conftest import rows
from pyspark.sql import functions as F

from wardline import schemas
from wardline.operators import audit as log
from wardline.operators import catalog as cat
from wardline.operators import decide, monitor, report
from wardline.plans.derived import KEY



def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")

TEXT = ("decision_key string, id string, t string, user_email string, action string, steward_tag string, comments string, "
        "approval_duration string, approval_method string")


def items(spark):
    listed = [("i1", "clinical", "t1", "ssn", "pii:ssn", 0.97, "PII"), ("i2", "clinical", "t1", "mrn", "phi:patient_id", 0.95, "PHI"),
              ("i3", "brz", "t2", "cost", "financial:amount", 0.60, "Financial")]
    df = spark.createDataFrame(listed, "id string, schema_name string, table_name string, column_name string, "
                                       "suggested_tag string, confidence_score double, category string")
    return df.withColumns({"status": F.lit("PENDING"), "submitted_time": F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")})


def decisions(spark, *listed):
    full = [(f"d{n}", i, t, who, action, tag, None, None, None) for n, (i, t, who, action, tag) in enumerate(listed)]
    df = spark.createDataFrame(full, TEXT)
    return df.withColumn("timestamp", F.col("t").cast("timestamp_ntz")).drop("t")


S, E = "steward@x", "engineer@x"
T1, T2, T3 = "2024-01-31 01:00:00", "2024-01-31 02:00:00", "2024-01-31 03:00:00"


def test_last_decision_wins_and_tag_survives(spark):
    made = decisions(spark, ("i1", T2, S, "Escalate for Expert Review", None), ("i1", T1, S, "Modify Classification", "pii:dob"))
    state = decide.apply_decisions(items(spark), made).filter("id = 'i1'").first()
    assert (state.status, state.suggested_tag, state.n_decisions) == ("ESCALATED", "pii:dob", 2)


def test_equal_times_are_settled_by_the_decision_id(spark):
    made = decisions(spark, ("i1", T1, S, "Approve Recommendation", None), ("i1", T1, S, "Reject Recommendation", None))
    by_id = rows(decide.effective(made), "governance_decision_id", "status_after")
    for order in (made, made.orderBy(F.desc("decision_key"))):
        assert decide.apply_decisions(items(spark), order).filter("id = 'i1'").first().status == by_id[-1][1]


def test_no_op_refused_and_unknown_change_nothing(spark):
    made = decisions(spark, ("i1", T1, S, "Save as Draft", None), ("i1", T1, S, "Request Additional Information", None),
                     ("i2", T1, E, "Approve Recommendation", None), ("i9", T1, S, "Approve Recommendation", None),
                     ("i3", T1, S, "Something else", None))
    state = decide.apply_decisions(items(spark), made)
    assert rows(state, "status").count(("PENDING",)) == 3
    assert decide.no_op(made).count() == 3
    assert rows(decide.refused(made), "decision_key", "role") == [("d2", "Data Engineer")]
    assert rows(decide.unknown_items(items(spark), made), "decision_key") == [("d3",)]
    assert decide.to_audit(items(spark), made).count() == 0


def test_merge_counts_as_modify_and_previous_tag_follows_the_state(spark):
    made = decisions(spark, ("i1", T1, S, "Merge with Existing Concept", "pii:dob"), ("i1", T2, S, "Approve Recommendation", None),
                     ("i1", T3, S, "Reject Recommendation", None))
    found = rows(decide.to_audit(items(spark), made), "timestamp", "decision", "previous_tag", "new_tag", "ai_recommendation")
    assert [r[1:] for r in found] == [("MODIFY", "pii:ssn", "pii:dob", "pii:ssn"), ("APPROVE", "pii:dob", "pii:dob", "pii:ssn"),
                                      ("REJECT", "pii:dob", "None", "pii:ssn")]


def test_audit_defaults_and_schema(spark):
    made = decisions(spark, ("i1", T1, S, "Approve Recommendation", None))
    audit = decide.to_audit(items(spark), made)
    row = audit.first()
    assert audit.columns == schemas.GOVERNANCE_AUDIT.names
    assert (row.approval_duration, row.approval_method, row.approval_source) == (
        "30s", "Manual Steward Review", "Steward Portal Workspace UI")
    assert row.governance_decision_id.startswith("GD-") and row.id.startswith("aud-")


def test_timeline_has_three_stages_per_approval(spark):
    made = decisions(spark, ("i1", T1, S, "Approve Recommendation", None), ("i2", T1, S, "Reject Recommendation", None))
    found = decide.timeline(items(spark), made)
    assert rows(found.groupBy("id").count()) == [("i1", 5), ("i2", 3), ("i3", 2)]
    assert rows(found.filter("id = 'i2' and governance_decision_id <> ''"), "stage") == [("Steward Decision: REJECTED",)]


def test_items_carry_their_last_timeline_entries(spark):
    made = decisions(spark, ("i1", T1, S, "Escalate for Expert Review", None), ("i1", T2, S, "Approve Recommendation", None))
    found = {r.id: [e.stage for e in r.governance_timeline] for r in decide.item_timeline(items(spark), made, last=4).collect()}
    assert found["i1"] == ["Steward Decision: ESCALATED", "Steward Decision: APPROVED", "Policy Applied (ABAC & Masking)",
                           "Governed View Updated"]
    assert found["i3"] == ["Column Discovered in Live Catalog", "AI Classified"]


def test_bulk_audit_is_the_audit_of_the_bulk_decisions(spark):
    for verdict, made in (("approve", decide.bulk_approve), ("reject", decide.bulk_reject)):
        direct = decide.bulk_audit(items(spark), verdict, S, as_of())
        by_log = decide.to_audit(items(spark), made(items(spark), items(spark), S, as_of()))
        assert rows(direct) == rows(by_log) and direct.count() == 3
    assert decide.bulk_audit(items(spark), "approve", E, as_of()).count() == 0


def test_roles_have_what_is_granted_and_nothing_else(spark):
    df = spark.createDataFrame([(w, p) for w in ("steward@x", "engineer@x", "y@x") for p in ("approve_reject", "view_audit", "new")],
                               "user_email string, p string")
    allowed = rows(decide.with_permission(df, F.col("p")).filter("allowed"), "user_email", "p")
    assert allowed == [("engineer@x", "view_audit"), ("steward@x", "approve_reject"), ("steward@x", "view_audit"), ("y@x", "view_audit")]


def test_applying_twice_is_applying_once(derived):
    twice = derived.decisions.unionByName(derived.decisions)
    assert rows(decide.apply_decisions(derived.queue, twice, KEY)) == rows(derived.state)
    assert rows(decide.to_audit(derived.queue, twice, KEY)) == rows(derived.audit)
    assert log.with_new(derived.audit, derived.audit).count() == derived.audit.count()


def test_groups_sum_to_the_total(derived):
    total = derived.state.filter("status = 'PENDING'").count()
    for column in ("schema_name", "category", "priority"):
        assert sum(r.n_pending for r in report.pending_by(derived.state, column).collect()) == total
    days = report.decisions_per_day(derived.audit).agg(F.sum("n_decisions")).first()[0]
    assert days == derived.audit.count()


def test_tag_upsert_keeps_policies_of_known_columns(spark):
    known = spark.createDataFrame([("s", "t", "a", "pii:x", "M", "P", "2020-01-01", "r", "Pending Review", "INT")],
                                  schemas.CATALOG_ENTRY)
    events = spark.createDataFrame(
        [("s", "t", "a", "old", "u1", "2024-01-01 00:00:00", "1"), ("s", "t", "a", "new", "u2", "2024-01-02 00:00:00", "2"),
         ("s", "t", "b", "fresh", "u3", "2024-01-03 00:00:00", "3")],
        "schema_name string, table_name string, column_name string, tag string, user_email string, t string, decision_id string",
    ).withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    found = rows(cat.upsert_tags(known, events), "column_name", "tag", "masking_policy", "abac_policy", "class_date",
                 "last_reviewer", "status", "data_type")
    assert found == [("a", "new", "M", "P", "2024-01-02", "u2", "Classified", "INT"),
                     ("b", "fresh", "None", "None", "2024-01-03", "u3", "Classified", None)]


def test_auto_approval(spark):
    made = decide.auto_approve(items(spark), as_of())
    assert rows(decide.apply_decisions(items(spark), made), "id", "status") == [
        ("i1", "APPROVED"), ("i2", "APPROVED"), ("i3", "PENDING")]


def test_deadlines(spark):
    made = decisions(spark, ("i1", "2024-01-31 21:00:00", S, "Escalate for Expert Review", None))
    state = decide.apply_decisions(items(spark), made)
    found = {r.id: (str(r.due_time), r.is_breached) for r in monitor.with_deadline(state, as_of()).collect()}
    assert found == {"i1": ("2024-02-01 01:00:00", False), "i2": ("2024-01-31 00:00:00", True),
                     "i3": ("2024-02-02 00:00:00", False)}


def test_concepts_from_a_table(spark):
    table = spark.createDataFrame([("pii:ssn", "B"), ("pii:ssn", "A"), ("x", "C")], "suggested_tag string, concept string")
    assert rows(monitor.with_concept(items(spark), table), "id", "concept_match") == [("i1", "A"), ("i2", ""), ("i3", "")]
    assert rows(monitor.with_concept(items(spark)), "concept_match").count(("",)) == 1


def test_composite_confidence(spark):
    scores = spark.createDataFrame([("a", "r", 0.9), ("a", "p", 0.5), ("a", "zero", 0.1), ("b", "zero", 0.4), ("b", "r", None)],
                                   "k string, worker string, confidence double")
    found = rows(monitor.composite_confidence(scores, ["k"], {"r": 0.75, "p": 0.25}))
    assert found == [("a", 0.8, 2), ("b", None, 0)]


def test_schema_changes(spark):
    def snapshot(*listed):
        return spark.createDataFrame([("s", "t", n, k) for n, k in listed],
                                     "schema_name string, table_name string, column_name string, data_type string")

    found = monitor.schema_changes(snapshot(("a", "INT"), ("b", "INT"), ("c", None)), snapshot(("a", "INT"), ("b", "TEXT"),
                                   ("c", None), ("d", "INT")), as_of())
    assert rows(found, "event_type", "target_table", "details") == [
        ("COLUMN_ADDED", "s.t", "New column 'd' added to table schema."),
        ("TYPE_CHANGED", "s.t", "Column 'b' changed from INT to TEXT.")]
