"""Rule matching, derived columns, labels."""


import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import masks
from wardline.functions import reference_data as ref
from wardline.operators import classify


def one(spark, kind, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.withColumn("y", expression).orderBy("i").collect()]


def tags_of(spark, names, rules=ref.QUEUE_RULES):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, column_name string")
    return [r.rule_tag for r in classify.classify(df, rules).orderBy("i").collect()]


def test_every_keyword_meets_its_rule_or_an_earlier_one(spark):
    pairs = [(n, rule.tag, w) for n, rule in enumerate(ref.QUEUE_RULES) for w in rule.keywords]
    found = tags_of(spark, [f"X_{w.upper()}_y" for _, _, w in pairs])
    order = [rule.tag for rule in ref.QUEUE_RULES]
    for (n, _, word), tag in zip(pairs, found):
        earliest = next(i for i, rule in enumerate(ref.QUEUE_RULES) if any(k in f"x_{word}_y" for k in rule.keywords))
        assert order.index(tag) == earliest <= n


def test_first_match_and_overreach(spark):
    names = ["email_address", "account_payment", "cancelled_at", "discharge_date", "capacity", "available_qty", "notes", ""]
    assert tags_of(spark, names) == [
        "pii:email", "financial:amount", "pii:phone", "financial:amount", "pii:address", "phi:lab_result", None, None]


def test_two_orders(spark):
    assert tags_of(spark, ["physician_charge"]) == ["financial:amount"]
    assert tags_of(spark, ["physician_charge"], ref.CATALOG_RULES) == ["phi:provider_id"]
    assert sorted(r.tag for r in ref.QUEUE_RULES) == sorted(ref.CATALOG_ORDER)


def test_unmatched_values(spark):
    df = spark.createDataFrame([("notes",)], "column_name string")
    row = classify.classify(df).first()
    assert (row.rule_tag, row.rule_category, row.rule_confidence, row.rule_priority) == (None, "Unknown", 0.0, "Low")


def test_expression_and_table_forms_agree(spark, derived):
    fields = [f"rule_{f}" for f in classify.RULE_FIELDS]
    one_way = rows(classify.classify(derived.inventory), "item_key", *fields)
    other = classify.classify_by_table(derived.inventory, classify.rule_table(spark))
    assert one_way == rows(other, "item_key", *fields)


def test_a_table_of_many_rules(spark):
    many = spark.range(3000).selectExpr(
        "cast(id AS int) AS rule_order", "array(concat('word', id, '_')) AS keywords", "concat('tag', id) AS tag",
        "'x' AS category", "0.5D AS confidence", "'x' AS priority", "'x' AS native_class", "'x' AS explanation")
    df = spark.createDataFrame([("a", "word2999_x"), ("b", "word7_word3_"), ("c", "none"), ("d", None)], "i string, column_name string")
    found = classify.classify_by_table(df, many)
    assert rows(found, "i", "rule_tag") == [("a", "tag2999"), ("b", "tag3"), ("c", None), ("d", None)]


def test_confidence_texts(spark):
    texts = ["0.5", " 1e-1 ", "", None, "n/a", "1_0", "0.9d", "nan", "inf", "1.", ".5", "+2"]
    assert one(spark, "string", texts, c.confidence("x")) == [0.5, 0.1, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 1.0, 0.5, 2.0]


def test_priority_and_recommendation(spark):
    scores = [0.95, 0.949, 0.85, 0.849]
    assert one(spark, "double", scores, c.prior_priority("x")) == ["Critical", "High", "High", "Medium"]
    assert one(spark, "double", scores, c.recommendation("x")) == ["Auto-Approve"] + ["Review Recommended"] * 3


def test_bands_and_percent(spark):
    assert one(spark, "double", [0.9, 0.7, 0.69], c.confidence_band("x")) == ["high", "medium", "low"]
    assert one(spark, "double", [0.865, 0.875, 0.5], c.percent_text("x", 0)) == ["86%", "88%", "50%"]
    assert one(spark, "double", [0.934], c.percent_text("x")) == ["93.4%"]


def test_policies_are_case_sensitive_categories_are_not(spark):
    tags = ["phi:patient_id", "PHI:mrn", "pii:ssn", "pii:dob", "x:birthday", "pii:email", "pii:phone", "financial:account", "", None]
    assert one(spark, "string", tags, c.masking_policy("x")) == [
        "MASK_PATIENT_ID", "MASK_PATIENT_ID", "MASK_FULL_SSN", "MASK_DOB", "MASK_DOB", "MASK_EMAIL", "MASK_LAST_4",
        "MASK_ACCOUNT", "None", "None"]
    assert one(spark, "string", ["phi:x", "PHI:x", "financial:x", "pii:ssn"], c.access_policy("x")) == [
        "PhysicianOrCompliance", "None", "FinanceRoleOnly", "None"]
    assert one(spark, "string", ["PHI:x", "Financial:y", "odd"], c.tag_category("x")) == ["PHI", "Financial", "Sensitive"]
    assert one(spark, "string", ["financial:x", "pci:x", None], c.search_category("x")) == ["Other", "Financial", "Other"]


def test_status_labels(spark):
    states = ["PENDING", "Pending Review", "Classified", "Unclassified", "APPROVED", "REJECTED", "ESCALATED_EXPERT", "DRAFT"]
    assert one(spark, "string", states, c.status_label("x")) == [
        "Pending Review", "Pending Review", "Classified", "Unclassified", "Approved", "Rejected", "Escalated", "DRAFT"]


def test_roles_and_durations(spark):
    mails = ["Steward@x", "compliance.engineer@x", "engineer@x", "bob@x"]
    assert one(spark, "string", mails, c.role_of("x")) == [
        "Governance Steward", "Compliance Officer", "Data Engineer", "Read-only Analyst"]
    assert one(spark, "string", ["1m 12s", "42s", "2m", "soon", None], c.seconds("x")) == [72, 42, 120, None, None]


def test_audit_time(spark):
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    found = one(spark, "string", ["2023-05-06 07:08:09.123", "2023-05-06", "2023-99-06 07:08:09", None], c.audit_time("x", as_of))
    assert [str(t) for t in found] == ["2023-05-06 07:08:09"] + ["2024-01-01 00:00:00"] * 3


def test_intents(spark):
    asked = ["PHI pending?", "pii in clinical", "when were you live", "last connected", "response time", "approval of PHI",
             "5 recent approved", "which policy", "clinical data", "list financial things", "hi"]
    assert one(spark, "string", asked, c.question_intent("x")) == [
        "pending_phi", "pending_pii", "last_live", "last_live", "response_time", "approval_sla", "recent_approvals",
        "access_policy", "masking", "pending_financial", "summary"]


def test_keys_and_ids(spark):
    assert one(spark, "string", ["  Ab C\t\n", None], c.clean("x")) == ["ab c", None]
    assert one(spark, "string", ["My Col"], c.item_id("'Brz'", "'T 1'", "x")) == ["live-brz-t_1-my_col"]
    assert one(spark, "string", ["revenue_cycle"], c.domain("x")) == ["Revenue Cycle"]


@pytest.mark.parametrize(
    "policy, value, masked",
    [
        ("MASK_LAST_4", "555-123-4567", "***-***-4567"),
        ("MASK_LAST_4", "4567", "***masked***"),
        ("MASK_LAST_4", "(555) 12 3 4-5-6", "(***) ** 3 4-5-6"),
        ("MASK_LAST_4", "(555) 12 3 4-5-6 x", "***masked***"),
        ("MASK_FULL_SSN", "123-45-6789", "***-**-****"),
        ("MASK_FULL_SSN", "123456789", "***-**-****"),
        ("MASK_FULL_SSN", "id 123-45-6789.", "***masked***"),
        ("MASK_DOB", "1980-05-06", "1980-01-01"),
        ("MASK_DOB", "01/02/1980", "1980-01-01"),
        ("MASK_DOB", "19800102", "1980-01-01"),
        ("MASK_DOB", "2 January 1980", "***masked***"),
        ("MASK_EMAIL", "jane.doe@x.org", "j***@x.org"),
        ("MASK_EMAIL", "no mail", "***masked***"),
        ("MASK_ACCOUNT", "4000123412341234", "****1234"),
        ("MASK_ACCOUNT", "1234", "***masked***"),
        ("MASK_PATIENT_ID", "MRN1", "***masked***"),
        ("MASK_SENSITIVE_VALUE", "x", "***masked***"),
        ("NO_SUCH_POLICY", "x", "***masked***"),
        ("None", "x", "x"),
    ],
)
def test_masks(spark, policy, value, masked):
    by_constant = one(spark, "string", [value, None], masks.by_policy("x", policy))
    by_column = one(spark, "string", [value, None], masks.by_policy_column("x", F.lit(policy)))
    assert by_constant == by_column == [masked, None]


def test_pseudonyms_stay_equal_under_one_secret(spark):
    ids = ["MRN1", "MRN1", "MRN2"]
    first, second, third = one(spark, "string", ids, masks.by_policy("x", "MASK_PATIENT_ID", "secret"))
    assert first == second != third and "MRN" not in first and len(first) == 67
    assert one(spark, "string", ids, masks.by_policy("x", "MASK_PATIENT_ID", "other"))[0] != first
    assert one(spark, "string", ids, masks.by_policy_column("x", F.lit("MASK_PATIENT_ID"), "secret")) == [first, second, third]


@pytest.mark.parametrize(("text", "masked"), [
    ("9" * 28, "****9999"), ("9" * 17, "****9999"), ("x 123456789 y", "x ****6789 y"), ("12345678", "12345678"),
    ("a@b and cd@e", "a***@b and c***@e"), (None, None),
])
def test_free_text(spark, text, masked):
    assert one(spark, "string", [text], masks.free_text("x")) == [masked]


def test_free_text_whole_length(spark):
    text = "a" * 100_000 + " jane.doe@x.org " + "9" * 16 + " 123-45-6789"
    found = one(spark, "string", [text], masks.free_text("x"))[0]
    assert found.endswith(" j***@x.org ****9999 ***-**-****") and len(found) > 100_000


def test_names_are_not_broadcast_to_find_their_rule(spark, derived):
    """Neither the runs of the names nor the names that have a rule: both grow with the names."""
    found = classify.classify_by_table(derived.inventory, classify.rule_table(spark))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    few = spark.createDataFrame([(1, "a_ssn"), (2, "A_SSN"), (3, None), (4, "zzz")], "i int, column_name string")
    assert rows(classify.classify_by_table(few, classify.rule_table(spark)), "i", "rule_number") == [(1, 1), (2, 1), (3, None), (4, None)]
