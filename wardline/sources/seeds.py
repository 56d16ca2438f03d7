"""First rows of the governance tables, for a system that has none yet.

Fixed values. Times are given as ages and counted back from ``as_of``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from wardline import schemas
from wardline.functions import reference_data as ref

CLAIMS, PATIENTS = "claims_billing_phi", "healthcare_patients_financial"
STEWARD, COMPLIANCE = "steward@enterprise.com", "compliance@enterprise.com"

# Table, column, tag, type, confidence.
RESULTS = (
    (CLAIMS, "patient_id", "phi:patient_id", "STRING", "0.95"),
    (CLAIMS, "claim_amount", "financial:amount", "DECIMAL", "0.94"),
    (CLAIMS, "diagnosis_code", "phi:diagnosis", "STRING", "0.93"),
    (PATIENTS, "patient_id", "phi:patient_id", "STRING", "0.95"),
    (PATIENTS, "account_number", "financial:account", "STRING", "0.96"),
    (PATIENTS, "insurance_id", "pii:insurance", "STRING", "0.86"),
    (PATIENTS, "date_of_birth", "pii:dob", "STRING", "0.96"),
    (PATIENTS, "email_address", "pii:email", "STRING", "0.94"),
    (PATIENTS, "phone_number", "pii:phone", "STRING", "0.92"),
)

# Table, column, tag, masking policy, access policy, class date, last reviewer, status.
CATALOG = (
    (CLAIMS, "patient_id", "phi:patient_id", "MASK_PATIENT_ID", "PhysicianOrCompliance", "2026-07-15", STEWARD, "Classified"),
    (CLAIMS, "claim_amount", "financial:amount", "None", "FinanceRoleOnly", "2026-07-15", STEWARD, "Classified"),
    (CLAIMS, "diagnosis_code", "phi:diagnosis", "None", "PhysicianOrCompliance", "2026-07-16", COMPLIANCE, "Classified"),
    (CLAIMS, "provider_id", "phi:provider_id", "None", "None", "2026-07-16", "", "Pending Review"),
    (PATIENTS, "patient_id", "phi:patient_id", "MASK_PATIENT_ID", "PhysicianOrCompliance", "2026-07-14", STEWARD, "Classified"),
    (PATIENTS, "account_number", "financial:account", "MASK_ACCOUNT", "FinanceRoleOnly", "2026-07-14", STEWARD, "Classified"),
    (PATIENTS, "insurance_id", "pii:insurance", "None", "None", "2026-07-18", COMPLIANCE, "Classified"),
    (PATIENTS, "date_of_birth", "pii:dob", "MASK_DOB", "PhysicianOrCompliance", "2026-07-18", STEWARD, "Classified"),
    (PATIENTS, "email_address", "pii:email", "MASK_EMAIL", "None", "2026-07-19", STEWARD, "Classified"),
    (PATIENTS, "phone_number", "pii:phone", "MASK_LAST_4", "None", "2026-07-19", COMPLIANCE, "Classified"),
    (ref.RESULTS_TABLE, "column_name", "", "None", "None", "", "", "Unclassified"),
)

# Id, table, column, type, tag, confidence, recommendation, priority, category, age in hours, concept,
# concept confidence.
QUEUE = (
    ("req-cbp-001", CLAIMS, "patient_id", "STRING", "phi:patient_id", 0.95, "Auto-Approve", "Critical", "PHI", 2,
     "Patient Master Identifier", 0.96),
    ("req-cbp-002", CLAIMS, "claim_amount", "DECIMAL", "financial:amount", 0.94, "Auto-Approve", "Medium", "Financial", 4,
     "Adjudicated Claim Charge", 0.95),
    ("req-cbp-003", CLAIMS, "diagnosis_code", "STRING", "phi:diagnosis", 0.93, "Review Recommended", "High", "PHI", 6,
     "ICD Medical Coding Taxonomy", 0.93),
    ("req-hpf-001", PATIENTS, "account_number", "STRING", "financial:account", 0.96, "Auto-Approve", "High", "Financial", 8,
     "Patient Billing Account Reference", 0.96),
    ("req-hpf-002", PATIENTS, "insurance_id", "STRING", "pii:insurance", 0.86, "Review Recommended", "Medium", "PII", 24,
     "Health Insurance Plan Identifier", 0.87),
    ("req-hpf-003", PATIENTS, "patient_id", "STRING", "phi:patient_id", 0.95, "Auto-Approve", "Critical", "PHI", 48,
     "Patient Master Identifier", 0.96),
)
# Explanation, ontology term and age in days of the discovery, by item id.
FOUND = {
    "req-cbp-001": ("Column name and context match PHI patient identifier pattern.", "Patient Master Identifier", 3),
    "req-cbp-002": ("Dollar-scale decimal pattern and column name match financial billing guidelines.",
                    "Monetary Dollar Value", 3),
    "req-cbp-003": ("Diagnosis code column pattern matches ICD-10 PHI classification.", "ICD Medical Coding Taxonomy", 3),
    "req-hpf-001": ("Account number pattern matches PCI financial account classification.",
                    "Patient Billing Account Reference", 2),
    "req-hpf-002": ("Insurance ID keyword matches PII insurance identifier classification.",
                    "Health Insurance Plan Identifier", 2),
    "req-hpf-003": ("Patient ID column matches PHI patient identifier classification.", "Patient Master Identifier", 2),
}
# Id, type, table, details, action, status, time.
EVENTS = (
    ("EVT-8092", "SCHEMA_CHANGE", "clinical.PATIENTS", "New column 'tax_identifier' added to table schema.",
     "Triggered Supervisor Agent", "PROCESSED", "2026-07-29 10:15:30"),
    ("EVT-8093", "NEW_DATA_INGESTION", "revenue_cycle.CLAIMS",
     "Inbound claims file processed via Autoloader schema inference.", "Triggered Classification Worker", "PROCESSED",
     "2026-07-29 14:02:11"),
)
# Similar columns by item id.
SIMILAR = {
    "req-cbp-001": (f"brz.{PATIENTS}.patient_id", 97.0),
    "req-hpf-003": (f"brz.{CLAIMS}.patient_id", 97.0),
}

# Id, decision id, age in days, reviewer, schema, table, column, tag, decision, suggestion, confidence, duration.
AUDIT = (
    ("aud-001", "GD-10492", 5, STEWARD, "clinical", "PATIENTS", "tax_identifier", "pii:ssn", "APPROVE", "pii:ssn", 0.98, "42s",
     "Matches format criteria perfectly and verified via patient lookup service."),
    ("aud-002", "GD-10493", 3, COMPLIANCE, "clinical", "ENCOUNTERS", "primary_diagnosis", "phi:icd10", "APPROVE", "phi:icd10",
     0.91, "18s", "Confirmed standard billing ICD10 formats."),
    ("aud-003", "GD-10494", 2, STEWARD, "hr_db", "salaries", "base_rate", "financial:salary", "MODIFY", "financial:numeric",
     0.85, "1m 12s", "Changed suggestion from generic 'financial:numeric' to specific 'financial:salary'."),
)


def classification_results(spark: SparkSession) -> DataFrame:
    rows = [(*row, "['***masked***']") for row in RESULTS]
    return spark.createDataFrame(rows, schemas.CLASSIFICATION_RESULTS)


def catalog_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("brz", *row, "STRING") for row in CATALOG], schemas.CATALOG_ENTRY)


def governance_audit(spark: SparkSession, as_of: datetime) -> DataFrame:
    rows = [
        (ident, decision_id, as_of - timedelta(days=age), email, schema, table, column, "None", tag, decision, comments,
         suggestion, score, duration, ref.DEFAULT_METHOD, ref.DEFAULT_SOURCE)
        for ident, decision_id, age, email, schema, table, column, tag, decision, suggestion, score, duration, comments
        in AUDIT
    ]
    return spark.createDataFrame(rows, schemas.GOVERNANCE_AUDIT)


def classification_items(spark: SparkSession, as_of: datetime) -> DataFrame:
    native = {rule.tag: rule.native_class for rule in ref.QUEUE_RULES}
    rows = []
    for (ident, table, column, kind, tag, score, advice, priority, category, age, concept, concept_score) in QUEUE:
        submitted = as_of - timedelta(hours=age)
        similar = [SIMILAR[ident]] if ident in SIMILAR else []
        why, term, days = FOUND[ident]
        stages = [(ref.STAGE_DISCOVERED, as_of - timedelta(days=days)), (ref.STAGE_CLASSIFIED, submitted)]
        rows.append((
            ident, "brz", table, column, kind, tag, native[tag], term, [f"{name} ({tag})" for name, _ in similar], score,
            advice, why, ["***masked***"], "PENDING", submitted, priority,
            category, "Brz", concept, concept_score, similar,
            [(stage, when.strftime("%Y-%m-%d %H:%M")) for stage, when in stages],
        ))
    return spark.createDataFrame(rows, schemas.CLASSIFICATION_ITEM)


def schema_events(spark: SparkSession) -> DataFrame:
    rows = [(*row[:-1], datetime.strptime(row[-1], "%Y-%m-%d %H:%M:%S")) for row in EVENTS]
    return spark.createDataFrame(rows, schemas.SCHEMA_EVENT)
