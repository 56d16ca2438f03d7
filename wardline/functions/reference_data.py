"""Reference data: rule sets, action table, role matrix, deadlines, concepts.

Fixed values: results depend on them, so they are given as plain text.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    tag: str
    category: str
    confidence: float
    priority: str
    native_class: str
    explanation: str
    keywords: tuple[str, ...]


# Name rules in queue order; the first rule with a keyword inside the column name wins.
QUEUE_RULES = (
    Rule("pii:ssn", "PII", 0.97, "Critical", "PII - Social Security Number", "SSN keyword and format pattern matched.",
         ("ssn", "social_security", "tax_id", "tax_identifier", "national_id")),
    Rule("pii:phone", "PII", 0.92, "Low", "PII - Contact Phone Number", "Phone number keyword matched.",
         ("phone", "mobile", "cell", "telephone", "contact_number")),
    Rule("pii:email", "PII", 0.94, "Medium", "PII - Email Address", "Email keyword matched.",
         ("email", "email_address", "mail")),
    Rule("pii:name", "PII", 0.89, "High", "PII - Personal Name", "Name keyword matched.",
         ("first_name", "last_name", "full_name", "patient_name", "name")),
    Rule("pii:dob", "PII", 0.96, "High", "PII - Date of Birth", "Date of birth pattern matched.",
         ("dob", "date_of_birth", "birth_date", "birthdate")),
    Rule("pii:address", "PII", 0.88, "Medium", "PII - Physical Address", "Address/location keyword matched.",
         ("address", "street", "city", "zip", "postal_code", "location")),
    Rule("phi:diagnosis", "PHI", 0.93, "Critical", "PHI - Medical Diagnosis Code", "ICD diagnosis keyword matched.",
         ("diagnosis", "icd", "icd_code", "icd10", "condition", "disease")),
    Rule("phi:prescription", "PHI", 0.91, "High", "PHI - Prescription Information",
         "Medication/prescription keyword matched.",
         ("medication", "drug", "prescription", "dosage", "rx", "ndc")),
    Rule("phi:patient_id", "PHI", 0.95, "Critical", "PHI - Patient Identifier", "Patient identifier keyword matched.",
         ("mrn", "patient_id", "member_id", "encounter_id", "visit_id")),
    Rule("phi:lab_result", "PHI", 0.87, "High", "PHI - Lab/Clinical Observation", "Lab result keyword matched.",
         ("lab", "result", "test_result", "observation", "specimen")),
    Rule("financial:amount", "Financial", 0.94, "Medium", "PCI/Financial - Billing Charge",
         "Financial billing amount pattern matched.",
         ("claim_amount", "charge", "payment", "amount", "billed", "cost")),
    Rule("financial:account", "Financial", 0.96, "High", "PCI - Financial Account Number",
         "Payment/banking keyword matched.",
         ("account", "bank", "routing", "credit_card", "card_number")),
    Rule("phi:provider_id", "PHI", 0.90, "High", "PHI - Provider Identifier", "Provider/physician ID keyword matched.",
         ("npi", "provider_id", "physician_id", "dea_number", "physician", "attending")),
    Rule("pii:insurance", "PII", 0.86, "Medium", "PII - Insurance Identifier", "Insurance plan keyword matched.",
         ("insurance", "payer", "plan_id", "group_number", "policy_number")),
)

# The catalog view tries the same rules in another order, with the provider rule eleventh.
CATALOG_ORDER = (
    "pii:ssn", "pii:phone", "pii:email", "pii:name", "pii:dob", "pii:address", "phi:diagnosis", "phi:prescription",
    "phi:patient_id", "phi:lab_result", "phi:provider_id", "financial:amount", "financial:account", "pii:insurance",
)
CATALOG_RULES = tuple(next(rule for rule in QUEUE_RULES if rule.tag == tag) for tag in CATALOG_ORDER)

# What the queue shows for a name that no rule matches.
UNMATCHED = Rule(None, "Unknown", 0.0, "Low", "Unclassified", "No matching governance pattern found.", ())
PRIOR_EXPLANATION = "Discovered pre-existing classification in classification_results metadata table."
BLANK_TAGS = ("", "unclassified", "none")
RESULTS_TABLE = "classification_results"

# Masking policy by tag fragment, first match wins, case-sensitive.
MASKING_POLICIES = (
    (("patient_id", "mrn"), "MASK_PATIENT_ID"),
    (("ssn",), "MASK_FULL_SSN"),
    (("dob", "birth"), "MASK_DOB"),
    (("email",), "MASK_EMAIL"),
    (("phone",), "MASK_LAST_4"),
    (("account",), "MASK_ACCOUNT"),
)
# Access policy by tag fragment.
ACCESS_POLICIES = ((("phi",), "PhysicianOrCompliance"), (("financial",), "FinanceRoleOnly"))

# Timeline stage names.
STAGE_DISCOVERED = "Column Discovered in Live Catalog"
STAGE_CLASSIFIED = "AI Classified"
STAGE_DECISION = "Steward Decision: "
STAGES_APPROVED = ("Policy Applied (ABAC & Masking)", "Governed View Updated")


class Action(NamedTuple):
    action: str
    status: str | None
    decision: str | None
    keeps_tag: bool
    writes_back: bool


# Steward actions. keeps_tag: the steward's tag becomes the new tag, else the text 'None'.
ACTIONS = (
    Action("Approve Recommendation", "APPROVED", "APPROVE", True, True),
    Action("Reject Recommendation", "REJECTED", "REJECT", False, False),
    Action("Modify Classification", "APPROVED", "MODIFY", True, True),
    Action("Merge with Existing Concept", "APPROVED", "MODIFY", True, True),
    Action("Escalate for Expert Review", "ESCALATED", "ESCALATE", False, False),
    Action("Request Additional Information", None, None, False, False),
    Action("Save as Draft", None, None, False, False),
)

# Defaults of an audit row.
DEFAULT_DURATION = "30s"
DEFAULT_METHOD = "Manual Steward Review"
DEFAULT_SOURCE = "Steward Portal Workspace UI"
BULK_METHOD = "Bulk Approval"
BULK_COMMENTS = {"APPROVE": "Bulk approved via Workbench", "REJECT": "Bulk rejected via Workbench"}

# Permissions granted to each role. What is not listed is not allowed.
GRANTED = {
    "Governance Steward": (
        "view_dashboard", "view_queue", "approve_reject", "view_audit", "view_search", "ask_qa", "manage_settings",
        "view_orchestrator", "trigger_orchestrator",
    ),
    "Compliance Officer": (
        "view_dashboard", "view_queue", "approve_reject", "view_audit", "view_search", "ask_qa", "manage_settings",
        "view_orchestrator", "trigger_orchestrator",
    ),
    "Data Engineer": (
        "view_dashboard", "view_queue", "view_audit", "view_search", "ask_qa", "view_orchestrator", "trigger_orchestrator",
    ),
    "Read-only Analyst": (
        "view_dashboard", "view_queue", "view_audit", "view_search", "ask_qa", "view_orchestrator",
    ),
}
# Role by fragment of the e-mail address, first match wins.
ROLE_BY_EMAIL = (
    ("steward", "Governance Steward"),
    ("compliance", "Compliance Officer"),
    ("engineer", "Data Engineer"),
)
DEFAULT_ROLE = "Read-only Analyst"

# Review deadline in hours.
SLA_HOURS = {"PHI": 24, "PII": 48, "Financial": 72}
SLA_ESCALATED_HOURS = 4

# Business concept by tag.
CONCEPTS = (
    ("phi:patient_id", "Patient Master Identifier"),
    ("financial:amount", "Adjudicated Claim Charge"),
    ("phi:diagnosis", "ICD Medical Coding Taxonomy"),
    ("financial:account", "Patient Billing Account Reference"),
    ("pii:insurance", "Health Insurance Plan Identifier"),
)

# Access rules and maskings that the policy answers state.
POLICY_ANSWER = (
    ("phi:*", "PhysicianOrCompliance"),
    ("pii:ssn", "ComplianceRoleRequired"),
    ("pii:dob", "ComplianceRoleRequired"),
    ("financial:*", "FinanceRoleOnly"),
)
MASKING_ANSWER = (
    ("clinical.PATIENTS.tax_identifier", "MASK_FULL_SSN"),
    ("clinical.PATIENTS.phone_num", "MASK_LAST_4"),
)

# Thresholds and totals shown by the reports.
AUTO_APPROVAL = 0.95
ALERT_BELOW = 0.70
BASE_CLASSIFIED = 20
TOTAL_COLUMNS = 150

# Value patterns of the content scan: ours, without upper bounds; possessive, so a long text is read once.
VALUE_PATTERNS = (
    # (label, tag, needed character, regular expression)
    ("email", "pii:email", "@", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ssn", "pii:ssn", "-", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("phone", "pii:phone", None, r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}"),
    ("card_number", "financial:account", None, r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,16}"),
    ("birth_date", "pii:dob", "-", r"(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}"),
    ("ip_address", "pii:address", ".", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
)
