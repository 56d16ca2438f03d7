"""Column expressions: keys, rule matching, derived columns, labels.

Every function takes column names (some also Columns) and returns one Column that stays inside generated JVM code.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import reference_data as ref
from wardline.functions.reference_data import Rule

BLANKS = " \t\n\r\x0b\x0c"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NONE = "None"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sql_text(value) -> str:
    """A Python constant as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def first_case(cases: Iterable[tuple[str, object]], default: str = "NULL") -> Column:
    """CASE WHEN over (condition, constant) pairs; the first true condition wins.

    Conditions and default are SQL, parsed once: long chains built call by call take longer than the query.
    """
    chain = " ".join(f"WHEN {condition} THEN {sql_text(value)}" for condition, value in cases)
    return F.expr(f"CASE {chain} ELSE {default} END")


def contains_any(text: str, words: Sequence[str]) -> str:
    """SQL: any word is a substring. Words that contain another word of the list cannot change the answer."""
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return "(" + " OR ".join(f"contains({text}, {sql_text(w)})" for w in needed) + ")"


def constants(values: Sequence) -> str:
    """SQL array of constants."""
    return "array(" + ", ".join(sql_text(v) for v in values) + ")"


def clean(value: str) -> Column:
    """Trim all blanks and lower the case: the form in which names are joined and matched."""
    return F.expr(f"btrim(lower({value}), {sql_text(BLANKS)})")


def is_blank_tag(tag: str) -> Column:
    """NULL, empty, 'none' and 'unclassified' all mean: no tag."""
    blank = ", ".join(sql_text(t) for t in ref.BLANK_TAGS)
    return F.expr(f"coalesce(btrim(lower({tag}), {sql_text(BLANKS)}) IN ({blank}), true)")


# --- rule matching ---------------------------------------------------------------------------------------------


def rule_number(name_key: str, rules: Sequence[Rule] = ref.QUEUE_RULES) -> Column:
    """Position (from 1) of the first rule that matches the lower-case name, NULL if none does."""
    return first_case((contains_any(name_key, rule.keywords), n) for n, rule in enumerate(rules, 1))


def rule_value(number: str, field: str, rules: Sequence[Rule] = ref.QUEUE_RULES) -> Column:
    """One attribute of a rule by its position; NULL positions give the attribute of 'no rule'."""
    values = constants([getattr(rule, field) for rule in rules])
    return F.expr(f"coalesce(get({values}, {number} - 1), {sql_text(getattr(ref.UNMATCHED, field))})")


# --- derived columns of the queue ------------------------------------------------------------------------------


def item_id(schema: str, table: str, column: str) -> Column:
    return F.expr(f"lower(translate(concat_ws('-', 'live', {schema}, {table}, {column}), ' ', '_'))")


def domain(schema: str) -> Column:
    return F.expr(f"initcap(translate({schema}, '_', ' '))")


def _by_fragment(column: str, pairs: Sequence[tuple[Sequence[str], str]], default: str, lower: bool = True) -> Column:
    text = f"lower(`{column}`)" if lower else f"`{column}`"
    return first_case(((contains_any(text, words), value) for words, value in pairs), default)


def tag_category(tag: str) -> Column:
    pairs = ((("pii",), "PII"), (("phi",), "PHI"), (("financial",), "Financial"))
    return _by_fragment(tag, pairs, "'Sensitive'")


def confidence(text: str, default: float = 0.9) -> Column:
    """Text to number; empty, NULL and unreadable texts give the default."""
    return F.expr(f"coalesce(CASE WHEN {text} RLIKE {sql_text(NUMBER)} THEN try_cast({text} AS double) END, {default}D)")


def prior_priority(score: Column | str) -> Column:
    score = as_column(score)
    return F.when(score >= 0.95, "Critical").when(score >= 0.85, "High").otherwise("Medium")


def recommendation(score: str, threshold: float = ref.AUTO_APPROVAL) -> Column:
    return F.expr(f"CASE WHEN {score} >= {threshold}D THEN 'Auto-Approve' ELSE 'Review Recommended' END")


def prior_native_class(tag: str) -> Column:
    return F.expr(f"concat('Classified as ', upper({tag}))")


def minute_text(when: Column | str) -> Column:
    return F.date_format(as_column(when), "yyyy-MM-dd HH:mm")


def second_text(when: Column | str) -> Column:
    return F.date_format(as_column(when), "yyyy-MM-dd HH:mm:ss")


def initial_timeline(submitted: str) -> Column:
    entries = ", ".join(
        f"named_struct('stage', {sql_text(name)}, 'timestamp', date_format({submitted}, 'yyyy-MM-dd HH:mm'))"
        for name in (ref.STAGE_DISCOVERED, ref.STAGE_CLASSIFIED)
    )
    return F.expr(f"array({entries})")


# --- derived columns of the catalog view -----------------------------------------------------------------------


def masking_policy(tag: str) -> Column:
    return _by_fragment(tag, ref.MASKING_POLICIES, "'None'", lower=False)


def access_policy(tag: str) -> Column:
    return _by_fragment(tag, ref.ACCESS_POLICIES, "'None'", lower=False)


def search_category(tag: str) -> Column:
    """The category the search page shows; it tests 'pci', so financial tags come out as Other."""
    return _by_fragment(tag, ((("pii",), "PII"), (("phi",), "PHI"), (("pci",), "Financial")), "'Other'")


# --- labels ----------------------------------------------------------------------------------------------------


def confidence_band(score: Column | str) -> Column:
    score = as_column(score)
    return F.when(score >= 0.90, "high").when(score >= 0.70, "medium").otherwise("low")


def category_label(category: str) -> Column:
    pairs = ((("pii",), "PII"), (("phi",), "PHI"), (("financial", "pci"), "Financial"))
    return _by_fragment(category, pairs, f"`{category}`")


def status_label(status: str) -> Column:
    low = f"lower(`{status}`)"
    return first_case(
        [
            (f"contains({low}, 'pending')", "Pending Review"),
            (f"contains({low}, 'classified') AND NOT contains({low}, 'un')", "Classified"),
            (f"contains({low}, 'approve')", "Approved"),
            (f"contains({low}, 'reject')", "Rejected"),
            (f"contains({low}, 'escalat')", "Escalated"),
            (f"contains({low}, 'unclassified')", "Unclassified"),
        ],
        f"`{status}`",
    )


def percent_text(score: Column | str, digits: int = 1) -> Column:
    """A share as percent text, exact ties rounded to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(as_column(score) * 100, digits))


def dash_if_empty(text: Column | str) -> Column:
    return F.coalesce(F.nullif(as_column(text), F.lit("")), F.lit("—"))


def role_of(email: str) -> Column:
    pairs = [((word,), role) for word, role in ref.ROLE_BY_EMAIL]
    return _by_fragment(email, pairs, sql_text(ref.DEFAULT_ROLE))


def qualified(schema: Column | str, table: Column | str, column: Column | str) -> Column:
    return F.concat_ws(".", as_column(schema), as_column(table), as_column(column))


# --- decisions -------------------------------------------------------------------------------------------------


def decision_id(decision_key: str, email: str) -> Column:
    """The same decision always gets the same id, so a rerun adds nothing."""
    return F.expr(f"concat('GD-', substring(sha2(concat_ws('|', {decision_key}, {email}), 256), 1, 12))")


def audit_id(decision_key: str) -> Column:
    return F.expr(f"concat('aud-', substring(sha2({decision_key}, 256), 1, 12))")


def seconds(duration: Column | str) -> Column:
    """'1m 12s' or '42s' as a number of seconds; NULL if the text has neither part."""
    text = as_column(duration)

    def part(unit: str) -> Column:
        return F.regexp_extract(text, f"([0-9]+){unit}", 1).try_cast("int")

    known = text.rlike("[0-9]+[ms]")
    return F.when(known, F.coalesce(part("m"), F.lit(0)) * 60 + F.coalesce(part("s"), F.lit(0)))


def audit_time(text: Column | str, as_of: Column) -> Column:
    """Stored time text to a timestamp; unreadable and missing texts become ``as_of``."""
    value = F.substring(as_column(text), 1, 19)
    shape = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
    return F.coalesce(F.when(shape, value.try_cast("timestamp_ntz")), as_of)


def literal_map(pairs: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in pairs.items()) + ")")


def review_deadline_hours(category: Column | str, status: Column | str) -> Column:
    hours = F.try_element_at(literal_map(ref.SLA_HOURS), as_column(category))
    return F.when(as_column(status) == "ESCALATED", ref.SLA_ESCALATED_HOURS).otherwise(hours)


# --- questions -------------------------------------------------------------------------------------------------

# Intents with the words that lead to them. Each inner list is a choice, all choices must be met.
INTENTS = (
    ("pending_phi", (("phi",), ("pending",))),
    ("pending_pii", (("pii",), ("unclassified", "pending", "clinical"))),
    ("last_live", (("last live", "last connected"),)),
    ("last_live", (("when",), ("live",))),
    ("response_time", (("time",), ("taken", "response", "query"))),
    ("approval_sla", (("sla", "approval"),)),
    ("recent_approvals", (("approved",), ("last", "recent", "5", "five"))),
    ("access_policy", (("abac", "policy", "access"),)),
    ("masking", (("masking", "clinical"),)),
    ("pending_financial", (("financial",), ("column", "list", "pending"))),
)


def question_intent(question: str) -> Column:
    low = f"lower(`{question}`)"
    cases = ((" AND ".join(contains_any(low, choice) for choice in choices), intent) for intent, choices in INTENTS)
    return first_case(cases, "'summary'")
