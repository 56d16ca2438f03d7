"""Fixed schemas of the governance tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TEXT, REAL, WHEN, WHOLE = StringType(), DoubleType(), TimestampNTZType(), IntegerType()
TEXTS = ArrayType(TEXT)
SIMILAR = ArrayType(_struct(name=TEXT, similarity=REAL))
TIMELINE = ArrayType(_struct(stage=TEXT, timestamp=TEXT))

COLUMN_INVENTORY = _struct(
    catalog_name=TEXT, schema_name=TEXT, table_name=TEXT, column_name=TEXT,
    data_type=TEXT, is_partition=BooleanType(), ordinal=WHOLE,
)

CLASSIFICATION_RESULTS = _struct(
    table_name=TEXT, column_name=TEXT, class_tag=TEXT, data_type=TEXT, confidence=TEXT, samples=TEXT,
)

CLASSIFICATION_ITEM = _struct(
    id=TEXT, schema_name=TEXT, table_name=TEXT, column_name=TEXT, data_type=TEXT, suggested_tag=TEXT,
    native_classification=TEXT, ontology_match=TEXT, similar_columns=TEXTS, confidence_score=REAL,
    supervisor_recommendation=TEXT, ai_explanation=TEXT, sample_values=TEXTS, status=TEXT, submitted_time=WHEN,
    priority=TEXT, category=TEXT, domain=TEXT, concept_match=TEXT, concept_confidence=REAL,
    similar_columns_metrics=SIMILAR, governance_timeline=TIMELINE,
)

GOVERNANCE_AUDIT = _struct(
    id=TEXT, governance_decision_id=TEXT, timestamp=WHEN, user_email=TEXT, schema_name=TEXT, table_name=TEXT,
    column_name=TEXT, previous_tag=TEXT, new_tag=TEXT, decision=TEXT, comments=TEXT, ai_recommendation=TEXT,
    confidence_score=REAL, approval_duration=TEXT, approval_method=TEXT, approval_source=TEXT,
)

CATALOG_ENTRY = _struct(
    schema_name=TEXT, table_name=TEXT, column_name=TEXT, tag=TEXT, masking_policy=TEXT, abac_policy=TEXT,
    class_date=TEXT, last_reviewer=TEXT, status=TEXT, data_type=TEXT,
)

COLUMN_TAG_EVENT = _struct(
    schema_name=TEXT, table_name=TEXT, column_name=TEXT, tag=TEXT, user_email=TEXT, ts=WHEN, decision_id=TEXT,
)

SCHEMA_EVENT = _struct(
    event_id=TEXT, event_type=TEXT, target_table=TEXT, details=TEXT, action_taken=TEXT, status=TEXT, ts=WHEN,
)

DECISION = _struct(
    decision_key=TEXT, id=TEXT, timestamp=WHEN, user_email=TEXT, action=TEXT, steward_tag=TEXT, comments=TEXT,
    approval_duration=TEXT, approval_method=TEXT,
)
