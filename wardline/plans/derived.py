"""Governance tables that grow with the given tables: one column per order, one decision per event."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.columns import constants
from wardline.operators import catalog, classify, decide

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
# Schemas of the given tables, so that no job is needed to find them.
SCHEMA_OF = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}
AS_OF = "2024-02-01 00:00:00"
KEY = "item_key"

# Column names of the derived inventory, by order key modulo 24.
BASE_NAMES = (
    "ssn", "phone_home", "email_address", "last_name", "dob", "zip", "diagnosis_code", "rx_code", "mrn", "lab_value",
    "billed_amt", "card_number", "npi", "payer_id", "notes", "status_flag", "discharge_date", "cancelled_at",
    "physician_charge", "account_payment", "created_ts", "region_cd", "qty", "flag_a",
)
SCHEMAS = ("clinical", "revenue_cycle", "hr_db", "brz")
TYPES = ("STRING", "DECIMAL(18,2)", "TIMESTAMP")
PRIOR_TAGS = ("pii:ssn", "phi:diagnosis", "unclassified", None, "financial:amount", "Internal:Code", " PHI:mrn ")
PRIOR_CONFIDENCES = ("0.97", "0.88", "0.5", "n/a", "", None, "0.95", "0.95", "0.95", "0.95", "0.95")
STEWARD_TAGS = ("pii:name", "financial:account", None)
ACTION_BY_EVENT = {
    "purchase": "Approve Recommendation",
    "error": "Reject Recommendation",
    "click": "Modify Classification",
    "signup": "Escalate for Expert Review",
    "view": "Save as Draft",
}
QUESTIONS = (
    "Which PHI columns are pending?",
    "Which columns are classified as PII in clinical?",
    "When were you last live?",
    "How long did the last query take, response time?",
    "What is the approval SLA for PHI columns?",
    "Which were the last 5 approved decisions?",
    "What ABAC policies apply?",
    "Show masking on clinical",
    "List all financial columns",
    "Hello",
)


def pick(values, number: str):
    """The value at number modulo the list's length; ``number`` is a column name."""
    return F.expr(f"get({constants(values)}, cast(pmod({number}, {len(values)}) AS int))")


class Derived:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.as_of = F.lit(AS_OF).cast("timestamp_ntz")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        known = SCHEMA_OF.get(name)
        reader = self.spark.read.schema(known) if known else self.spark.read
        return reader.parquet(self.path(name))

    @cached_property
    def inventory(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias(KEY),
            pick(SCHEMAS, "o_custkey").alias("schema_name"),
            F.concat(F.lit("tbl_"), F.col("o_custkey").cast("string")).alias("table_name"),
            F.concat_ws("_", pick(BASE_NAMES, "o_orderkey"), key.cast("string")).alias("column_name"),
            pick(TYPES, "o_orderkey").alias("data_type"),
            pick(BASE_NAMES, "o_orderkey").alias("base_name"),
            (F.lit("2024-01-28").cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 96).cast("int")))
            .alias("submitted_time"),
            F.col("o_orderpriority").alias("urgency"),
            F.col("o_orderstatus").alias("progress"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """A raw listing as a metadata service gives it: comment rows, nameless columns, missing types."""
        key = F.col(KEY)
        return self.inventory.select(
            KEY,
            "schema_name",
            F.when(key % 19 == 0, "classification_results").otherwise(F.col("table_name")).alias("table_name"),
            F.when(key % 17 == 0, "# Partition Information").when(key % 17 == 1, "").otherwise(F.col("column_name"))
            .alias("column_name"),
            F.when(key % 13 == 0, "").when(key % 13 == 1, F.lit(None)).otherwise(F.lower("data_type")).alias("type_text"),
            F.when(key % 26 == 0, "").otherwise(F.col("data_type")).alias("type_name"),
        )

    @cached_property
    def prior(self) -> DataFrame:
        """Earlier results for the urgent orders' columns, with blank, odd and doubled entries."""
        key = F.col(KEY)
        urgent = self.inventory.filter(F.col("urgency") == "1-URGENT")
        first = F.struct(F.col("table_name"), pick(PRIOR_TAGS, KEY).alias("class_tag"),
                         pick(PRIOR_CONFIDENCES, KEY).alias("confidence"))
        second = F.struct(F.concat(F.lit(" "), F.upper("table_name")).alias("table_name"),
                          F.lit("pii:email").alias("class_tag"), F.lit("0.91").alias("confidence"))
        entries = F.when(F.col("progress") == "F", F.array(first, second)).otherwise(F.array(first))
        return urgent.select("column_name", "data_type", F.explode(entries).alias("entry")).select(
            "entry.table_name", "column_name", "entry.class_tag", "data_type", "entry.confidence",
            F.lit("['***masked***']").alias("samples"))

    @cached_property
    def queue(self) -> DataFrame:
        return classify.review_queue(self.inventory, self.prior, F.col("submitted_time"), keep=(KEY,))

    @cached_property
    def catalog(self) -> DataFrame:
        return catalog.catalog_view(self.inventory, self.prior)

    def decisions_from(self, events: DataFrame) -> DataFrame:
        """Decisions out of event rows; works on a batch and on a stream."""
        roles = ("steward", "compliance", "engineer", "analyst")
        actions = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in ACTION_BY_EVENT.items())
        return events.select(
            F.expr("concat('D-', event_id) AS decision_key"),
            F.expr(f"event_id - event_id % 2 AS {KEY}"),
            F.expr("ts AS timestamp"),
            F.concat(pick(roles, "user_id"), F.expr("concat(user_id, '@example.com')")).alias("user_email"),
            F.expr(f"CASE event_type {actions} END AS action"),
            F.when(F.expr("event_type = 'click'"), pick(STEWARD_TAGS, "event_id")).alias("steward_tag"),
            F.expr("CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('Checked ', props) END AS comments"),
            F.expr("concat(event_id % 3, 'm ', event_id % 60, 's') AS approval_duration"),
            F.expr("CASE WHEN event_id % 10 = 0 THEN 'Bulk Approval' ELSE 'Manual Steward Review' END AS approval_method"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """One decision for each event, so each decision id is there once."""
        return self.decisions_from(self.table("events"))

    @cached_property
    def audit(self) -> DataFrame:
        return decide.to_audit(self.queue, self.decisions, KEY, unique=True)

    @cached_property
    def state(self) -> DataFrame:
        return decide.apply_decisions(self.queue, self.decisions, KEY, unique=True)

    @cached_property
    def questions(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("question_id"), pick(QUESTIONS, "event_id").alias("question")
        )

    @cached_property
    def snapshot_after(self) -> DataFrame:
        """A second inventory snapshot: some columns gone, some with another type, some under another name."""
        low, progress = F.col("urgency") == "5-LOW", F.col("progress")
        return self.inventory.filter(~(low & (progress == "P"))).withColumns(
            {
                "data_type": F.when(low & (progress == "F"), "BINARY").otherwise(F.col("data_type")),
                "column_name": F.when(low & (progress == "O"), F.concat("column_name", F.lit("_v2"))).otherwise(
                    F.col("column_name")),
            }
        )

    @cached_property
    def people(self) -> DataFrame:
        """Identifiers of every kind, built from the customer table."""
        number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
        born = F.concat_ws("-", (F.col("c_custkey") % 60 + 1940).cast("string"),
                           F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0"),
                           F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"))
        return self.table("customer").select(
            "c_custkey",
            F.concat(F.lit("MRN"), number).alias("mrn"),
            F.concat_ws("-", F.substring(number, 1, 3), F.substring(number, 4, 2), F.substring(number, 6, 4)).alias("ssn"),
            born.alias("birth_date"),
            F.concat(F.lit("user."), number, F.lit("@mail.example.com")).alias("email"),
            F.concat(F.lit("555-"), F.substring(number, 4, 3), F.lit("-"), F.substring(number, 6, 4)).alias("phone"),
            F.concat(F.lit("40000000"), number).alias("account"),
            "c_mktsegment",
        )
