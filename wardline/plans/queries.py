"""The registered queries: one per operator, each over whole tables, most with a SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions import columns as c
from wardline.functions import reference_data as ref
from wardline.operators import audit as log
from wardline.operators import catalog as cat
from wardline.operators import classify, decide, monitor, protect, questions, queue, report
from wardline.plans.derived import KEY, TABLES, Derived
from wardline.plans.oracle import AS_OF, sql
from wardline.session import work_path
from wardline.sources import commits, discover, footers, schema_watch, search_index, sinks, tables, tag_store
from wardline.streaming import breaches
from wardline.streaming import decisions as feed
from wardline.streaming import state as live
from wardline.streaming import windows

Query = Callable[[Derived], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if body:
            ORACLES[name] = sql(body)
        return function

    return add


QUEUE_COLUMNS = (
    "id", "schema_name", "table_name", "column_name", "data_type", "suggested_tag", "native_classification",
    "confidence_score", "supervisor_recommendation", "ai_explanation", "status", "submitted_time", "priority",
    "category", "domain",
)
AUDIT_COLUMNS = tuple(schemas.GOVERNANCE_AUDIT.names)
SQL_QUEUE = ", ".join(QUEUE_COLUMNS)
SQL_AUDIT = ", ".join(AUDIT_COLUMNS)
ITEM_COLUMNS = ("id", "suggested_tag", "status", "confidence_score")
SQL_ITEM = ", ".join(ITEM_COLUMNS)


# --- sources ---------------------------------------------------------------------------------------------------


@query("s1_discover_columns", "SELECT c.table_name, c.column_name, n.n_rows FROM information_schema.columns c JOIN ("
       + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)
       + ") n USING (table_name)")
def _(d):
    """Columns of the given tables, with the row count of each table."""
    found = discover.path_columns(d.spark, {t: d.path(t) for t in TABLES}, "given")
    sizes = tables.row_counts({t: d.table(t) for t in TABLES})
    return found.join(sizes, "table_name").select("table_name", "column_name", "n_rows")


@query("s1_footer_columns", "SELECT c.table_name, c.column_name, n.n_rows FROM information_schema.columns c JOIN ("
       + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)
       + ") n USING (table_name)")
def _(d):
    """The same from the footers alone, which tasks read."""
    read = footers.footers(footers.files_of(d.spark, {t: d.path(t) for t in TABLES}))
    return footers.file_columns(read).join(footers.table_sizes(read).select("table_name", F.col("n_rows").alias("all")), "table_name").select(
        "table_name", "column_name", F.col("all").alias("n_rows"))


@query("s1_mixed_files", """
SELECT c.column_name, c.data_type, c.n_types::BIGINT AS n_types, n.n AS n_rows FROM (VALUES
  ('event_id', 'bigint', 1, 2), ('value', 'double', 2, 0), ('value', 'string', 2, 1), ('props', 'string', 1, 1)) c(column_name, data_type, n_types, k)
JOIN (SELECT 0 AS k, count(*) FILTER (event_id % 2 = 0) AS n FROM events UNION ALL SELECT 1, count(*) FILTER (event_id % 2 = 1) FROM events
  UNION ALL SELECT 2, count(*) FROM events) n USING (k)""")
def _(d):
    """A folder whose files have two schemas: one column with two types, and one that only half of the files have."""
    path = work_path(d.spark, "mixed")
    events = d.table("events")
    events.filter("event_id % 2 = 0").select("event_id", "value").write.parquet(path)
    events.filter("event_id % 2 = 1").select("event_id", F.col("value").cast("string").alias("value"), "props").write.mode("append").parquet(path)
    read = footers.footers(footers.files_of(d.spark, {"mixed": path}))
    return footers.file_columns(read).select("column_name", "data_type", "n_types", "n_rows")


@query("s2_listed_types", """
SELECT item_key, table_name, column_name, CASE WHEN type_text IS NULL OR type_text = '' THEN type_name ELSE type_text END AS data_type
FROM listing""")
def _(d):
    return discover.typed(d.listing).select(KEY, "table_name", "column_name", "data_type")


@query("s3_typed_columns", """
SELECT item_key, table_name, column_name, coalesce(nullif(type_text, ''), type_name) AS data_type FROM listing
WHERE column_name <> '' AND column_name NOT LIKE '#%' AND coalesce(nullif(type_text, ''), type_name) <> ''""")
def _(d):
    return discover.with_type_only(discover.typed(d.listing)).select(KEY, "table_name", "column_name", "data_type")


@query("s4_prior_results", "SELECT * FROM prior")
def _(d):
    return tables.prior_results(d.prior)


@query("s5_prior_tags", "SELECT table_name, column_name, class_tag, confidence FROM prior")
def _(d):
    return tables.prior_tags(d.prior)


@query("s6_audit_history", f"SELECT {SQL_AUDIT} FROM aud ORDER BY timestamp DESC, governance_decision_id DESC")
def _(d):
    return tables.audit_history(d.audit, d.as_of)


@query("s7_audit_decode", f"""
SELECT governance_decision_id, CASE WHEN event_id % 9 IN (0, 1) THEN {AS_OF} ELSE date_trunc('second', ts) END AS timestamp
FROM (SELECT event_id, ts, concat('GD-', CAST(event_id AS VARCHAR)) AS governance_decision_id FROM events)""")
def _(d):
    event = F.col("event_id")
    text = F.when(event % 9 == 0, "not a time").when(event % 9 == 1, F.lit(None)).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    raw = d.table("events").select(
        F.concat(F.lit("GD-"), event.cast("string")).alias("governance_decision_id"), text.alias("timestamp"))
    return log.decode(raw, d.as_of)


@query("s8_table_list", "SELECT DISTINCT schema_name, table_name FROM inv")
def _(d):
    return discover.table_list(d.inventory)


@query("s9_table_changes", """
SELECT schema_name, table_name, governance_decision_id, timestamp, user_email, decision,
  CAST(row_number() OVER (PARTITION BY schema_name, table_name ORDER BY timestamp DESC, governance_decision_id DESC) AS INTEGER) AS change_number
FROM aud QUALIFY change_number <= 10""")
def _(d):
    return log.table_changes(d.audit).select(
        "schema_name", "table_name", "governance_decision_id", "timestamp", "user_email", "decision", "change_number")


@query("s10_table_health", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, true AS is_readable, count(*) AS n_rows FROM {t}" for t in TABLES))
def _(d):
    for name in TABLES:
        d.table(name).createOrReplaceTempView(f"wardline_{name}")
    health = tables.table_health(d.spark, [f"wardline_{t}" for t in TABLES]).drop("error")
    return health.withColumn("table_name", F.regexp_replace("table_name", "^wardline_", ""))


@query("s11_current_queue", f"SELECT {SQL_QUEUE}, n_decisions FROM st")
def _(d):
    return tables.current_queue(d.queue, d.decisions, KEY).select(*QUEUE_COLUMNS, "n_decisions")


# --- sinks -----------------------------------------------------------------------------------------------------


def _bootstrapped(d: Derived, df: DataFrame, schema, name: str) -> DataFrame:
    """Create the table, try to create it again, read it back."""
    target = work_path(d.spark, name)
    sinks.bootstrap(df, schema, target)
    sinks.bootstrap(df, schema, target)
    return d.spark.read.schema(schema).parquet(target)


@query("k1_bootstrap_results", "SELECT * FROM prior")
def _(d):
    return _bootstrapped(d, d.prior, schemas.CLASSIFICATION_RESULTS, "results")


@query("k2_bootstrap_audit", f"SELECT {SQL_AUDIT} FROM aud")
def _(d):
    return _bootstrapped(d, d.audit, schemas.GOVERNANCE_AUDIT, "audit")


@query("k3_bootstrap_inventory", """
SELECT 'files' AS catalog_name, schema_name, table_name, column_name, data_type, false AS is_partition, 0 AS ordinal FROM inv""")
def _(d):
    rows = d.inventory.withColumns(
        {"catalog_name": F.lit("files"), "is_partition": F.lit(False), "ordinal": F.lit(0)})
    return _bootstrapped(d, rows, schemas.COLUMN_INVENTORY, "inventory")


@query("k4_append_audit", f"SELECT {SQL_AUDIT} FROM aud")
def _(d):
    """The stored rows after a part of the log was appended, then all of it, then all again under the same name."""
    target = work_path(d.spark, "log")
    sinks.append_audit(d.audit.filter(F.col("governance_decision_id") < "GD-6"), target)
    for _ in range(2):
        sinks.append_audit(d.audit, target, "all")
    return sinks.stored_audit(d.spark, target)


@query("k5_tag_write_back", """
SELECT schema_name, table_name, column_name, new_tag AS tag, user_email, timestamp AS ts, governance_decision_id AS decision_id
FROM aud WHERE decision IN ('APPROVE', 'MODIFY')
QUALIFY row_number() OVER (PARTITION BY schema_name, table_name, column_name ORDER BY timestamp DESC, governance_decision_id DESC) = 1""")
def _(d):
    target = work_path(d.spark, "tags")
    sinks.append_tag_events(decide.tag_events(d.audit), target)
    return cat.current_tags(d.spark.read.schema(schemas.COLUMN_TAG_EVENT).parquet(target))


@query("k5_failed_writes", """
SELECT schema_name, table_name, column_name, new_tag AS tag, governance_decision_id AS decision_id, 'FAILED: no such column' AS outcome
FROM aud WHERE decision IN ('APPROVE', 'MODIFY') AND (schema_name, table_name, column_name) NOT IN (
  SELECT (schema_name, table_name, column_name) FROM inv WHERE item_key % 8 <> 0)""")
def _(d):
    """Tag writes to columns that are gone are returned with their outcome; the others are written."""
    left = d.inventory.filter(F.col(KEY) % 8 != 0)
    failed = sinks.write_tags(decide.tag_events(d.audit), left, work_path(d.spark, "tags"))
    return failed.select("schema_name", "table_name", "column_name", "tag", "decision_id", "outcome")


@query("k6_export_audit_csv", f"""
SELECT * REPLACE (nullif(comments, '') AS comments) FROM (SELECT {SQL_AUDIT} FROM aud WHERE decision IN ('APPROVE', 'MODIFY'))""")
def _(d):
    target = work_path(d.spark, "audit-csv")
    rows = log.filter_audit(d.audit, decisions=["APPROVE", "MODIFY"])
    sinks.export_csv(sinks.shaped(rows, schemas.GOVERNANCE_AUDIT), target)
    return sinks.read_csv(d.spark, target, schemas.GOVERNANCE_AUDIT)


@query("k7_export_queue_csv", f"""
SELECT {SQL_QUEUE}, concat('[{{"stage":"Column Discovered in Live Catalog","timestamp":"', strftime(submitted_time, '%Y-%m-%d %H:%M'),
  '"}},{{"stage":"AI Classified","timestamp":"', strftime(submitted_time, '%Y-%m-%d %H:%M'), '"}}]') AS governance_timeline FROM q""")
def _(d):
    target = work_path(d.spark, "queue-csv")
    rows = d.queue.select(*QUEUE_COLUMNS, "governance_timeline")
    sinks.export_csv(rows, target)
    flat = schemas.StructType(
        [schemas.StructField(f.name, schemas.TEXT if f.name == "governance_timeline" else f.dataType)
         for f in rows.schema.fields])
    return sinks.read_csv(d.spark, target, flat)


# --- derived columns -------------------------------------------------------------------------------------------


@query("p1_normalised_keys", """
SELECT trim(lower(table_name)) AS t_key, trim(lower(column_name)) AS c_key, count(*) AS n FROM prior GROUP BY ALL""")
def _(d):
    return classify.with_keys(d.prior).groupBy("t_key", "c_key").agg(F.count(F.lit(1)).alias("n"))


@query("p2_item_id", "SELECT item_key, concat('live-', schema_name, '-', table_name, '-', column_name) AS id FROM inv")
def _(d):
    return d.inventory.select(KEY, c.item_id("schema_name", "table_name", "column_name").alias("id"))


@query("p3_domain", """
SELECT item_key, CASE schema_name WHEN 'clinical' THEN 'Clinical' WHEN 'revenue_cycle' THEN 'Revenue Cycle'
  WHEN 'hr_db' THEN 'Hr Db' ELSE 'Brz' END AS domain FROM inv""")
def _(d):
    return d.inventory.select(KEY, c.domain("schema_name").alias("domain"))


@query("p4_tag_category", """
SELECT class_tag, CASE WHEN lower(class_tag) LIKE '%pii%' THEN 'PII' WHEN lower(class_tag) LIKE '%phi%' THEN 'PHI'
  WHEN lower(class_tag) LIKE '%financial%' THEN 'Financial' ELSE 'Sensitive' END AS category, count(*) AS n FROM prior GROUP BY ALL""")
def _(d):
    return d.prior.groupBy("class_tag", c.tag_category("class_tag").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("p5_confidence", """
SELECT table_name, column_name, coalesce(TRY_CAST(confidence AS DOUBLE), 0.9::DOUBLE) AS confidence FROM prior""")
def _(d):
    return d.prior.select("table_name", "column_name", c.confidence("confidence").alias("confidence"))


@query("p6_prior_priority", """
SELECT table_name, column_name, CASE WHEN x >= 0.95 THEN 'Critical' WHEN x >= 0.85 THEN 'High' ELSE 'Medium' END AS priority
FROM (SELECT *, coalesce(TRY_CAST(confidence AS DOUBLE), 0.9::DOUBLE) AS x FROM prior)""")
def _(d):
    return d.prior.select("table_name", "column_name", c.prior_priority(c.confidence("confidence")).alias("priority"))


@query("p7_recommendation", """
SELECT id, CASE WHEN confidence_score >= 0.95 THEN 'Auto-Approve' ELSE 'Review Recommended' END AS supervisor_recommendation FROM q""")
def _(d):
    return d.queue.select("id", c.recommendation("confidence_score").alias("supervisor_recommendation"))


@query("p8_prior_texts", """
SELECT t_key, c_key, concat('Classified as ', upper(prior_tag)) AS native_classification,
  'Discovered pre-existing classification in classification_results metadata table.' AS ai_explanation
FROM best_prior WHERE usable""")
def _(d):
    usable = classify.latest_prior(d.prior).filter(~c.is_blank_tag("prior_tag"))
    return usable.select("t_key", "c_key", c.prior_native_class("prior_tag").alias("native_classification"),
                         F.lit(ref.PRIOR_EXPLANATION).alias("ai_explanation"))


@query("p9_masking_policy", "SELECT schema_name, table_name, column_name, masking_policy FROM cat")
def _(d):
    return d.catalog.select("schema_name", "table_name", "column_name", "masking_policy")


@query("p10_access_policy", "SELECT schema_name, table_name, column_name, abac_policy FROM cat")
def _(d):
    return d.catalog.select("schema_name", "table_name", "column_name", "abac_policy")


@query("p11_catalog_status", "SELECT schema_name, table_name, column_name, status, class_date, last_reviewer FROM cat")
def _(d):
    return d.catalog.select("schema_name", "table_name", "column_name", "status", "class_date", "last_reviewer")


@query("p12_initial_timeline", """
SELECT id, unnest([1, 2]) AS step, unnest(['Column Discovered in Live Catalog', 'AI Classified']) AS stage,
  strftime(submitted_time, '%Y-%m-%d %H:%M') AS stage_time FROM q""")
def _(d):
    rows = d.queue.select("id", F.posexplode("governance_timeline").alias("position", "entry"))
    return rows.select("id", (F.col("position") + 1).alias("step"), F.col("entry.stage").alias("stage"),
                       F.col("entry.timestamp").alias("stage_time"))


@query("p13_queue_rows", """
SELECT id AS "ID", schema_name AS "Schema", table_name AS "Table", column_name AS "Column", suggested_tag AS "Suggested Tag",
  confidence_score AS "Confidence", priority AS "Priority", category AS "Category", domain AS "Domain", status AS "Status",
  strftime(submitted_time, '%Y-%m-%d %H:%M') AS "Submitted" FROM st""")
def _(d):
    return queue.display_rows(d.state)


@query("p14_audit_rows", """
SELECT governance_decision_id AS "Decision ID", strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS "Timestamp", user_email AS "Reviewer",
  schema_name AS "Schema", table_name AS "Table", column_name AS "Column", previous_tag AS "Previous Tag", new_tag AS "New Tag",
  ai_recommendation AS "AI Suggestion", concat(CAST(CAST(round_even(confidence_score * 100, 0) AS INTEGER) AS VARCHAR), '%') AS "AI Confidence",
  decision AS "Decision", approval_duration AS "Duration", approval_method AS "Method",
  CASE WHEN comments IS NULL OR comments = '' THEN '—' ELSE comments END AS "Comments" FROM aud""")
def _(d):
    return log.display_rows(d.audit)


@query("p15_filled_tags", """
SELECT item_key, table_name, column_name, CASE WHEN regexp_matches(lower(x), '^(none|unclassified)?$') THEN coalesce(r.tag, '') ELSE x END AS tag
FROM (SELECT c.item_key, c.table_name, c.column_name, k.catalog_rule, CASE WHEN c.status = 'Classified' AND c.item_key % 4 <> 0 THEN c.tag ELSE '' END AS x
      FROM cat c JOIN ruled k USING (item_key)) LEFT JOIN rules r ON r.rule = catalog_rule""")
def _(d):
    view = cat.catalog_view(d.inventory, d.prior, keep=(KEY,))
    lost = view.withColumn("tag", F.when(F.col(KEY) % 4 != 0, F.col("tag")).otherwise(""))
    return cat.filled_tags(lost).select(KEY, "table_name", "column_name", "tag")


@query("p16_search_category", """
SELECT tag, CASE WHEN lower(tag) LIKE '%pii%' THEN 'PII' WHEN lower(tag) LIKE '%phi%' THEN 'PHI' WHEN lower(tag) LIKE '%pci%' THEN 'Financial'
  ELSE 'Other' END AS category, count(*) AS n FROM cat GROUP BY ALL""")
def _(d):
    return d.catalog.groupBy("tag", c.search_category("tag").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("p17_confidence_band", """
SELECT id, CASE WHEN confidence_score >= 0.90 THEN 'high' WHEN confidence_score >= 0.70 THEN 'medium' ELSE 'low' END AS band FROM q""")
def _(d):
    return d.queue.select("id", c.confidence_band("confidence_score").alias("band"))


@query("p18_category_label", """
SELECT id, CASE category WHEN 'PII' THEN 'PII' WHEN 'PHI' THEN 'PHI' WHEN 'Financial' THEN 'Financial' ELSE category END AS label FROM q""")
def _(d):
    return d.queue.select("id", c.category_label("category").alias("label"))


@query("p19_status_label", """
SELECT status, CASE status WHEN 'PENDING' THEN 'Pending Review' WHEN 'APPROVED' THEN 'Approved' WHEN 'REJECTED' THEN 'Rejected'
  WHEN 'ESCALATED' THEN 'Escalated' WHEN 'Classified' THEN 'Classified' ELSE 'Unclassified' END AS label, count(*) AS n
FROM (SELECT status FROM st UNION ALL SELECT status FROM cat) GROUP BY ALL""")
def _(d):
    both = d.state.select("status").unionByName(d.catalog.select("status"))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("label", c.status_label("status"))


@query("p20_percent_text", """
SELECT id, concat(CAST(CAST(round_even(confidence_score * 100, 1) AS DECIMAL(6,1)) AS VARCHAR), '%') AS confidence_text FROM q""")
def _(d):
    return d.queue.select("id", c.percent_text("confidence_score").alias("confidence_text"))


@query("p22_role", "SELECT decision_key, user_email, role FROM dec")
def _(d):
    return d.decisions.select("decision_key", "user_email", c.role_of("user_email").alias("role"))


# --- filters ---------------------------------------------------------------------------------------------------


@query("f1_discoverable", """
SELECT item_key, table_name, column_name FROM listing
WHERE column_name <> '' AND column_name NOT LIKE '#%' AND table_name <> 'classification_results'""")
def _(d):
    return classify.discoverable(d.listing).select(KEY, "table_name", "column_name")


@query("f2_tagged_only", "SELECT id, suggested_tag FROM q")
def _(d):
    rows = classify.tagged_only(classify.merged(d.inventory, d.prior))
    return rows.select(c.item_id("schema_name", "table_name", "column_name").alias("id"), "suggested_tag")


@query("f3_results_table_view", """
SELECT l.item_key, l.column_name, CASE WHEN l.table_name = 'classification_results' THEN '' ELSE coalesce(k.tag, '') END AS tag,
  CASE WHEN l.table_name = 'classification_results' OR k.tag IS NULL THEN 'Unclassified' ELSE 'Classified' END AS status
FROM (SELECT *, coalesce(nullif(type_text, ''), type_name) AS data_type FROM listing) l
JOIN ruled r USING (item_key) LEFT JOIN rules k ON k.rule = r.catalog_rule
WHERE l.column_name <> '' AND l.column_name NOT LIKE '#%' AND l.data_type <> ''""")
def _(d):
    none = d.prior.filter(F.lit(False))
    return cat.catalog_view(discover.typed(d.listing), none, keep=(KEY,)).select(KEY, "column_name", "tag", "status")


@query("f4_queue_filter", f"""
SELECT {SQL_ITEM} FROM st WHERE schema_name IN ('clinical', 'hr_db') AND priority IN ('Critical', 'High') AND category IN ('PHI', 'PII')
  AND status IN ('PENDING', 'ESCALATED')""")
def _(d):
    return queue.filter_queue(d.state, schemas=["clinical", "hr_db"], priorities=["Critical", "High"],
                              categories=["PHI", "PII"], statuses=["PENDING", "ESCALATED"]).select(*ITEM_COLUMNS)


@query("f5_column_pattern", f"""
SELECT {SQL_ITEM} FROM st WHERE status = 'PENDING' AND regexp_matches(column_name, '^(ssn|phone).*[05]$', 'i')""")
def _(d):
    return queue.filter_queue(d.state, column_pattern="^(SSN|phone).*[05]$").select(*ITEM_COLUMNS)


@query("f6_min_confidence", f"SELECT {SQL_ITEM} FROM st WHERE status = 'PENDING' AND confidence_score >= 0.93")
def _(d):
    return queue.filter_queue(d.state, min_confidence=0.93).select(*ITEM_COLUMNS)


@query("f7_audit_filter", f"""
SELECT {SQL_AUDIT} FROM aud WHERE decision IN ('APPROVE', 'REJECT') AND schema_name = 'brz' AND approval_method = 'Manual Steward Review'""")
def _(d):
    return log.filter_audit(d.audit, decisions=["APPROVE", "REJECT"], schemas=["brz"],
                            methods=["Manual Steward Review"])


@query("f8_audit_keyword", f"""
SELECT {SQL_AUDIT} FROM aud WHERE regexp_matches(lower(column_name), 'dob|"k": 1') OR regexp_matches(lower(table_name), 'dob|"k": 1')
  OR regexp_matches(lower(coalesce(comments, '')), 'dob|"k": 1')""")
def _(d):
    return log.filter_audit(d.audit, keyword='DOB|"k": 1')


@query("f9_catalog_search", """
SELECT schema_name, table_name, column_name, tag, masking_policy, abac_policy, class_date, last_reviewer, status FROM cat
WHERE contains(schema_name, 'phone') OR contains(table_name, 'phone') OR contains(column_name, 'phone') OR contains(lower(tag), 'phone')""")
def _(d):
    return cat.search(d.catalog, "Phone").drop("data_type")


@query("f10_column_metadata", """
SELECT schema_name, table_name, column_name, tag, status FROM cat ORDER BY schema_name, table_name, column_name LIMIT 1""")
def _(d):
    path = ["schema_name", "table_name", "column_name"]
    first = d.inventory.agg(F.min(F.struct(*path)).alias("p")).scalar()
    return cat.column_metadata(d.catalog, *(first[name] for name in path)).select(*path, "tag", "status")


@query("f11_item_by_id", "SELECT id, suggested_tag, status FROM st WHERE id = (SELECT min(id) FROM q WHERE base_name = 'ssn')")
def _(d):
    named = d.inventory.filter("base_name = 'ssn'")
    first = named.agg(F.min(c.item_id("schema_name", "table_name", "column_name"))).scalar()
    return queue.by_id(d.state, first).select("id", "suggested_tag", "status")


@query("f9_indexed_search", """
SELECT schema_name, table_name, column_name, tag, masking_policy, abac_policy, class_date, last_reviewer, status FROM cat
WHERE contains(schema_name, 'phone') OR contains(table_name, 'phone') OR contains(column_name, 'phone') OR contains(lower(tag), 'phone')""")
def _(d):
    """The same rows through the index of the catalog's texts."""
    path = work_path(d.spark, "search")
    search_index.build(d.catalog.drop("data_type"), ("schema_name", "table_name", "column_name", "tag"), path)
    return search_index.Index(d.spark, path).search("Phone")


@query("f10_stored_metadata", """
SELECT schema_name, table_name, column_name, tag, status FROM cat ORDER BY schema_name, table_name, column_name LIMIT 1""")
def _(d):
    """The same entry from the stored catalog, of which one bucket is read."""
    target = work_path(d.spark, "catalog")
    tag_store.load(d.catalog, target)
    first = d.inventory.agg(F.min(F.struct("schema_name", "table_name", "column_name")).alias("p")).first()["p"]
    return tag_store.column_metadata(d.spark, target, *first).select("schema_name", "table_name", "column_name", "tag", "status")


@query("f11_stored_item", "SELECT id, suggested_tag, status FROM st WHERE id = (SELECT min(id) FROM q WHERE base_name = 'ssn')")
def _(d):
    """The same item from the stored queue, of which one bucket is read."""
    rows = d.state.select("id", "suggested_tag", "status")
    table = commits.Keyed(d.spark, work_path(d.spark, "queue"), ["id"])
    table.upsert(rows)
    named = d.inventory.filter("base_name = 'ssn'")
    first = named.agg(F.min(c.item_id("schema_name", "table_name", "column_name")).alias("id")).first()["id"]
    return table.get(rows.schema, first)


@query("f12_alerts", f"SELECT {SQL_ITEM} FROM st WHERE status = 'PENDING' AND confidence_score < 0.70")
def _(d):
    return queue.alerts(d.state).select(*ITEM_COLUMNS)


@query("f13_explorer_masks", """
SELECT schema_name, table_name, column_name, contains(lower(tag), 'pii') AS is_pii, contains(lower(tag), 'phi') AS is_phi,
  contains(lower(tag), 'financial') AS is_financial, NOT regexp_matches(lower(tag), 'pii|phi|financial') AS is_unclassified FROM cat""")
def _(d):
    return cat.explorer_masks(d.catalog).select(
        "schema_name", "table_name", "column_name", "is_pii", "is_phi", "is_financial", "is_unclassified")


@query("f14_explorer_rows", "SELECT schema_name, table_name, column_name, tag, masking_policy, class_date, status FROM cat WHERE tag <> ''")
def _(d):
    return cat.explorer_rows(d.catalog).select(
        "schema_name", "table_name", "column_name", "tag", "masking_policy", "class_date", "status")


# --- classification --------------------------------------------------------------------------------------------

SQL_RULED = """
SELECT item_key, rule_tag, rule_category, rule_confidence, rule_priority, rule_native_class, rule_explanation FROM classified"""
RULE_COLUMNS = [f"rule_{f}" for f in classify.RULE_FIELDS]


@query("c1_rule_classifier", SQL_RULED)
def _(d):
    return classify.classify(d.inventory).select(KEY, *RULE_COLUMNS)


@query("c1_rule_table_classifier", SQL_RULED)
def _(d):
    rules = classify.rule_table(d.spark)
    return classify.classify_by_table(d.inventory, rules).select(KEY, *RULE_COLUMNS)


@query("c1_large_rule_table", """
SELECT i.item_key, min(p_partkey)::INTEGER AS rule_number, concat('part:', min(p_partkey)) AS rule_tag
FROM inv i JOIN part ON contains(i.column_name, concat('_', p_partkey)) OR contains(i.column_name, concat(p_partkey, p_partkey % 7))
GROUP BY ALL""")
def _(d):
    """A rule for each part: two keywords made of its number."""
    number = F.col("p_partkey")
    rules = d.table("part").select(
        number.cast("int").alias("rule_order"),
        F.array(F.concat(F.lit("_"), number), F.concat(number, number % 7)).alias("keywords"),
        F.concat(F.lit("part:"), number).alias("tag"), F.lit("Part").alias("category"), F.lit(0.5).alias("confidence"),
        F.lit("Low").alias("priority"), F.lit("Part").alias("native_class"), F.lit("Part number.").alias("explanation"))
    found = classify.classify_by_table(d.inventory, rules)
    return found.filter(F.col("rule_number").isNotNull()).select(KEY, "rule_number", "rule_tag")


@query("c2_catalog_classifier", """
SELECT item_key, catalog_rule_tag AS tag, coalesce(catalog_category, 'Unknown') AS category FROM classified""")
def _(d):
    ruled = classify.classify(d.inventory, ref.CATALOG_RULES)
    return ruled.select(KEY, F.coalesce("rule_tag", F.lit("")).alias("tag"), F.col("rule_category").alias("category"))


@query("c3_prior_overrides", """
SELECT item_key, from_prior, suggested_tag, category, confidence_score, priority, native_classification, ai_explanation FROM merged""")
def _(d):
    return classify.merged(d.inventory, d.prior).select(
        KEY, "from_prior", "suggested_tag", "category", "confidence_score", "priority", "native_classification",
        "ai_explanation")


@query("c4_catalog_view", """
SELECT schema_name, table_name, column_name, tag, masking_policy, abac_policy, class_date, last_reviewer, status, data_type FROM cat""")
def _(d):
    return d.catalog


@query("c5_review_queue", f"SELECT item_key, {SQL_QUEUE}, confidence_score AS concept_confidence FROM q")
def _(d):
    return d.queue.select(KEY, *QUEUE_COLUMNS, "concept_confidence")


# --- joins -----------------------------------------------------------------------------------------------------


@query("j1_inventory_with_prior", """
SELECT i.item_key, p.prior_tag, p.prior_conf AS prior_confidence FROM inv i
LEFT JOIN best_prior p ON p.t_key = i.table_name AND p.c_key = i.column_name""")
def _(d):
    return classify.join_prior(d.inventory, d.prior).select(KEY, "prior_tag", "prior_confidence")


@query("j2_catalog_with_prior", """
SELECT i.item_key, coalesce(nullif(p.prior_tag, ''), '(none)') AS prior_tag FROM inv i
LEFT JOIN best_prior p ON p.t_key = i.table_name AND p.c_key = i.column_name""")
def _(d):
    """The join of j1 as the catalog shows it: a column without a tag says so. Its keys are those of the given tables, not skewed."""
    joined = classify.join_prior(d.inventory, d.prior)
    return joined.select(KEY, F.coalesce(F.nullif(F.col("prior_tag"), F.lit("")), F.lit("(none)")).alias("prior_tag"))


@query("j3_rule_hits", """
SELECT r.tag, count(*) AS n_columns FROM ruled i JOIN rules r USING (rule) GROUP BY ALL""")
def _(d):
    hit = classify.classify(d.inventory).filter(F.col("rule_number").isNotNull())
    return hit.groupBy(F.col("rule_tag").alias("tag")).agg(F.count(F.lit(1)).alias("n_columns"))


@query("j4_selected_items", f"SELECT {SQL_ITEM} FROM q WHERE item_key IN (SELECT item_key FROM dec WHERE action = 'Approve Recommendation')")
def _(d):
    ids = d.decisions.filter(F.col("action") == "Approve Recommendation")
    return queue.selected(d.queue, ids, KEY).select(*ITEM_COLUMNS)


@query("j5_similar_links", """
WITH per_tbl AS (SELECT base_name AS name, concat(schema_name, '.', table_name) AS tbl, min(suggested_tag) AS tag, min(column_name) AS col
  FROM q GROUP BY ALL),
heads AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tbl) AS r FROM per_tbl QUALIFY r <= 4),
links AS (SELECT q.id, concat(h.tbl, '.', h.col) AS name, CASE WHEN h.tag = q.suggested_tag THEN 97.0 ELSE 90.0 END::DOUBLE AS similarity
  FROM q JOIN heads h ON h.name = q.base_name AND h.tbl <> concat(q.schema_name, '.', q.table_name)
  QUALIFY row_number() OVER (PARTITION BY q.item_key ORDER BY h.tbl) <= 3),
paths AS (SELECT concat(schema_name, '.', table_name, '.', column_name) AS path, min(id) AS linked_id FROM q WHERE priority = 'Critical' GROUP BY ALL)
SELECT l.id, l.name, l.similarity, p.linked_id, p.linked_id IS NULL AS already_reviewed
FROM links l JOIN q USING (id) LEFT JOIN paths p ON p.path = l.name WHERE q.priority = 'Critical'""")
def _(d):
    """The similar columns that the engine finds for each item, with the items behind them in the list of critical ones."""
    items = classify.review_queue(d.inventory, d.prior, F.col("submitted_time"), keep=(KEY, "base_name"))
    found = monitor.similar_columns(items, items.withColumn("tag", F.col("suggested_tag")), "base_name")
    return queue.similar_links(monitor.with_similar(found).filter(F.col("priority") == "Critical"))


@query("j6_permissions", """
SELECT role, 'approve_reject' AS permission, allowed, count(*) AS n FROM dec GROUP BY ALL
UNION ALL SELECT role, 'trigger_orchestrator', role <> 'Read-only Analyst', count(*) FROM dec GROUP BY ALL
UNION ALL SELECT role, 'unheard_of', false, count(*) FROM dec GROUP BY ALL""")
def _(d):
    wanted = F.array(F.lit("approve_reject"), F.lit("trigger_orchestrator"), F.lit("unheard_of"))
    asked = d.decisions.withColumn("wanted", F.explode(wanted))
    return decide.with_permission(asked, F.col("wanted")).groupBy("role", "permission", "allowed").agg(
        F.count(F.lit(1)).alias("n"))


SQL_TAG_WRITES = """
w AS (SELECT schema_name, table_name, column_name, new_tag, user_email, timestamp FROM aud WHERE decision IN ('APPROVE', 'MODIFY')
  QUALIFY row_number() OVER (PARTITION BY schema_name, table_name, column_name ORDER BY timestamp DESC, governance_decision_id DESC) = 1),
x AS (SELECT schema_name, table_name, CASE WHEN item_key % 8 = 0 THEN concat(column_name, '_new') ELSE column_name END AS column_name,
  tag, masking_policy, abac_policy, class_date, last_reviewer, status FROM cat)"""


@query("j7_tag_upsert", f"""
WITH {SQL_TAG_WRITES}
SELECT schema_name, table_name, column_name, coalesce(w.new_tag, x.tag) AS tag, coalesce(x.masking_policy, 'None') AS masking_policy,
  coalesce(x.abac_policy, 'None') AS abac_policy, coalesce(strftime(w.timestamp, '%Y-%m-%d'), x.class_date) AS class_date,
  coalesce(w.user_email, x.last_reviewer) AS last_reviewer, CASE WHEN w.new_tag IS NOT NULL THEN 'Classified' ELSE x.status END AS status
FROM x FULL OUTER JOIN w USING (schema_name, table_name, column_name)""")
def _(d):
    """Some columns are renamed first, so that writes meet known and unknown columns."""
    known = cat.catalog_view(d.inventory, d.prior, keep=(KEY,))
    renamed = F.when(F.col(KEY) % 8 == 0, F.concat("column_name", F.lit("_new"))).otherwise(F.col("column_name"))
    known = known.withColumn("column_name", renamed).drop(KEY)
    return cat.upsert_tags(known, decide.tag_events(d.audit)).drop("data_type")


@query("j7_tag_table", f"""
WITH {SQL_TAG_WRITES}
SELECT schema_name, table_name, column_name, coalesce(w.new_tag, x.tag) AS tag, coalesce(x.masking_policy, 'None') AS masking_policy,
  coalesce(x.abac_policy, 'None') AS abac_policy, coalesce(strftime(w.timestamp, '%Y-%m-%d'), x.class_date) AS class_date,
  coalesce(w.user_email, x.last_reviewer) AS last_reviewer, CASE WHEN w.new_tag IS NOT NULL THEN 'Classified' ELSE x.status END AS status
FROM x FULL OUTER JOIN w USING (schema_name, table_name, column_name)""")
def _(d):
    """The stored catalog after two batches of tag writes out of time order, of which the second repeats much of the first."""
    known = cat.catalog_view(d.inventory, d.prior, keep=(KEY,))
    renamed = F.when(F.col(KEY) % 8 == 0, F.concat("column_name", F.lit("_new"))).otherwise(F.col("column_name"))
    target = work_path(d.spark, "tag-table")
    tag_store.load(known.withColumn("column_name", renamed), target)
    written = decide.tag_events(d.audit)
    tag_store.write_tags(written.filter(F.col("decision_id") >= "GD-8"), target, "first")
    for _ in range(2):
        tag_store.write_tags(written.filter(F.col("decision_id") < "GD-b"), target, "second")
    return tag_store.read(d.spark, target).drop("data_type")


# --- aggregations ----------------------------------------------------------------------------------------------


def _figure(name: str, columns: str, body: str) -> None:
    """A query for some figures of the dashboard, from the queue, the log or both, as they need."""
    picked = [part.strip() for part in columns.split(",")]

    def run(d: Derived) -> DataFrame:
        if set(picked) <= set(report.ITEM_FIGURES):
            return report.item_figures(d.state).select(*picked)
        if set(picked) <= set(report.AUDIT_FIGURES):
            return report.audit_figures(d.audit).select(*picked)
        return report.dashboard(d.state, d.audit).select(*picked)

    query(name, body)(run)


_figure("a1_pending", "pending_count", "SELECT pending_count FROM dash")
_figure("a2_approved", "approved_count, approved_items",
        "SELECT approved_items + approve_decisions AS approved_count, approved_items FROM dash")
_figure("a3_rejected", "rejected_count", "SELECT rejected_items + reject_decisions AS rejected_count FROM dash")
_figure("a4_auto_classified", "auto_classified", "SELECT auto_classified FROM dash")
_figure("a5_classified", "classified_cols", "SELECT approved_items + 20 AS classified_cols FROM dash")
_figure("a6_pii_phi", "pii_count, phi_count", "SELECT pii_count, phi_count FROM dash")
_figure("a7_accuracy", "ai_accuracy",
        "SELECT CASE WHEN total_decisions = 0 THEN 0.0::DOUBLE ELSE approve_decisions / total_decisions END AS ai_accuracy FROM dash")
_figure("a8_modify_override", "modify_override_pct",
        "SELECT CASE WHEN total_decisions = 0 THEN 0.0::DOUBLE ELSE modify_decisions / total_decisions * 100 END AS modify_override_pct FROM dash")
_figure("a9_non_approval", "non_approval_pct",
        "SELECT CASE WHEN total_decisions = 0 THEN 0.0::DOUBLE ELSE 100 - approve_decisions / total_decisions * 100 END AS non_approval_pct FROM dash")
_figure("a10_coverage", "coverage_pct", "SELECT (approved_items + 20) / 150 * 100 AS coverage_pct FROM dash")


@query("a_dashboard", """
SELECT pending_count, approved_items, auto_classified, approved_items + 20 AS classified_cols, pii_count, phi_count,
  (approved_items + 20) / 150 * 100 AS coverage_pct, 150 - pii_count - phi_count AS other_count, total_decisions,
  approve_decisions / total_decisions AS ai_accuracy, modify_decisions / total_decisions * 100 AS modify_override_pct,
  100 - approve_decisions / total_decisions * 100 AS non_approval_pct, approved_items + approve_decisions AS approved_count,
  rejected_items + reject_decisions AS rejected_count FROM dash""")
def _(d):
    return report.dashboard(d.state, d.audit)


@query("a11_status_distribution", """
SELECT 'Pending' AS status, pending_count AS n FROM dash UNION ALL SELECT 'Approved', approved_items + approve_decisions FROM dash
UNION ALL SELECT 'Rejected', rejected_items + reject_decisions FROM dash""")
def _(d):
    return report.status_distribution(d.state, d.audit)


@query("a12_pending_by_schema", "SELECT schema_name, count(*) AS n_pending FROM st WHERE status = 'PENDING' GROUP BY ALL")
def _(d):
    return report.pending_by(d.state, "schema_name")


@query("a13_sensitivity_distribution", """
SELECT 'PII' AS sensitivity, pii_count AS n FROM item_counts UNION ALL SELECT 'PHI', phi_count FROM item_counts
UNION ALL SELECT 'Other', 150 - pii_count - phi_count FROM item_counts""")
def _(d):
    return report.sensitivity_distribution(d.state)


@query("a14_decisions_per_day", "SELECT CAST(timestamp AS DATE) AS day, count(*) AS n_decisions FROM aud GROUP BY ALL")
def _(d):
    return report.decisions_per_day(d.audit)


@query("a15_audit_summary", """
SELECT count(*) AS total_records, count(*) FILTER (decision = 'APPROVE') AS approvals, count(*) FILTER (decision = 'REJECT') AS rejections,
  count(*) FILTER (decision = 'MODIFY') AS modifications FROM aud WHERE schema_name IN ('clinical', 'brz')""")
def _(d):
    return log.summary(log.filter_audit(d.audit, schemas=["clinical", "brz"]))


@query("a16_explorer_totals", """
SELECT count(*) AS total_columns, count(*) FILTER (tag ILIKE '%pii%') AS pii_columns, count(*) FILTER (tag ILIKE '%phi%') AS phi_columns,
  count(*) FILTER (tag ILIKE '%financial%') AS financial_columns,
  count(*) FILTER (NOT regexp_matches(lower(tag), 'pii|phi|financial')) AS unclassified_columns,
  count(*) FILTER (tag <> '') / count(*) * 100 AS classified_pct FROM cat""")
def _(d):
    return cat.explorer_totals(d.catalog)


SQL_GROUPS = """
groups AS (SELECT 'PII' AS category, tag FROM cat WHERE tag ILIKE '%pii%' UNION ALL SELECT 'PHI', tag FROM cat WHERE tag ILIKE '%phi%'
  UNION ALL SELECT 'Financial', tag FROM cat WHERE tag ILIKE '%financial%')"""


@query("a17_tags_by_group", f"WITH {SQL_GROUPS} SELECT category, tag, count(*) AS n_columns FROM groups GROUP BY ALL")
def _(d):
    return cat.tags_by_group(d.catalog)


@query("a17_distinct_tags", f"""
WITH {SQL_GROUPS} SELECT category, count(DISTINCT tag) AS n_tags, count(*) AS n_columns FROM groups GROUP BY ALL""")
def _(d):
    return cat.distinct_tags(d.catalog)


@query("a18_pending_by_category", "SELECT category, count(*) AS n_pending FROM st WHERE status = 'PENDING' GROUP BY ALL")
def _(d):
    return report.pending_by(d.state, "category")


@query("a19_catalog_totals", """
SELECT count(*) AS tracked, count(*) FILTER (tag <> '') AS classified, count(*) FILTER (tag = '') AS unclassified FROM cat""")
def _(d):
    return cat.catalog_totals(d.catalog)


@query("a20_total_pending", "SELECT count(*) AS total_pending FROM st WHERE status = 'PENDING'")
def _(d):
    return queue.pending(d.state).agg(F.count(F.lit(1)).alias("total_pending"))


@query("a21_queue_facets", " UNION ".join(f"SELECT '{n}' AS facet, {n} AS value FROM st" for n in queue.QUEUE_FACETS))
def _(d):
    return queue.facets(d.state, queue.QUEUE_FACETS)


@query("a21_audit_facets", " UNION ".join(f"SELECT '{n}' AS facet, {n} AS value FROM aud" for n in queue.AUDIT_FACETS))
def _(d):
    return queue.facets(d.audit, queue.AUDIT_FACETS)


@query("a22_list_sizes", """
SELECT 'search_hits' AS list, count(*) AS n FROM cat WHERE contains(column_name, 'ssn') OR contains(tag, 'ssn')
UNION ALL SELECT 'hidden_unclassified', count(*) FROM cat WHERE NOT regexp_matches(lower(tag), 'pii|phi|financial')
UNION ALL SELECT 'audit_rows', count(*) FROM aud WHERE decision = 'REJECT'
UNION ALL SELECT 'notifications', count(*) FROM st WHERE status = 'PENDING'""")
def _(d):
    return report.list_sizes(d.catalog, d.audit, d.state, "ssn", ["REJECT"])


# --- last write, state, order ----------------------------------------------------------------------------------


@query("w1_last_prior", "SELECT t_key, c_key, prior_tag, prior_conf AS prior_confidence FROM best_prior")
def _(d):
    return classify.latest_prior(d.prior)


SQL_TIMELINE = """t AS (
  SELECT item_key, submitted_time AS event_time, '' AS governance_decision_id, unnest([0, 1]) AS step,
    unnest(['Column Discovered in Live Catalog', 'AI Classified']) AS stage FROM q
  UNION ALL SELECT item_key, timestamp, governance_decision_id, 0, concat('Steward Decision: ', status_after) FROM steps
  UNION ALL SELECT item_key, timestamp, governance_decision_id, unnest([1, 2]),
    unnest(['Policy Applied (ABAC & Masking)', 'Governed View Updated']) FROM steps WHERE status_after = 'APPROVED')"""


@query("w2_timeline", f"WITH {SQL_TIMELINE} SELECT * FROM t")
def _(d):
    return decide.timeline(d.queue, d.decisions, KEY)


@query("w2_repeated_log", f"WITH {SQL_TIMELINE} SELECT * FROM t")
def _(d):
    return decide.timeline(d.queue, d.decisions.unionByName(d.decisions), KEY)


@query("l1_audit_newest_first", "SELECT governance_decision_id, timestamp, decision FROM aud")
def _(d):
    return log.history(d.audit).select("governance_decision_id", "timestamp", "decision")


@query("l2_first_pending", "SELECT id, suggested_tag, priority FROM st WHERE status = 'PENDING' ORDER BY submitted_time, id LIMIT 3")
def _(d):
    return report.first_pending(d.state).select("id", "suggested_tag", "priority")


@query("l3_recent_audit", "SELECT governance_decision_id, decision, approval_duration FROM aud ORDER BY timestamp DESC, governance_decision_id DESC LIMIT 3")
def _(d):
    return log.recent(d.audit, 3).select("governance_decision_id", "decision", "approval_duration")


SQL_LINE = """concat('[', strftime(timestamp, '%Y-%m-%d %H:%M'), '] ', user_email, ' ', decision, ' ', schema_name, '.', table_name, '.',
  column_name, ' -> tag: ', new_tag, ' (confidence: ', CAST(CAST(round_even(confidence_score * 100, 0) AS INTEGER) AS VARCHAR), '%)')"""


@query("l4_recent_decision_lines", f"""
SELECT governance_decision_id, timestamp, {SQL_LINE} AS line FROM aud ORDER BY timestamp DESC, governance_decision_id DESC LIMIT 5""")
def _(d):
    return report.recent_decision_lines(d.audit)


@query("l5_recent_approvals", """
SELECT governance_decision_id, timestamp, new_tag, user_email FROM aud WHERE decision = 'APPROVE'
ORDER BY timestamp DESC, governance_decision_id DESC LIMIT 5""")
def _(d):
    return log.recent(d.audit, 5, "APPROVE").select("governance_decision_id", "timestamp", "new_tag", "user_email")


@query("l6_newest_changes", """
SELECT governance_decision_id, timestamp, table_name FROM aud WHERE schema_name = 'clinical'
ORDER BY timestamp DESC, governance_decision_id DESC LIMIT 10""")
def _(d):
    return log.recent(log.filter_audit(d.audit, schemas=["clinical"]), 10).select(
        "governance_decision_id", "timestamp", "table_name")


@query("l7_notifications", """
SELECT * FROM (SELECT 'alert' AS section, id, table_name, column_name, suggested_tag, confidence_score FROM st
  WHERE status = 'PENDING' AND confidence_score < 0.70 ORDER BY submitted_time, id LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'pending', id, table_name, column_name, suggested_tag, confidence_score FROM st
  WHERE status = 'PENDING' ORDER BY submitted_time, id LIMIT 4)
UNION ALL SELECT * FROM (SELECT 'approved', id, table_name, column_name, suggested_tag, confidence_score FROM st
  WHERE status = 'APPROVED' ORDER BY submitted_time, id LIMIT 2)""")
def _(d):
    return report.notifications(d.state)


@query("l8_tags_in_order", f"""
WITH {SQL_GROUPS} SELECT category, tag, CAST(row_number() OVER (PARTITION BY category ORDER BY tag) AS INTEGER) AS place
FROM (SELECT DISTINCT category, tag FROM groups)""")
def _(d):
    tags = cat.tags_by_group(d.catalog)  # one row per tag and group
    in_order = Window.partitionBy("category").orderBy("tag")
    return tags.withColumn("place", F.row_number().over(in_order)).select("category", "tag", "place")


@query("u1_log_with_new", f"""
SELECT {SQL_AUDIT} FROM aud UNION ALL
SELECT concat('aud-', substr(sha256(k), 1, 12)), concat('GD-', substr(sha256(concat(k, '|steward@example.com')), 1, 12)), {AS_OF},
  'steward@example.com', schema_name, table_name, column_name, suggested_tag, 'None', 'REJECT', 'Bulk rejected via Workbench', suggested_tag,
  confidence_score, '30s', 'Bulk Approval', 'Steward Portal Workspace UI'
FROM (SELECT *, concat('bulk-reject-', CAST(item_key AS VARCHAR), '-2024-02-01 00:00:00') AS k FROM st WHERE status = 'ESCALATED')""")
def _(d):
    """The stored log, the log again and new bulk decisions: old rows stay single, new ones are added."""
    target = work_path(d.spark, "log")
    sinks.append_audit(d.audit, target)
    stored = sinks.stored_audit(d.spark, target)
    escalated = d.state.filter(F.col("status") == "ESCALATED")
    added = decide.bulk_audit(escalated, "reject", "steward@example.com", d.as_of, KEY)
    return log.with_new(stored, stored.unionByName(added))


# --- decisions -------------------------------------------------------------------------------------------------


@query("d1_applied_state", "SELECT id, suggested_tag, status, decided_at, decided_by, n_decisions FROM st")
def _(d):
    return d.state.select("id", "suggested_tag", "status", "decided_at", "decided_by", "n_decisions")


def _repeated(d: Derived) -> DataFrame:
    """The decision log with every row twice, in another order."""
    return d.decisions.unionByName(d.decisions).orderBy(F.xxhash64("decision_key", "user_email"))


@query("d1_repeated_log", "SELECT id, suggested_tag, status, decided_at, decided_by, n_decisions FROM st")
def _(d):
    return decide.apply_decisions(d.queue, _repeated(d), KEY).select(
        "id", "suggested_tag", "status", "decided_at", "decided_by", "n_decisions")


@query("d1_item_timeline", f"""
WITH {SQL_TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY event_time DESC, governance_decision_id DESC, step DESC) AS place
  FROM t QUALIFY place <= 4)
SELECT q.id, string_agg(r.stage, ' > ' ORDER BY place DESC) AS history, max(r.event_time) AS last_event FROM q JOIN r USING (item_key) GROUP BY ALL""")
def _(d):
    """Each item with its last four timeline entries."""
    items = decide.item_timeline(d.queue, d.decisions, KEY, 4)
    entries = F.col("governance_timeline")
    return items.select("id", F.array_join(F.transform(entries, lambda e: e["stage"]), " > ").alias("history"),
                        F.element_at(entries, -1)["event_time"].alias("last_event"))


@query("d1_unknown_items", "SELECT governance_decision_id, item_key, action FROM eff WHERE item_key NOT IN (SELECT item_key FROM q)")
def _(d):
    return decide.unknown_items(d.queue, d.decisions, KEY).select("governance_decision_id", KEY, "action")


@query("d2_resolved_actions", """
SELECT decision_key, governance_decision_id, action, status_after, decision, status_after IS NULL AS is_no_op FROM dec WHERE allowed""")
def _(d):
    rows = decide.resolved(decide.accepted(d.decisions))
    return rows.select("decision_key", "governance_decision_id", "action", "status_after", "decision",
                       F.col("status_after").isNull().alias("is_no_op"))


@query("d2_no_op", "SELECT decision_key, action FROM dec WHERE allowed AND status_after IS NULL")
def _(d):
    return decide.no_op(d.decisions).select("decision_key", "action")


def _bulk_sql(verdict: str, verb: str, decision: str, new_tag: str) -> str:
    return f"""
SELECT concat('GD-', substr(sha256(concat(k, '|steward@example.com')), 1, 12)) AS governance_decision_id, {AS_OF} AS timestamp,
  schema_name, table_name, column_name, suggested_tag AS previous_tag, {new_tag} AS new_tag, '{decision}' AS decision,
  '{verb} via Workbench' AS comments, '30s' AS approval_duration, 'Bulk Approval' AS approval_method
FROM (SELECT *, concat('bulk-{verdict}-', CAST(item_key AS VARCHAR), '-2024-02-01 00:00:00') AS k FROM q WHERE priority = 'Critical')"""


BULK_COLUMNS = ("governance_decision_id", "timestamp", "schema_name", "table_name", "column_name", "previous_tag",
                "new_tag", "decision", "comments", "approval_duration", "approval_method")


@query("d3_bulk_approve", _bulk_sql("approve", "Bulk approved", "APPROVE", "suggested_tag"))
def _(d):
    items = d.queue.filter(F.col("priority") == "Critical")
    return decide.bulk_audit(items, "approve", "steward@example.com", d.as_of, KEY).select(*BULK_COLUMNS)


@query("d4_bulk_reject", _bulk_sql("reject", "Bulk rejected", "REJECT", "'None'"))
def _(d):
    items = d.queue.filter(F.col("priority") == "Critical")
    return decide.bulk_audit(items, "reject", "steward@example.com", d.as_of, KEY).select(*BULK_COLUMNS)


@query("d5_audit_rows", f"SELECT {SQL_AUDIT} FROM aud")
def _(d):
    return d.audit


@query("d5_repeated_log", f"SELECT {SQL_AUDIT} FROM aud")
def _(d):
    return decide.to_audit(d.queue, _repeated(d), KEY)


@query("d6_refused", "SELECT decision_key, user_email, role FROM dec WHERE NOT allowed")
def _(d):
    return decide.refused(d.decisions).select("decision_key", "user_email", "role")


@query("d6_accepted", "SELECT decision_key, user_email FROM dec WHERE allowed")
def _(d):
    return decide.accepted(d.decisions).select("decision_key", "user_email")


# --- questions -------------------------------------------------------------------------------------------------

LIST_COLUMNS = ("schema_name", "table_name", "column_name", "suggested_tag", "confidence_score")
SQL_LIST = ", ".join(LIST_COLUMNS)


@query("q1_question_intents", "SELECT intent, count(*) AS n_questions FROM questions GROUP BY ALL")
def _(d):
    return questions.intent_counts(d.questions)


@query("q1_answered", """
WITH sizes AS (
  SELECT 'pending_phi' AS intent, count(*) AS n FROM st WHERE status = 'PENDING' AND contains(suggested_tag, 'phi')
  UNION ALL SELECT 'pending_pii', count(*) FROM st WHERE status = 'PENDING' AND contains(suggested_tag, 'pii')
  UNION ALL SELECT 'pending_financial', count(*) FROM st WHERE status = 'PENDING' AND category = 'Financial'
  UNION ALL SELECT 'summary', count(*) FROM st WHERE status = 'PENDING'
  UNION ALL SELECT 'recent_approvals', least(5, count(*)) FROM aud WHERE decision = 'APPROVE'
  UNION ALL SELECT 'approval_sla', 4 UNION ALL SELECT 'access_policy', 4 UNION ALL SELECT 'masking', 2)
SELECT question_id, question, intent, coalesce(n, 0) AS n_lines FROM questions LEFT JOIN sizes USING (intent)""")
def _(d):
    return questions.answered(d.questions, d.state, d.audit)


@query("q2_pending_phi", f"SELECT {SQL_LIST} FROM st WHERE status = 'PENDING' AND contains(suggested_tag, 'phi')")
def _(d):
    return questions.pending_with_tag(d.state, "phi").select(*LIST_COLUMNS)


@query("q3_pending_pii", f"SELECT {SQL_LIST} FROM st WHERE status = 'PENDING' AND contains(suggested_tag, 'pii')")
def _(d):
    return questions.pending_with_tag(d.state, "pii").select(*LIST_COLUMNS)


@query("q4_pending_financial", f"SELECT {SQL_LIST} FROM st WHERE status = 'PENDING' AND category = 'Financial'")
def _(d):
    return questions.pending_in_category(d.state, "financial").select(*LIST_COLUMNS)


@query("q5_context_summary", f"""
SELECT 'pending' AS section, category AS key, CAST(count(*) AS VARCHAR) AS value FROM st WHERE status = 'PENDING' GROUP BY category
UNION ALL SELECT 'catalog', 'tracked', CAST(count(*) AS VARCHAR) FROM cat
UNION ALL SELECT 'catalog', 'classified', CAST(count(*) AS VARCHAR) FROM cat WHERE tag <> ''
UNION ALL SELECT 'catalog', 'unclassified', CAST(count(*) AS VARCHAR) FROM cat WHERE tag = ''
UNION ALL SELECT * FROM (SELECT 'recent', governance_decision_id, {SQL_LINE} FROM aud
  ORDER BY timestamp DESC, governance_decision_id DESC LIMIT 5)""")
def _(d):
    return questions.context_summary(d.state, d.catalog, d.audit)


# --- protection ------------------------------------------------------------------------------------------------


@query("r1_mask_people", """
SELECT c_custkey, concat('pt_', sha256(concat('given|', sha256(concat('given|', mrn))))) AS mrn, '***-**-****' AS ssn, concat(birth_date[1:4], '-01-01') AS birth_date,
  'u***@mail.example.com' AS email, concat('***-***-', phone[9:]) AS phone, concat('****', account[14:]) AS account,
  '***masked***' AS c_mktsegment FROM people""")
def _(d):
    return protect.mask_table(d.people, {
        "mrn": "MASK_PATIENT_ID", "ssn": "MASK_FULL_SSN", "birth_date": "MASK_DOB", "email": "MASK_EMAIL",
        "phone": "MASK_LAST_4", "account": "MASK_ACCOUNT", "c_mktsegment": "MASK_SENSITIVE_VALUE"}, "given")


@query("r1_mask_odd_values", """
SELECT c_custkey, '***masked***' AS as_patient, '***masked***' AS as_ssn, '***masked***' AS as_birth, '***masked***' AS as_email,
  '***masked***' AS as_last_4, '***masked***' AS as_account, '***masked***' AS as_unknown, '***-**-****' AS plain_ssn,
  concat(CAST(c_custkey % 60 + 1940 AS VARCHAR), '-01-01') AS slashed_birth FROM customer""")
def _(d):
    """Values without the form that a policy expects are hidden as a whole."""
    number, year = F.col("c_custkey"), (F.col("c_custkey") % 60 + 1940).cast("string")
    odd = d.table("customer").select(
        "c_custkey", F.concat(F.lit("MRN"), number).alias("as_patient"), F.concat(F.lit("ssn "), number).alias("as_ssn"),
        F.concat(F.lit("born "), year).alias("as_birth"), F.concat(F.lit("no mail "), number).alias("as_email"),
        (number % 1000).cast("string").alias("as_last_4"), (number % 1000).cast("string").alias("as_account"),
        "c_name", F.lpad(number.cast("string"), 9, "0").alias("plain_ssn"),
        F.concat(F.lit("01/02/"), year).alias("slashed_birth"))
    return protect.mask_table(odd.withColumnRenamed("c_name", "as_unknown"), {
        "as_patient": "MASK_PATIENT_ID", "as_ssn": "MASK_FULL_SSN", "as_birth": "MASK_DOB", "as_email": "MASK_EMAIL",
        "as_last_4": "MASK_LAST_4", "as_account": "MASK_ACCOUNT", "as_unknown": "NO_SUCH_POLICY", "plain_ssn": "MASK_FULL_SSN",
        "slashed_birth": "MASK_DOB"})


def _masked_sql(text: str) -> str:
    for form, stays in (
        (r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@", r"\1***@"),
        (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "***-**-****"),
        (r"[(]?\d{3}[)]?[. -]\d{3}[. -]\d{4}", "***-***-****"),
        (r"\d{4}[ -]\d{4}[ -]\d{4}[ -](\d{4})", r"**** **** **** \1"),
        (r"(19\d\d|20\d\d)-\d\d-\d\d", r"\1-**-**"),
        (r"(?:\d{1,3}[.]){3}\d{1,3}", "*.*.*.*"),
        (r"[0-9]{5,}([0-9]{4})", r"****\1"),
    ):
        text = f"regexp_replace({text}, '{form}', '{stays}', 'g')"
    return text


@query("r1_mask_documents", f"SELECT doc_id, {_masked_sql('text')} AS text, lang, source, n_chars FROM documents")
def _(d):
    return protect.mask_texts(d.table("documents"), ["text"])


@query("r1_nothing_in_clear", """
SELECT doc_id, 0::BIGINT AS n_long_numbers, 0::BIGINT AS n_mail_names, 0::BIGINT AS n_values,
  length(regexp_replace(text, '[^\\n]', '', 'g')) AS n_line_ends FROM documents""")
def _(d):
    """What masking promises, counted in the masked texts: no run of nine digits, no mail name beyond one character, and
    nothing of the other forms that the value scan looks for."""
    masked = protect.mask_texts(d.table("documents"), ["text"])
    found = sum((F.regexp_count("text", F.lit(p)) for label, _, _, p in ref.VALUE_PATTERNS if label != "email"), F.lit(0))
    return masked.select(
        "doc_id", F.regexp_count("text", F.lit("[0-9]{9}")).cast("long").alias("n_long_numbers"),
        F.regexp_count("text", F.lit("[A-Za-z0-9._%+-]@")).cast("long").alias("n_mail_names"),
        found.cast("long").alias("n_values"),
        F.char_length(F.regexp_replace("text", "[^\\n]", "")).cast("long").alias("n_line_ends"))


# The twin's own patterns: other expressions for the same values.
SQL_PATTERNS = (
    ("email", "pii:email", r"[[:alnum:]._%+-]+@[[:alnum:]-]+([.][[:alnum:]-]+)+"),
    ("ssn", "pii:ssn", r"\d\d\d-\d\d-\d\d\d\d"),
    ("phone", "pii:phone", r"[(]?\d{3}[)]?[. -]\d{3}[. -]\d{4}"),
    ("card_number", "financial:account", r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13}\d?\d?\d?"),
    ("birth_date", "pii:dob", r"(?:19|20)\d\d-\d\d-\d\d"),
    ("ip_address", "pii:address", r"(?:\d{1,3}[.]){3}\d{1,3}"),
)


def _scan_sql(table: str, column: str) -> str:
    parts = []
    for label, tag, pattern in SQL_PATTERNS:
        parts.append(f"""SELECT '{column}' AS column_name, '{label}' AS pattern, '{tag}' AS tag, count({column}) AS n_values,
  count(*) FILTER (n > 0) AS n_rows_hit, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_hits, count(*) FILTER (n > 0) / count({column}) AS hit_rate
FROM (SELECT {column}, len(regexp_extract_all({column}, '{pattern}')) AS n FROM {table})""")
    return " UNION ALL ".join(parts)


@query("r2_scan_documents", _scan_sql("documents", "text"))
def _(d):
    return protect.scan_values(d.table("documents"), ["text"])


@query("r2_scan_pages", f"{_scan_sql('pages', 'url')} UNION ALL {_scan_sql('pages', 'html')}")
def _(d):
    return protect.scan_values(d.table("pages"), ["url", "html"])


SQL_VALID = {
    "email": r"regexp_full_match(v, '[A-Za-z0-9_%+-]+([.][A-Za-z0-9_%+-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?[.])+[A-Za-z]{2,}')",
    "ssn": "v[1:3] NOT IN ('000', '666') AND v[1] <> '9' AND v[5:6] <> '00' AND v[8:] <> '0000'",
    "phone": r"regexp_full_match(regexp_replace(v, '\D', '', 'g'), '[2-9]\d\d[2-9].*') AND regexp_replace(v, '\D', '', 'g')[2:3] <> '11' "
             r"AND regexp_replace(v, '\D', '', 'g')[5:6] <> '11'",
    "card_number": "v[1] BETWEEN '2' AND '6' AND list_sum(list_transform(list_reverse(list_filter(string_split(v, ''), "
                   "lambda c: c BETWEEN '0' AND '9')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT "
                   "ELSE c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "birth_date": "TRY_CAST(v AS DATE) IS NOT NULL",
    "ip_address": "len(list_filter(string_split(v, '.'), lambda p: p::INT > 255 OR (len(p) > 1 AND p[1] = '0'))) = 0",
}


def _valid_sql(table: str, column: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{column}' AS column_name, '{label}' AS pattern, '{tag}' AS tag, count({column}) AS n_values,
  count(*) FILTER (len(m) > 0) AS n_rows_hit, CAST(coalesce(sum(len(m)), 0) AS BIGINT) AS n_hits,
  count(*) FILTER (k > 0) AS n_rows_valid, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_valid
FROM (SELECT *, len(list_filter(m, lambda v: {SQL_VALID[label]})) AS k FROM (
  SELECT {column}, regexp_extract_all({column}, '{pattern}') AS m FROM {table}))""" for label, tag, pattern in SQL_PATTERNS)


@query("r2_valid_documents", _valid_sql("documents", "text"))
def _(d):
    return protect.scan_valid(d.table("documents"), ["text"])


@query("r2_valid_people", f"""
WITH v AS (SELECT concat('4', lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0')) AS card, ssn, birth_date,
  concat(c_custkey % 300, '.', c_custkey % 7, '.0.', c_custkey % 256) AS ip FROM people)
{" UNION ALL ".join(f"SELECT * FROM ({_valid_sql('v', c)}) WHERE pattern = '{p}'"
                   for c, p in (("card", "card_number"), ("ssn", "ssn"), ("birth_date", "birth_date"), ("ip", "ip_address")))}""")
def _(d):
    """Numbers of which some can't be real: card numbers, social security numbers, dates and addresses of the customers."""
    number = F.col("c_custkey")
    values = d.people.select(
        F.concat(F.lit("4"), F.lpad((number * 7919).cast("string"), 12, "0")).alias("card"), "ssn", "birth_date",
        F.concat_ws(".", (number % 300).cast("string"), (number % 7).cast("string"), F.lit("0"), (number % 256).cast("string")).alias("ip"))
    wanted = F.struct("column_name", "pattern").isin(
        *(F.struct(F.lit(c), F.lit(p)) for c, p in (
            ("card", "card_number"), ("ssn", "ssn"), ("birth_date", "birth_date"), ("ip", "ip_address"))))
    return protect.scan_valid(values, ["card", "ssn", "birth_date", "ip"]).filter(wanted)


@query("r2_suggested_tags", """
SELECT * FROM (VALUES ('ssn', 'ssn', 'pii:ssn'), ('birth_date', 'birth_date', 'pii:dob'), ('email', 'email', 'pii:email'),
  ('phone', 'phone', 'pii:phone'), ('account', 'card_number', 'financial:account')) v(column_name, pattern, tag)
WHERE EXISTS (SELECT 1 FROM people)""")
def _(d):
    scan = protect.scan_values(d.people, ["mrn", "ssn", "birth_date", "email", "phone", "account"])
    return protect.suggested_tags(scan).select("column_name", "pattern", "tag")


SAMPLE_POLICIES = {"ssn": "MASK_FULL_SSN", "email": "MASK_EMAIL", "phone": "MASK_LAST_4", "c_mktsegment": "None"}


@query("r3_masked_samples", """
WITH v AS (SELECT 'ssn' AS column_name, ssn AS value, '***-**-****' AS masked_value FROM people
  UNION SELECT 'email', email, 'u***@mail.example.com' FROM people
  UNION SELECT 'phone', phone, concat('***-***-', phone[9:]) FROM people
  UNION SELECT 'c_mktsegment', c_mktsegment, c_mktsegment FROM people)
SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY md5(value), value) AS INTEGER) AS sample_number, masked_value
FROM v QUALIFY sample_number <= 3""")
def _(d):
    return protect.masked_samples(d.people, SAMPLE_POLICIES)


# --- monitoring ------------------------------------------------------------------------------------------------


@query("r4_deadlines", f"""
WITH o AS (SELECT *, CASE WHEN status = 'ESCALATED' THEN decided_at + INTERVAL 4 HOUR WHEN category = 'PHI' THEN submitted_time + INTERVAL 24 HOUR
    WHEN category = 'PII' THEN submitted_time + INTERVAL 48 HOUR WHEN category = 'Financial' THEN submitted_time + INTERVAL 72 HOUR END AS due_time
  FROM st WHERE status IN ('PENDING', 'ESCALATED'))
SELECT id, category, status, due_time, coalesce(due_time < {AS_OF}, false) AS is_breached FROM o""")
def _(d):
    return monitor.with_deadline(d.state, d.as_of).select("id", "category", "status", "due_time", "is_breached")


@query("r4_deadline_summary", f"""
WITH o AS (SELECT *, CASE WHEN status = 'ESCALATED' THEN decided_at + INTERVAL 4 HOUR WHEN category = 'PHI' THEN submitted_time + INTERVAL 24 HOUR
    WHEN category = 'PII' THEN submitted_time + INTERVAL 48 HOUR WHEN category = 'Financial' THEN submitted_time + INTERVAL 72 HOUR END AS due_time
  FROM st WHERE status IN ('PENDING', 'ESCALATED'))
SELECT category, status, count(*) AS n_open, count(*) FILTER (due_time < {AS_OF}) AS n_breached FROM o GROUP BY ALL""")
def _(d):
    return monitor.deadline_summary(d.state, d.as_of)


@query("r4_breach_stream", f"""
WITH o AS (SELECT *, CASE WHEN status = 'ESCALATED' THEN decided_at + INTERVAL 4 HOUR WHEN category = 'PHI' THEN submitted_time + INTERVAL 24 HOUR
    WHEN category = 'PII' THEN submitted_time + INTERVAL 48 HOUR WHEN category = 'Financial' THEN submitted_time + INTERVAL 72 HOUR END AS due_time
  FROM st WHERE status IN ('PENDING', 'ESCALATED'))
SELECT CAST(item_key AS VARCHAR) AS item, category, status, date_trunc('millisecond', due_time) AS due_time FROM o
WHERE date_trunc('millisecond', due_time) < {AS_OF}""")
def _(d):
    """Items past their deadline, as the alerts of a stream say that has seen the log in two runs and then the time."""
    source, target, state = (work_path(d.spark, n) for n in ("breach-rows", "breaches", "breach-run"))
    rows = breaches.item_rows(d.queue, KEY).unionByName(breaches.decision_rows(decide.changing(d.decisions), KEY))
    early = F.col("event_time") < F.lit("2024-01-20").cast("timestamp")
    for part in (rows.filter(early), rows.filter(~early), breaches.heartbeat(d.spark, "2024-02-01 01:00:00")):
        part.write.mode("append").parquet(source)
        stream = feed.feed(d.spark, source, rows.schema)
        breaches.breach_stream(stream, target, state).awaitTermination()
    return breaches.breached_now(d.spark, target).select("item", "category", "status", "due_time")


@query("r5_concepts", """
SELECT id, suggested_tag, CASE suggested_tag WHEN 'phi:patient_id' THEN 'Patient Master Identifier' WHEN 'financial:amount' THEN 'Adjudicated Claim Charge'
  WHEN 'phi:diagnosis' THEN 'ICD Medical Coding Taxonomy' WHEN 'financial:account' THEN 'Patient Billing Account Reference'
  WHEN 'pii:insurance' THEN 'Health Insurance Plan Identifier' ELSE '' END AS concept_match FROM q""")
def _(d):
    return monitor.with_concept(d.queue).select("id", "suggested_tag", "concept_match")


SQL_SIMILAR = """
base AS (SELECT item_key, base_name AS name, concat(schema_name, '.', table_name) AS tbl, tag FROM cat),
per_tbl AS (SELECT name, tbl, count(*) AS n, min(tag) AS tag FROM base WHERE tag <> '' GROUP BY ALL),
tot AS (SELECT name, sum(n) AS n_all FROM per_tbl GROUP BY ALL),
common AS (SELECT name, tag AS common_tag FROM base WHERE tag <> '' GROUP BY name, tag
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, tag DESC) = 1),
heads AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tbl) AS r FROM per_tbl QUALIFY r <= 4),
found AS (SELECT b.item_key, b.name, b.tbl, CAST(coalesce(t.n_all, 0) - coalesce(o.n, 0) AS BIGINT) AS n_similar, c.common_tag
  FROM base b LEFT JOIN tot t USING (name) LEFT JOIN per_tbl o ON o.name = b.name AND o.tbl = b.tbl LEFT JOIN common c ON c.name = b.name)"""


@query("r6_similar_columns", f"""
WITH {SQL_SIMILAR}
SELECT item_key, n_similar, CASE WHEN n_similar > 0 THEN common_tag END AS common_tag FROM found""")
def _(d):
    view = cat.catalog_view(d.inventory, d.prior, keep=(KEY, "base_name"))
    known = view.filter(F.col("status") == "Classified")
    return monitor.similar_columns(view, known, "base_name").select(KEY, "n_similar", "common_tag")


@query("r6_similar_examples", f"""
WITH {SQL_SIMILAR}
SELECT f.item_key, h.tbl AS path, h.tag FROM found f JOIN heads h ON h.name = f.name AND h.tbl <> f.tbl
QUALIFY row_number() OVER (PARTITION BY f.item_key ORDER BY h.tbl) <= 3""")
def _(d):
    view = cat.catalog_view(d.inventory, d.prior, keep=(KEY, "base_name"))
    known = view.filter(F.col("status") == "Classified")
    found = monitor.similar_columns(view, known, "base_name")
    return found.select(KEY, F.explode("similar").alias("other")).select(KEY, "other.path", "other.tag")


@query("r6_near_names", """
WITH n AS (SELECT DISTINCT lower(column_name) AS name FROM inv),
v AS (SELECT name, name AS variant FROM n
  UNION SELECT name, concat(substr(name, 1, i - 1), substr(name, i + 1)) FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM n))
SELECT DISTINCT a.name, b.name AS near_name FROM v a JOIN v b USING (variant) WHERE a.name <> b.name AND levenshtein(a.name, b.name) = 1""")
def _(d):
    return monitor.near_names(d.inventory)


@query("r6_similar_names", """
WITH n AS (SELECT DISTINCT lower(concat(base_name, '-', urgency, '.', progress, item_key // 32 % 20)) AS name FROM inv),
t AS (SELECT name, list_distinct(regexp_extract_all(name, '[[:alpha:]]+|[[:digit:]]+')) AS tokens FROM n),
e AS (SELECT name, unnest(tokens) AS token FROM t),
c AS (SELECT a.name, b.name AS near_name, count(*) AS common FROM e a JOIN e b USING (token) WHERE a.name < b.name GROUP BY ALL)
SELECT c.name, near_name, round(common / (len(x.tokens) + len(y.tokens) - common), 6) AS similarity, levenshtein(c.name, near_name)::INTEGER AS distance
FROM c JOIN t x ON x.name = c.name JOIN t y ON y.name = near_name WHERE 100 * common >= 60 * (len(x.tokens) + len(y.tokens) - common)""")
def _(d):
    """Longer names: the base name with urgency, progress and a number."""
    name = F.concat("base_name", F.lit("-"), "urgency", F.lit("."), "progress", F.expr(f"{KEY} div 32 % 20"))
    return monitor.similar_names(d.inventory.select(name.alias("column_name")))


@query("r7_composite_confidence", """
WITH w AS (SELECT item_key, rule_confidence AS c, 0.5::DOUBLE AS w FROM classified WHERE rule IS NOT NULL
  UNION ALL SELECT item_key, prior_conf, 0.3::DOUBLE FROM classified WHERE from_prior)
SELECT item_key, round(sum(w * c) / sum(w), 6) AS composite_confidence, count(*) AS n_workers FROM w GROUP BY ALL""")
def _(d):
    joined = classify.merged(d.inventory, d.prior)
    scores = F.array(
        F.struct(F.lit("rules").alias("worker"), F.when(F.col("rule_number").isNotNull(), F.col("rule_confidence")).alias("confidence")),
        F.struct(F.lit("prior").alias("worker"), F.when(~c.is_blank_tag("prior_tag"), F.col("prior_confidence")).alias("confidence")))
    rows = joined.select(KEY, F.explode(scores).alias("s")).select(KEY, "s.worker", "s.confidence")
    scored = rows.filter(F.col("confidence").isNotNull())
    return monitor.composite_confidence(scored, [KEY], {"rules": 0.5, "prior": 0.3})


@query("r8_auto_approved", """
SELECT id, suggested_tag, CASE WHEN confidence_score >= 0.95 THEN 'APPROVED' ELSE 'PENDING' END AS status FROM q""")
def _(d):
    approvals = decide.auto_approve(d.queue, d.as_of, key=KEY)
    return decide.apply_decisions(d.queue, approvals, KEY).select("id", "suggested_tag", "status")


@query("r9_review_time", "SELECT count(*) AS n_timed, round(avg(spent), 6) AS avg_review_seconds FROM aud")
def _(d):
    return report.average_review_seconds(d.audit)


@query("r10_highest_risk_schema", """
SELECT schema_name, count(*) AS n_urgent FROM st WHERE status = 'PENDING' AND priority IN ('Critical', 'High')
GROUP BY ALL ORDER BY n_urgent DESC, schema_name LIMIT 1""")
def _(d):
    return report.highest_risk_schema(d.state)


@query("r11_confidence_histogram", "SELECT floor(confidence_score * 20) / 20 AS bin_low, count(*) AS n_items FROM st GROUP BY ALL")
def _(d):
    return report.confidence_histogram(d.state)


@query("r12_top_tags", "SELECT suggested_tag, count(*) AS n_items FROM st GROUP BY ALL ORDER BY n_items DESC, suggested_tag LIMIT 10")
def _(d):
    return report.top_tags(d.state)


@query("t1_schema_changes", """
WITH e AS (SELECT schema_name, table_name, column_name, b.data_type AS old_type, a.data_type AS new_type,
    CASE WHEN b.data_type IS NULL THEN 'COLUMN_ADDED' WHEN a.data_type IS NULL THEN 'COLUMN_REMOVED'
         WHEN a.data_type <> b.data_type THEN 'TYPE_CHANGED' END AS event_type
  FROM inv b FULL OUTER JOIN snapshot_after a USING (schema_name, table_name, column_name))
SELECT concat('EVT-', substr(sha256(concat(event_type, '|', schema_name, '|', table_name, '|', column_name, '|2024-02-01 00:00:00')), 1, 12)) AS event_id,
  event_type, concat(schema_name, '.', table_name) AS target_table,
  CASE event_type WHEN 'COLUMN_ADDED' THEN concat('New column ''', column_name, ''' added to table schema.')
    WHEN 'COLUMN_REMOVED' THEN concat('Column ''', column_name, ''' removed from table schema.')
    ELSE concat('Column ''', column_name, ''' changed from ', old_type, ' to ', new_type, '.') END AS details, 'PENDING' AS status
FROM e WHERE event_type IS NOT NULL""")
def _(d):
    return monitor.schema_changes(d.inventory, d.snapshot_after, d.as_of).drop("action_taken", "ts")


SQL_SCHEMA_EVENTS = """
SELECT concat('EVT-', substr(sha256(concat(event_type, '|', schema_name, '|', table_name, '|', column_name, '|{1}')), 1, 12)) AS event_id,
  event_type, concat(schema_name, '.', table_name) AS target_table, TIMESTAMP '{1}' AS ts
FROM (SELECT schema_name, table_name, column_name, CASE WHEN b.data_type IS NULL THEN 'COLUMN_ADDED' WHEN a.data_type IS NULL THEN 'COLUMN_REMOVED'
         WHEN a.data_type <> b.data_type THEN 'TYPE_CHANGED' END AS event_type
  FROM {0} USING (schema_name, table_name, column_name)) WHERE event_type IS NOT NULL"""


@query("t1_schema_feed",
       SQL_SCHEMA_EVENTS.format("inv b FULL OUTER JOIN snapshot_after a", "2024-02-01 00:00:00") + " UNION ALL "
       + SQL_SCHEMA_EVENTS.format("snapshot_after b FULL OUTER JOIN inv a", "2024-02-02 00:00:00"))
def _(d):
    """The feed of changes after three versions, recorded in two runs of which the second repeats one."""
    path = work_path(d.spark, "schema-watch")
    listed = (("first", d.inventory, "2024-01-31 00:00:00"), ("second", d.snapshot_after, "2024-02-01 00:00:00"),
              ("second", d.snapshot_after, "2024-02-01 00:00:00"), ("third", d.inventory, "2024-02-02 00:00:00"))
    for name, inventory, taken in listed:
        schema_watch.record(inventory, path, name, taken)
    return schema_watch.feed(d.spark, path).select("event_id", "event_type", "target_table", "ts")


# --- streaming -------------------------------------------------------------------------------------------------


def _fed(d: Derived) -> str:
    """Run the decision feed over all event files; returns the folder that it filled."""
    events = feed.feed(d.spark, d.path("events") + "*", d.table("events").schema)
    target = work_path(d.spark, "feed")
    run = feed.append_stream(decide.changing(d.decisions_from(events)), target, work_path(d.spark, "feed-state"))
    run.awaitTermination()
    return target


@query("t2_decision_feed", "SELECT governance_decision_id, timestamp, action, user_email FROM eff")
def _(d):
    return d.spark.read.parquet(_fed(d)).select("governance_decision_id", "timestamp", "action", "user_email")


@query("t2_daily_counts", "SELECT CAST(timestamp AS DATE) AS day, count(*) AS n_decisions FROM eff GROUP BY ALL")
def _(d):
    source = _fed(d)
    stream = feed.feed(d.spark, source, d.spark.read.parquet(source).schema)
    target = work_path(d.spark, "daily")
    feed.count_stream(stream, target, work_path(d.spark, "daily-state")).awaitTermination()
    return feed.daily_counts(d.spark, target).select("day", "n_decisions")


@query("t2_late_rows", """
WITH seen AS (SELECT date_trunc('millisecond', max(timestamp)) - INTERVAL 1 HOUR AS watermark FROM eff
  WHERE decision_key IN (SELECT concat('D-', CAST(event_id AS VARCHAR)) FROM events WHERE event_id % 2 = 1)),
l AS (SELECT e.governance_decision_id, e.timestamp FROM eff e, seen s WHERE e.timestamp <= s.watermark
  AND e.decision_key IN (SELECT concat('D-', CAST(event_id AS VARCHAR)) FROM events WHERE event_id % 2 = 0))
SELECT governance_decision_id, timestamp FROM l""")
def _(d):
    """Two runs, the second with files out of time order: what the feed drops as too late is written beside its target."""
    source, target, state, late = (work_path(d.spark, n) for n in ("events", "feed", "feed-state", "late"))
    events = d.table("events")
    for rest in (1, 0):
        events.filter(F.col("event_id") % 2 == rest).write.mode("append").parquet(source)
        stream = decide.changing(d.decisions_from(feed.feed(d.spark, source, events.schema)))
        feed.append_stream(stream, target, state).awaitTermination()
    taken = d.spark.read.schema(stream.schema).parquet(target)
    feed.write_late(decide.effective(d.decisions), taken, late)
    return d.spark.read.parquet(late).select("governance_decision_id", "timestamp")


@query("t2_current_state", "SELECT id, suggested_tag, status, decided_at, decided_by, n_decisions FROM st")
def _(d):
    """The stored state after two runs of the stream; the second brings older decisions and repeats some of the first."""
    source, target, state = (work_path(d.spark, n) for n in ("events", "state", "state-run"))
    events, number = d.table("events"), F.col("event_id")
    for part in (number % 2 == 1, (number % 2 == 0) | (number % 16 == 1)):
        events.filter(part).write.mode("append").parquet(source)
        stream = decide.changing(d.decisions_from(feed.feed(d.spark, source, events.schema)))
        live.state_stream(stream, target, state, KEY).awaitTermination()
    return live.queue_now(d.queue, stream, target, KEY).select(
        "id", "suggested_tag", "status", "decided_at", "decided_by", "n_decisions")


@query("t2_event_windows", """
WITH odd AS (SELECT * FROM eff WHERE decision_key IN (SELECT concat('D-', CAST(event_id AS VARCHAR)) FROM events WHERE event_id % 2 = 1)),
even AS (SELECT * FROM eff WHERE governance_decision_id NOT IN (SELECT governance_decision_id FROM odd)),
mark AS (SELECT date_trunc('millisecond', max(timestamp)) - INTERVAL 1 HOUR AS watermark FROM odd),
marked AS (SELECT timestamp, false AS late FROM odd
  UNION ALL SELECT timestamp, date_trunc('day', timestamp) + INTERVAL 1 DAY <= watermark FROM even, mark)
SELECT CAST(timestamp AS DATE) AS day, count(*) AS n_decisions, count(*) FILTER (late) AS n_late FROM marked GROUP BY ALL""")
def _(d):
    """Days by event time: closed counts and late rows, after two runs out of time order and one without decisions."""
    source, target, state = (work_path(d.spark, n) for n in ("decisions", "windows", "windows-run"))
    rows = decide.changing(d.decisions)
    odd = F.substring_index("decision_key", "-", -1).cast("long") % 2 == 1
    for part in (rows.filter(odd), rows.filter(~odd), windows.heartbeat(d.spark, rows, "2100-01-01 00:00:00"),
                 windows.heartbeat(d.spark, rows, "2100-01-01 00:00:01")):
        part.write.mode("append").parquet(source)
        windows.window_stream(feed.feed(d.spark, source, rows.schema), target, state).awaitTermination()
    closed = windows.closed_days(d.spark, target).withColumn("n_late", F.lit(0).cast("long"))
    late = windows.late_rows(d.spark, target).groupBy("day").agg(F.count(F.lit(1)).alias("n_decisions"))
    return closed.unionByName(late.withColumn("n_late", F.col("n_decisions"))).groupBy("day").agg(
        F.sum("n_decisions").alias("n_decisions"), F.sum("n_late").alias("n_late"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=function: f(Derived(spark, folder))) for name, function in QUERIES.items()}
