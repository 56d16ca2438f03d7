"""Discovery, table reads, writes, value scans."""

import os
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wardline import schemas
from wardline.operators import audit, classify, protect
from wardline.operators import catalog as cat
from wardline.session import shared_dir, work_path
from wardline.sources import discover, seeds, sinks, tables

AS_OF = datetime(2026, 7, 30, 12, 0, 0)


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE brz")
    spark.sql("CREATE TABLE brz.claims (patient_id STRING, claim_amount DECIMAL(10,2), day STRING) USING parquet PARTITIONED BY (day)")
    sinks.bootstrap(seeds.classification_results(spark), schemas.CLASSIFICATION_RESULTS, "brz.classification_results")
    sinks.bootstrap(seeds.governance_audit(spark, AS_OF), schemas.GOVERNANCE_AUDIT, "brz.governance_audit")
    return "brz"


def test_discovery_from_the_catalog(spark, database):
    found = discover.catalog_columns(spark, database)
    claims = rows(found.filter("table_name = 'claims'"), "column_name", "data_type", "is_partition", "ordinal")
    assert claims == [("claim_amount", "decimal(10,2)", False, 1), ("day", "string", True, 2), ("patient_id", "string", False, 0)]
    assert rows(discover.table_list(found), "table_name") == [("claims",), ("classification_results",), ("governance_audit",)]
    prior = tables.prior_results(tables.read(spark, "brz.classification_results"))
    queue = classify.review_queue(found, prior, F.lit("2026-07-30 12:00:00").cast("timestamp_ntz"))
    assert queue.schema.names == schemas.CLASSIFICATION_ITEM.names
    assert queue.dtypes == spark.createDataFrame([], schemas.CLASSIFICATION_ITEM).dtypes
    assert queue.filter("table_name = 'classification_results'").count() == 0
    view = cat.catalog_view(found, prior)
    own = view.filter("table_name = 'classification_results'")
    assert rows(own.select("tag", "status").distinct()) == [("", "Unclassified")] and own.count() == 6


def test_bootstrap_leaves_an_existing_table_alone(spark, database):
    sinks.bootstrap(seeds.classification_results(spark).limit(1), schemas.CLASSIFICATION_RESULTS, "brz.classification_results")
    assert spark.table("brz.classification_results").count() == 9


def test_append_goes_by_name_and_repeats_leave_no_trace(spark, database):
    log = seeds.governance_audit(spark, AS_OF)
    shuffled = log.select(*reversed(log.columns))
    sinks.append_audit(shuffled, "brz.governance_audit")
    stored = tables.read(spark, "brz.governance_audit")
    assert rows(stored) == rows(sinks.stored_audit(spark, "brz.governance_audit")) == rows(log)
    doubled = sinks.shaped(log, schemas.GOVERNANCE_AUDIT)
    sinks.append(doubled, schemas.GOVERNANCE_AUDIT, "brz.governance_audit")
    assert spark.table("brz.governance_audit").count() == 6
    assert rows(audit.once(spark.table("brz.governance_audit"))) == rows(log)


def test_health(spark, database):
    broken = work_path(spark, "broken")
    os.makedirs(broken)
    with open(f"{broken}/part-0.parquet", "w") as out:
        out.write("not a table")
    spark.sql(f"CREATE TABLE brz.broken (x INT) USING parquet LOCATION '{broken}'")
    found = rows(tables.table_health(spark, ["brz.classification_results", "brz.nothing", "brz.broken"]))
    spark.sql("DROP TABLE brz.broken")
    assert [r[:3] for r in found] == [
        ("brz.broken", False, None), ("brz.classification_results", True, 9), ("brz.nothing", False, None)]
    assert found[0][3] and found[1][3] is None and "brz" in found[2][3]


def test_information_schema_listing(spark):
    listing = spark.createDataFrame(
        [("brz", "t", "a", "INT", 1), ("brz", "t", "b", "STRING", 2), ("other", "t", "a", "INT", 1)],
        "table_schema string, table_name string, column_name string, data_type string, ordinal_position int")
    found = discover.information_schema_columns(spark, "main", "brz", listing)
    assert found.columns == schemas.COLUMN_INVENTORY.names
    assert rows(found) == [("main", "brz", "t", "a", "INT", False, 0), ("main", "brz", "t", "b", "STRING", False, 1)]


def test_failed_tag_writes_are_returned(spark):
    inventory = spark.createDataFrame([("s", "t", "a")], "schema_name string, table_name string, column_name string")
    events = spark.createDataFrame(
        [("s", "t", "a", "pii:x", "u", datetime(2024, 1, 1), "1"), ("s", "t", "b", "pii:x", "u", datetime(2024, 1, 1), "2"),
         ("s", "t", "a", " ", "u", datetime(2024, 1, 1), "3")], schemas.COLUMN_TAG_EVENT)
    target = work_path(spark, "tags")
    failed = sinks.write_tags(events, inventory, target)
    assert rows(failed, "decision_id", "outcome") == [("2", "FAILED: no such column"), ("3", "FAILED: no tag")]
    assert rows(spark.read.parquet(target), "decision_id") == [("1",)]


def test_column_comment(spark, database):
    sinks.comment_column(spark, "brz.claims", "patient_id", "phi:it's")
    assert [c.description for c in spark.catalog.listColumns("brz.claims") if c.name == "patient_id"] == ["phi:it's"]


def test_csv_round_trip(spark):
    df = seeds.governance_audit(spark, AS_OF).withColumn("comments", F.lit('a "quoted", text\nof two lines'))
    target = work_path(spark, "csv")
    sinks.export_csv(df, target)
    assert rows(sinks.read_csv(spark, target, schemas.GOVERNANCE_AUDIT)) == rows(df)


def test_csv_writes_nested_columns_as_json(spark):
    target = work_path(spark, "csv")
    sinks.export_csv(seeds.classification_items(spark, AS_OF).select("id", "similar_columns_metrics"), target)
    found = spark.read.option("header", True).option("escape", '"').csv(target).filter("id = 'req-cbp-001'").first()
    assert found.similar_columns_metrics == '[{"name":"brz.healthcare_patients_financial.patient_id","similarity":97.0}]'


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert work_path(spark, "x") != work_path(spark, "x")


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_listing_types(spark):
    df = spark.createDataFrame([("a", "int", "INT"), ("b", "", "TEXT"), ("c", None, "REAL"), ("", "x", "X"), ("#p", "x", "X"),
                                ("d", None, "")], "column_name string, type_text string, type_name string")
    assert rows(discover.with_type_only(discover.typed(df)), "column_name", "data_type") == [
        ("a", "int"), ("b", "TEXT"), ("c", "REAL")]


def test_prior_merge_quirks(spark):
    inventory = spark.createDataFrame(
        [("brz", "T1 ", "ssn", "STRING"), ("brz", "t1", "notes", None), ("brz", "t1", "email", "STRING"), ("brz", "t1", "odd", "STRING"),
         ("brz", "t1", "zip", "STRING"), ("hr", "t1", "notes", "STRING")],
        "schema_name string, table_name string, column_name string, data_type string")
    prior = spark.createDataFrame(
        [("t1", " SSN", "  ", "0.9"), ("t1", "notes", "pii:low", "0.5"), ("T1", "notes", " Phi:High ", "0.96"), ("t1", "email", None, "0.9"),
         ("t1", "odd", "Internal", "bad"), ("t1", "zip", "NONE", "0.99"), ("", "zip", "x", "1"), (None, "zip", "x", "1")],
        "table_name string, column_name string, class_tag string, confidence string")
    queue = classify.review_queue(inventory, prior, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    found = {(r.schema_name, r.column_name): r for r in queue.collect()}
    assert found[("brz", "ssn")].suggested_tag == "pii:ssn"  # blank prior tag
    high = found[("brz", "notes")]  # best of two, trimmed
    assert (high.suggested_tag, high.category, high.priority, high.native_classification, high.data_type) == (
        "Phi:High", "PHI", "Critical", "Classified as PHI:HIGH", "STRING")
    assert found[("hr", "notes")].suggested_tag == "Phi:High"  # the schema is not part of the key
    assert found[("brz", "email")].suggested_tag == "pii:email"  # missing prior tag
    odd = found[("brz", "odd")]
    assert (odd.category, odd.confidence_score, odd.priority) == ("Sensitive", 0.9, "High")
    assert found[("brz", "zip")].suggested_tag == "pii:address"
    view = {(r.schema_name, r.column_name): r.tag for r in cat.catalog_view(inventory, prior).collect()}
    assert view[("brz", "ssn")] == "pii:ssn" and view[("brz", "email")] == "pii:email" and ("brz", "notes") not in view


def test_scan_counts_matches_and_rows(spark):
    texts = ["mail a@b.co and c@d.org", "call 555-123-4567", None, "9" * 16 + " 1980-01-02 10.0.0.1", "x" * 50_000 + " z@y.net"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.pattern: (r.n_values, r.n_rows_hit, r.n_hits) for r in protect.scan_values(df, ["text"]).collect()}
    assert found["email"] == (4, 2, 3)
    assert found["phone"] == (4, 1, 1)
    assert found["card_number"] == (4, 1, 1)
    assert found["birth_date"] == (4, 1, 1)
    assert found["ip_address"] == (4, 1, 1)
    assert found["ssn"] == (4, 0, 0)
    empty = protect.scan_values(df.limit(0), ["text"]).first()
    assert (empty.n_values, empty.n_hits, empty.hit_rate) == (0, 0, 0.0)


def test_table_policies_and_samples(spark, derived):
    people = derived.people
    listed = [("files", "people", n, "string", False) for n in people.columns]
    inventory = spark.createDataFrame(listed, "schema_name string, table_name string, column_name string, data_type string, p boolean")
    prior = seeds.classification_results(spark).limit(0)
    policies = protect.policies_of(cat.catalog_view(inventory, prior), "files", "people")
    assert policies["ssn"] == "MASK_FULL_SSN" and policies["email"] == "MASK_EMAIL" and "c_custkey" not in policies
    masked = protect.mask_table(people, policies)
    assert rows(masked.select("ssn").distinct()) == [("***-**-****",)]
    lists = rows(protect.sample_lists(protect.masked_samples(people, {"ssn": "MASK_FULL_SSN", "c_mktsegment": "None"}, 2)))
    assert [len(values) for _, values in lists] == [2, 2]


def test_too_many_policies_are_refused(spark):
    with pytest.raises(ValueError, match="more than 2"):
        protect.policies_of(seeds.catalog_entries(spark), "brz", "healthcare_patients_financial", most=2)
