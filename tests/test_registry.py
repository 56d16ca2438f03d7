"""The registered queries: contract, plans, and a sample of SQL twins."""

import duckdb
import pytest
from conftest import SF, rows

import __spark_entry__ as entry
from wardline.plans.derived import TABLES
from wardline.plans.queries import QUERIES
from tools.check_oracle import table

# Queries that write files when they are called.
WRITERS = {n for n in QUERIES if n.startswith(("k", "t2", "u1", "s10"))}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_entry(spark):
    found = rows(entry.entry(spark))
    assert len(found) > 5 and sum(r[2] for r in found) > 1000


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)


@pytest.mark.parametrize("name", ["c5_review_queue", "a_dashboard", "d5_audit_rows", "w2_timeline", "j7_tag_upsert",
                                  "r6_similar_examples", "r1_mask_documents", "r2_scan_documents", "k6_export_audit_csv",
                                  "t2_daily_counts", "s1_discover_columns"])
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    twin = table([c[0] for c in result.description], result.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == twin


def test_no_query_has_a_cross_join(derived):
    for name, run in QUERIES.items():
        if name in WRITERS:
            continue
        plan = run(derived)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["p3_domain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_the_stored_log_takes_new_decisions(spark, con):
    """u1 reads the log as append_once lays it out: without the columns of its folders."""
    df = entry.queries()["u1_log_with_new"](spark, SF)
    result = con.execute(entry.oracle_sql()["u1_log_with_new"])
    twin = table([c[0] for c in result.description], result.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == twin
