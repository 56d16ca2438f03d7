"""Reads of the governance tables, by table name or Parquet path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import audit, decide
from wardline.schemas import CLASSIFICATION_RESULTS, GOVERNANCE_AUDIT

TAG_COLUMNS = ("table_name", "column_name", "class_tag", "confidence")


def read(spark: SparkSession, source: str) -> DataFrame:
    """A path if it has a slash, else a table of the session catalog."""
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def prior_results(df: DataFrame) -> DataFrame:
    return df.select(*CLASSIFICATION_RESULTS.names)


def prior_tags(df: DataFrame) -> DataFrame:
    return df.select(*TAG_COLUMNS)


def audit_history(log: DataFrame, as_of: Column) -> DataFrame:
    """The stored log, decoded, newest first. A log with text times gets typed ones."""
    rows = log.select(*GOVERNANCE_AUDIT.names)
    if dict(rows.dtypes)["timestamp"] == "string":
        rows = audit.decode(rows, as_of)
    return audit.history(rows)


def current_queue(queue: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """The whole queue with the state that the decision log gives it."""
    return decide.apply_decisions(queue, decisions, key)


def table_health(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(table_name, is_readable, n_rows, error) per table of the session catalog.

    Every table is read on its own, so one that is missing or broken is reported and the others are counted.
    """
    rows = []
    for name in names:
        try:
            rows.append((name, True, spark.table(name).count(), None))
        except Exception as problem:
            rows.append((name, False, None, str(problem).splitlines()[0]))
    return spark.createDataFrame(rows, "table_name string, is_readable boolean, n_rows long, error string")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of frames; Parquet answers this from its footers."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
