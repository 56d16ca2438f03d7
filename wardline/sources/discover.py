"""Column discovery: which columns exist, and of what type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.schemas import COLUMN_INVENTORY


def catalog_columns(spark: SparkSession, schema: str, catalog: str = "spark_catalog") -> DataFrame:
    """Every column of every table of one schema, from the session catalog. Only metadata reaches the driver.

    One call per table: for catalogs with very many tables use ``information_schema_columns``.
    """
    rows = []
    for table in spark.catalog.listTables(schema):
        if table.isTemporary:
            continue
        for position, column in enumerate(spark.catalog.listColumns(f"{schema}.{table.name}")):
            rows.append((catalog, schema, table.name, column.name, column.dataType, column.isPartition, position))
    return spark.createDataFrame(rows, COLUMN_INVENTORY)


def path_columns(spark: SparkSession, paths: Mapping[str, str], schema: str, catalog: str = "files") -> DataFrame:
    """The same for Parquet folders, by table name; only file footers are read."""
    rows = []
    for name, path in paths.items():
        for position, field in enumerate(spark.read.parquet(path).schema.fields):
            rows.append((catalog, schema, name, field.name, field.dataType.simpleString(), False, position))
    return spark.createDataFrame(rows, COLUMN_INVENTORY)


def information_schema_columns(spark: SparkSession, catalog: str, schema: str, listing: DataFrame | None = None) -> DataFrame:
    """The same from ``information_schema``, for catalogs that offer it; nothing passes through the driver.

    ``listing`` is a view of that shape, if it is kept under another name.
    """
    columns = spark.table(f"{catalog}.information_schema.columns") if listing is None else listing
    return columns.filter(F.col("table_schema") == schema).select(
        F.lit(catalog).alias("catalog_name"), F.col("table_schema").alias("schema_name"), "table_name", "column_name",
        "data_type", F.lit(False).alias("is_partition"), (F.col("ordinal_position") - 1).cast("int").alias("ordinal"),
    )


def typed(listing: DataFrame) -> DataFrame:
    """Listing with ``data_type``: the full type text, or the type name where the text is missing."""
    return listing.withColumn("data_type", F.coalesce(F.nullif(F.col("type_text"), F.lit("")), F.col("type_name")))


def with_type_only(inventory: DataFrame) -> DataFrame:
    """What the catalog view accepts: named columns with a known type."""
    name = F.col("column_name")
    return inventory.filter((F.length(name) > 0) & ~name.startswith("#") & (F.length("data_type") > 0))


def table_list(inventory: DataFrame) -> DataFrame:
    return inventory.select("schema_name", "table_name").distinct()
