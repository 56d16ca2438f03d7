"""Columns of very many Parquet files, from their footers, which tasks read in parallel."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILES_IN_TASK = 64


def files_of(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """table_name, path, length of the Parquet files below each path; Spark lists large folders in parallel."""
    out = None
    for name, path in paths.items():
        found = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
            .select(F.lit(name).alias("table_name"), "path", "length"))
        out = found if out is None else out.unionByName(found)
    return out


def _types(metadata: pq.FileMetaData) -> list[tuple[str, str]]:
    """(column, type) as Spark names them: from what Spark wrote into the footer, else from the file's own types."""
    own = (metadata.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if own:
        import json

        schema = StructType.fromJson(json.loads(own))
    else:
        from pyspark.sql.pandas.types import from_arrow_schema

        schema = from_arrow_schema(metadata.schema.to_arrow_schema().remove_metadata(), prefer_timestamp_ntz=True)
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


_FOOTER = pa.struct([("column_name", pa.string()), ("data_type", pa.string()), ("ordinal", pa.int32())])


def footers(files: DataFrame) -> DataFrame:
    """Files with n_rows, columns (array of column_name, data_type, ordinal) and error, the reason why a footer can't be read.

    Files are opened by Arrow's file systems (local, HDFS, S3, GCS); a file in another store has an error and no columns.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_rows, columns, errors = [], [], []
            for path in batch.column(1).to_pylist():
                try:
                    system, place = fs.FileSystem.from_uri(path)
                    with system.open_input_file(place) as source:
                        metadata = pq.read_metadata(source)
                    columns.append([
                        {"column_name": n, "data_type": t, "ordinal": i} for i, (n, t) in enumerate(_types(metadata))])
                    n_rows.append(metadata.num_rows)
                    errors.append(None)
                except Exception as error:  # one broken file must not end the listing of the others
                    columns.append(None)
                    n_rows.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_rows, pa.int64()), pa.array(columns, pa.list_(_FOOTER)), pa.array(errors, pa.string())],
                ["table_name", "path", "length", "n_rows", "columns", "error"])

    spread = files.select("table_name", "path", "length").repartition(F.expr(f"pmod(xxhash64(path), {FILES_IN_TASK})"))
    return spread.mapInArrow(
        read, "table_name string, path string, length long, n_rows long, "
              "columns array<struct<column_name:string,data_type:string,ordinal:int>>, error string")


def file_columns(read: DataFrame) -> DataFrame:
    """table_name, column_name, data_type, n_files, n_rows, n_types: a column that files give different types is listed with each."""
    each = read.select("table_name", "n_rows", F.explode("columns").alias("c")).select("table_name", "n_rows", "c.*")
    typed = each.groupBy("table_name", "column_name", "data_type").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"))
    types = typed.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n_types"))
    return typed.join(types, ["table_name", "column_name"])


def disagreeing(read: DataFrame) -> DataFrame:
    """table_name, schema (text), n_files, example path: of tables whose files have more than one schema."""
    text = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["column_name"], c["data_type"])), ", ")
    each = read.filter(F.col("error").isNull()).groupBy("table_name", text.alias("schema")).agg(
        F.count(F.lit(1)).alias("n_files"), F.min("path").alias("example"))
    several = each.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("table_name")
    return each.join(several, "table_name", "left_semi")


def table_sizes(read: DataFrame) -> DataFrame:
    """table_name, n_files, n_rows, n_bytes, n_unreadable, without opening a data page."""
    return read.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("length").alias("n_bytes"),
        F.count("error").alias("n_unreadable"))
