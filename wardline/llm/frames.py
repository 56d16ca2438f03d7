"""Frames written between steps, and a filter of fixed size that stands for a set of ids."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import work_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Rows that go to Python at once: bounds what a task holds of long texts.
ROWS_AT_ONCE = "512"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound what is sent to them at once."""
    places = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in places:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, places)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: survives lost executors, cuts the lineage."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class IdFilter:
    """A bitmap of hashed ids. ``maybe(id)`` is true for every id in the set and for few others.

    Its size follows the count of ids, up to ``most`` bits (16 MB by default), so it may be broadcast whatever the data;
    beyond that more foreign ids pass, and the exact join behind it has more to do.
    """

    def __init__(self, ids: DataFrame, *columns: str, most: int = 1 << 27):
        spark = ids.sparkSession
        count = ids.count()
        self.bits = min(most, 1 << max(18, (16 * count).bit_length()))
        place = self.place(*map(F.col, columns))
        rows = (
            ids.select(place.alias("p"))
            .groupBy(F.expr("p div 32768").alias("part"))
            .agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("bits"))
            .collect()
        )
        held = np.zeros(self.bits // 8, np.uint8)
        for row in rows:
            held[row["part"] * 4096:(row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
        self._held = spark.sparkContext.broadcast(held)

    def place(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.bits))

    def maybe(self, *key: Column) -> Column:
        held = self._held

        @F.pandas_udf("boolean")
        def look(places: pd.Series) -> pd.Series:
            p = places.to_numpy()
            return pd.Series((held.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

        return look(self.place(*key))
