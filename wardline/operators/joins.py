"""Per-key picks and running values that stay balanced when one key holds a large share of the rows.

Lookups need no helper here: they are plain joins with a side of one row per key, of which Spark splits the large partitions
at run time (adaptive skew join), whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1,
                rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark turns the rank filter into a group limit that runs before the shuffle, so each task sends at most
    ``n`` rows per key and a hot key never gathers in one place.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def running_last(df: DataFrame, key: str, when: str, tie: str, value: Column, name: str) -> DataFrame:
    """Per row, the last non-NULL ``value`` of the same key strictly before it, in the order of ``when`` and ``tie``.

    Rows are ordered in cells only: one key, one time, and one beginning (two characters) of ``tie``, a hash in text form.
    What is carried into a cell comes from summaries with one row per cell, second and hour, each ordered inside the next: cells
    inside a second, seconds inside an hour, hours inside a key. So no task orders all rows of a key, however many it has
    and however close in time they are. NULL keys and times are keys and times like others.
    """
    marks = {
        "__key": F.col(key),
        "__hour": F.date_trunc("hour", when).cast("timestamp_ntz"),
        "__second": F.date_trunc("second", when).cast("timestamp_ntz"),
        "__time": F.col(when),
        "__start": F.substring(F.col(tie).cast("string"), 1, 2),
    }
    names = list(marks)
    rows = df.withColumns(marks | {"__value": value})

    def before(keys: Sequence[str], order: Sequence[str], last: Column) -> Column:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(last, ignorenulls=True).over(window)

    def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Left join on equal or both missing keys."""
        other = right.select(*(F.col(k).alias(f"{k}_r") for k in keys), "__carried")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_r"))
        return left.join(other, same, "left").drop(*(f"{k}_r" for k in keys))

    place = F.struct(when, tie)
    last = F.max(F.when(F.col("__value").isNotNull(), F.struct(place.alias("place"), F.col("__value").alias("v"))))
    cells = rows.groupBy(*names).agg(last.alias("__last"))
    seconds = cells.groupBy(*names[:3]).agg(F.max("__last").alias("__last"))
    hours = seconds.groupBy(*names[:2]).agg(F.max("__last").alias("__last"))
    carried = hours.withColumn("__carried", before(["__key"], ["__hour"], F.col("__last")["v"]))
    for level, keys, order in ((seconds, names[:2], ["__second"]), (cells, names[:3], ["__time", "__start"])):
        own = level.withColumn("__own", before(keys, order, F.col("__last")["v"]))
        carried = joined(own, carried, keys).withColumn("__carried", F.coalesce("__own", "__carried"))
    inside = rows.withColumn("__inside", before(names, [when, tie], F.col("__value")))
    return joined(inside, carried, names).withColumn(name, F.coalesce("__inside", "__carried")).select(*df.columns, name)
