"""Work on the values of tables: pattern scan, masking, masked samples."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import masks
from wardline.functions import reference_data as ref
from wardline.functions import validators
from wardline.operators.joins import top_per_key

def hits(text: Column, needed: str | None, pattern: str) -> Column:
    """Matches of the pattern in the whole text. The cheap test for a needed character saves most evaluations."""
    found = F.regexp_count(text, F.lit(pattern))
    return F.when(text.contains(needed), found).otherwise(F.lit(0)) if needed else found


def scan_values(df: DataFrame, columns: Sequence[str], patterns=ref.VALUE_PATTERNS) -> DataFrame:
    """Rows with a value, rows hit and number of matches, per column and pattern, from one pass over the table."""
    counted = df.select(
        *[F.col(n).isNotNull().alias(f"{i}") for i, n in enumerate(columns)],
        *[
            F.coalesce(hits(F.col(n).cast("string"), needed, pattern), F.lit(0)).alias(f"{i}_{label}")
            for i, n in enumerate(columns)
            for label, _, needed, pattern in patterns
        ],
    )
    sums = []
    for i, _ in enumerate(columns):
        sums.append(F.count_if(F.col(f"{i}")).alias(f"{i}"))
        for label, *_rest in patterns:
            value = F.col(f"{i}_{label}")
            sums.append(F.struct(F.count_if(value > 0).alias("rows"), F.sum(value.cast("long")).alias("all"))
                        .alias(f"{i}_{label}"))
    totals = counted.agg(*sums)
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("column_name"),
                F.lit(label).alias("pattern"),
                F.lit(tag).alias("tag"),
                F.col(f"{i}").alias("n_values"),
                F.col(f"{i}_{label}.rows").alias("n_rows_hit"),
                F.coalesce(F.col(f"{i}_{label}.all"), F.lit(0)).alias("n_hits"),
            )
            for i, n in enumerate(columns)
            for label, tag, *_rest in patterns
        ]
    )
    rows = totals.select(F.explode(entries).alias("entry")).select("entry.*")
    return rows.withColumn("hit_rate", F.coalesce(F.try_divide("n_rows_hit", "n_values"), F.lit(0.0)))


def scan_valid(df: DataFrame, columns: Sequence[str], patterns=ref.VALUE_PATTERNS) -> DataFrame:
    """As ``scan_values``, with how many matches are values that exist: n_valid, and the rows that have one, n_rows_valid.

    What counts as valid is in ``validators``: check digits, number ranges, calendar dates. One pass over the table.
    """
    matched = df.select(*(
        F.when(F.col(n).cast("string").contains(needed) if needed else F.lit(True),
               F.regexp_extract_all(F.col(n).cast("string"), F.lit(pattern), F.lit(0))).alias(f"{i}_{label}")
        for i, n in enumerate(columns) for label, _, needed, pattern in patterns
    ), *(F.col(n).isNotNull().alias(f"{i}") for i, n in enumerate(columns)))
    counted = matched.select(
        *(F.col(f"{i}") for i, _ in enumerate(columns)),
        *(F.struct(F.coalesce(F.size(f"{i}_{label}"), F.lit(0)).alias("all"),
                   F.coalesce(F.size(F.filter(f"{i}_{label}", validators.BY_PATTERN[label])), F.lit(0)).alias("valid"))
          .alias(f"{i}_{label}") for i, _ in enumerate(columns) for label, *_rest in patterns))
    sums = [F.count_if(F.col(f"{i}")).alias(f"{i}") for i, _ in enumerate(columns)]
    for i, _ in enumerate(columns):
        for label, *_rest in patterns:
            n = F.col(f"{i}_{label}")
            sums.append(F.struct(
                F.count_if(n["all"] > 0).alias("rows"), F.sum(n["all"].cast("long")).alias("all"),
                F.count_if(n["valid"] > 0).alias("rows_valid"), F.sum(n["valid"].cast("long")).alias("valid"))
                .alias(f"{i}_{label}"))
    entries = F.array(*(
        F.struct(F.lit(n).alias("column_name"), F.lit(label).alias("pattern"), F.lit(tag).alias("tag"),
                 F.col(f"{i}").alias("n_values"), F.col(f"{i}_{label}.rows").alias("n_rows_hit"),
                 F.coalesce(F.col(f"{i}_{label}.all"), F.lit(0)).alias("n_hits"),
                 F.col(f"{i}_{label}.rows_valid").alias("n_rows_valid"),
                 F.coalesce(F.col(f"{i}_{label}.valid"), F.lit(0)).alias("n_valid"))
        for i, n in enumerate(columns) for label, tag, *_rest in patterns))
    return counted.agg(*sums).select(F.explode(entries).alias("entry")).select("entry.*")


def suggested_tags(scan: DataFrame, min_rate: float = 0.5) -> DataFrame:
    """The best tag per column by hit rate, for columns that reach the rate."""
    good = scan.filter(F.col("hit_rate") >= min_rate)
    return top_per_key(good, ["column_name"], [F.desc("hit_rate"), F.asc("tag")])


def mask_table(df: DataFrame, policies: Mapping[str, str], secret: str | None = None) -> DataFrame:
    """The table with some columns masked: one projection, all other columns untouched. ``secret`` is for pseudonyms."""
    return df.withColumns({name: masks.by_policy(name, policy, secret) for name, policy in policies.items()})


def mask_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mask what the value scan finds inside running text."""
    return df.withColumns({name: masks.free_text(name) for name in columns})


def policies_of(catalog: DataFrame, schema: str, table: str, most: int = 10_000) -> dict[str, str]:
    """The masking policies of one table, for ``mask_table``: one table's column list, ``most`` columns (more is an error)."""
    rows = (
        catalog.filter((F.col("schema_name") == schema) & (F.col("table_name") == table))
        .filter(F.col("masking_policy") != c.NONE)
        .select("column_name", "masking_policy")
        .limit(most + 1)
        .collect()
    )
    if len(rows) > most:
        raise ValueError(f"more than {most} masked columns in {schema}.{table}")
    return {r.column_name: r.masking_policy for r in rows}


def smallest(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """(column number, pick, value): the ``k`` distinct non-empty values of each column with the smallest hashes, and maybe more.

    A bottom-k sketch for each column: a task keeps ``k`` values of a column, whatever it reads, and sends no more. Two tasks' rows
    together hold the smallest of both, so the k smallest of all are among what is returned.
    """
    texts = [F.col(n).cast("string") for n in names]
    listed = df.select(*(F.md5(t).alias(f"p{i}") for i, t in enumerate(texts)), *(t.alias(f"v{i}") for i, t in enumerate(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set[tuple[str, str]]] = [set() for _ in names]
        limit: list[str | None] = [None] * len(names)
        for batch in batches:
            for i in range(len(names)):
                pick, value = batch.column(i), batch.column(len(names) + i)
                wanted = pc.greater(pc.binary_length(value), 0)
                if limit[i] is not None:
                    wanted = pc.and_(wanted, pc.less_equal(pick, limit[i]))
                part = pa.table([pick.filter(wanted), value.filter(wanted)], ["p", "v"])
                if limit[i] is None and len(part) > 8 * k:
                    # The k-th smallest hash of a batch bounds what can be among the smallest; equal hashes are equal values.
                    some = pc.sort_indices(pc.unique(part["p"]))[:k]
                    part = part.filter(pc.less_equal(part["p"], pc.unique(part["p"])[some[-1].as_py()]))
                held[i].update(zip(part["p"].to_pylist(), part["v"].to_pylist(), strict=True))
                held[i] = set(sorted(held[i])[:k])
                if len(held[i]) == k:
                    limit[i] = max(held[i])[0]
        rows = [(i, p, v) for i, kept in enumerate(held) for p, v in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.string(), pa.string()))],
            ["column", "pick", "value"])

    return listed.mapInArrow(run, "column int, pick string, value string")


def masked_samples(df: DataFrame, policies: Mapping[str, str], k: int = 3, secret: str | None = None) -> DataFrame:
    """``k`` masked sample values per column: distinct non-empty values, picked by hash so that the choice is stable.

    One scan of the table, whatever the number of columns and values; the plan has two expressions for each column.
    """
    names = list(policies)
    found = smallest(df, names, k).dropDuplicates(["column", "value"])
    picked = top_per_key(found, ["column"], [F.col("pick"), F.col("value")], k, "sample_number")

    def of_column(values: Sequence[str]) -> Column:
        return F.get(F.array(*map(F.lit, values)).cast("array<string>"), F.col("column"))

    masked = masks.by_policy_column("value", of_column([policies[n] for n in names]), secret)
    return picked.select(of_column(names).alias("column_name"), "sample_number", masked.alias("masked_value"))


def sample_lists(samples: DataFrame) -> DataFrame:
    """Samples as one array per column; at most ``k`` entries, as many as were picked."""
    pairs = F.array_sort(F.collect_list(F.struct("sample_number", "masked_value")))
    return samples.groupBy("column_name").agg(pairs.getField("masked_value").alias("sample_values"))
