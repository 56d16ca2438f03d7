"""Substring search without a scan: the texts of a table by their runs of three characters.

Two tables, dealt into buckets by hash, so that a search reads the buckets of its own words only:
  postings/bucket=<hash of gram>: gram, text, n_texts; sorted by gram, one row for each distinct text with the run
  rows/bucket=<hash of text>: text, and the columns of the rows that hold it; sorted by text
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.commits import Folder

BUCKETS = 64
SIZE = 3


def _place(name: str, buckets: int):
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def _dealt(df: DataFrame, key: str, buckets: int, path: str) -> None:
    """A bucket goes to few tasks, so it has few files; one that is large, as by a text that many rows have, is split."""
    df.withColumn("bucket", _place(key, buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.option(
        f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(path)


def build(df: DataFrame, columns: Sequence[str], path: str, buckets: int = BUCKETS) -> None:
    """Index the lower-case texts of ``columns``. A row is held once for each distinct text it has; texts are indexed once,
    however many rows have them."""
    texts = F.array_distinct(F.array_compact(F.array(*(F.lower(F.col(c).cast("string")) for c in columns))))
    rows = df.withColumn("__text", F.explode(texts))
    folder = Folder(df.sparkSession, path)
    staged = folder.staging()
    _dealt(rows, "__text", buckets, f"{folder.path}/{staged}/rows")
    # The texts are read back, so the rows are made once.
    distinct = df.sparkSession.read.schema("__text string").parquet(f"{folder.path}/{staged}/rows").distinct()
    count = F.length("__text") - (SIZE - 1)
    grams = F.when(count > 0, F.transform(
        F.sequence(F.lit(1), count), lambda i: F.substring(F.col("__text"), i, F.lit(SIZE))))
    postings = distinct.select(F.explode(F.array_distinct(grams)).alias("gram"), F.col("__text").alias("text"))
    _dealt(postings, "gram", buckets, f"{folder.path}/{staged}/postings")
    folder.commit(staged, f"index={buckets}")


class Index:
    def __init__(self, spark: SparkSession, path: str):
        folder = Folder(spark, path)
        self.spark, self.name = spark, next(n for n in folder.names() if n.startswith("index="))
        self.buckets = int(self.name.removeprefix("index="))
        self.path = f"{folder.path}/{self.name}"
        self.folder = Folder(spark, self.path)

    def _buckets(self, values: Sequence[str]) -> set[int]:
        """The buckets of some texts, without a job."""
        args = {f"v{i}": v for i, v in enumerate(values)}
        listed = ", ".join(f"pmod(xxhash64(:{n}), {self.buckets})" for n in args)
        return set(self.spark.sql(f"SELECT array({listed}) AS b", args).first()["b"])

    def _read(self, part: str, buckets: set[int] | None) -> DataFrame | None:
        held = self.folder.names(part)
        wanted = held if buckets is None else [f"bucket={b}" for b in sorted(buckets) if f"bucket={b}" in held]
        if not wanted:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*(f"{self.path}/{part}/{w}" for w in wanted))

    def postings(self, word: str) -> DataFrame | None:
        """The postings of the word's rarest run; None if a run of the word is in no text. Counting reads only the word's buckets."""
        grams = sorted({word[i:i + SIZE] for i in range(len(word) - SIZE + 1)})
        found = self._read("postings", self._buckets(grams))
        if found is None:
            return None
        counts = found.filter(F.col("gram").isin(grams)).groupBy("gram").count().collect()
        if len(counts) < len(grams):
            return None
        rarest = min(counts, key=lambda r: (r["count"], r["gram"]))["gram"]
        return self._read("postings", self._buckets([rarest])).filter(F.col("gram") == rarest)

    def search(self, query: str) -> DataFrame:
        """The rows with a text that holds the query, in any case of letters, each once for equal rows of the table.

        A query of one or two characters has no run of three: it reads the indexed rows.
        """
        word = query.lower()
        rows = self._read("rows", None)
        if rows is None:
            raise ValueError(f"nothing is indexed below {self.path}")
        columns = [c for c in rows.columns if c not in ("__text", "bucket")]
        if len(word) < SIZE:
            return self._once(rows.filter(F.contains("__text", F.lit(word))), columns)
        found = self.postings(word)
        if found is None:
            return rows.select(*columns).limit(0)
        texts = found.filter(F.contains("text", F.lit(word))).select(F.col("text").alias("__text"), _place("text", self.buckets).alias("b"))
        # At most as many numbers as there are buckets reach the driver.
        wanted = {r["b"] for r in texts.select("b").distinct().collect()}
        held = self._read("rows", wanted)
        if held is None:
            return rows.select(*columns).limit(0)
        return self._once(held.join(texts.select("__text"), "__text", "left_semi"), columns)

    def _once(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """A row that holds the word in several texts is found several times."""
        return rows.select(*columns).distinct()
