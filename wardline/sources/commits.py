"""Stored tables that change safely: a log that takes each row once, and a keyed table of which an upsert rewrites few buckets.

Spark writes rows below ``_staging``, a name that its readers skip, and the finished folder is renamed into place. So a folder
that has its final name is complete, a run that was killed leaves the table as it was, and what it staged is never read. The rename
must be atomic, as on HDFS and local disks. A table has one writer at a time; a second one fails at the rename instead of
overwriting. An append or upsert lists one folder for each earlier batch or version, so batches should be minutes, not rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from wardline.operators.joins import top_per_key


class Folder:
    """Listing and renaming below one path, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, place: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}" if place else self.path)

    def names(self, place: str = "") -> list[str]:
        """Names of the sub-folders, without hidden ones."""
        at = self._at(place)
        system = at.getFileSystem(self._conf)
        if not system.exists(at):
            return []
        found = [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()]
        return sorted(n for n in found if not n.startswith(("_", ".")))

    def staging(self) -> str:
        return f"_staging/{uuid.uuid4().hex}"

    def commit(self, staged: str, place: str) -> None:
        """Rename a staged folder to its final name; an error if that name is taken."""
        source, target = self._at(staged), self._at(place)
        target.getFileSystem(self._conf).mkdirs(target.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        context.rename(source, target, self.spark.sparkContext._gateway.new_array(rename, 0))

    def remove(self, place: str) -> None:
        at = self._at(place)
        at.getFileSystem(self._conf).delete(at, True)


# --- a log that takes each row once ----------------------------------------------------------------------------


def _label(names: Sequence[str], prefix: str) -> list[str]:
    return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]


def batches(spark: SparkSession, path: str) -> list[str]:
    """The batches that the log holds, complete ones only."""
    return _label(Folder(spark, path).names(), "batch=")


def logged(spark: SparkSession, path: str, schema: StructType, batch: str | None = None) -> DataFrame:
    """All rows of the log, or those of one batch, with their ``day``; none before the first append."""
    folder = Folder(spark, path)
    held = [n for n in folder.names() if n == f"batch={batch}" or batch is None and n.startswith("batch=")]
    # A batch without new rows is a folder without files.
    held = [n for n in held if folder.names(n)]
    typed = StructType([*schema.fields, StructField("day", DateType())])
    if not held:
        return spark.createDataFrame([], typed)
    return spark.read.schema(typed).option("basePath", folder.path).parquet(*(f"{folder.path}/{n}" for n in held)).select(
        *typed.names)


def append_once(rows: DataFrame, path: str, batch: str | None = None, id_column: str = "governance_decision_id",
                time_column: str = "timestamp") -> bool:
    """Append the rows whose id the log does not hold yet; False if the batch was there already.

    A batch with a name is appended once, however often it comes. A row of another batch whose id is known is left out; an id's
    rows have one day, so only the days that a batch touches are read, and none if all its days are new. Of a batch's rows
    with one id that differ, the smallest is taken. Rows without an id are told apart by their content inside a batch,
    and not recognised in a later one. An empty batch is remembered by its name.
    """
    spark = rows.sparkSession
    folder = Folder(spark, path)
    known = folder.names()
    name = f"batch={batch or uuid.uuid4().hex}"
    if name in known:
        return False
    schema = rows.schema
    unnamed = F.when(F.col(id_column).isNull(), F.xxhash64(*map(F.col, rows.columns)))
    unique = top_per_key(rows, [F.col(id_column), unnamed], [F.col(c) for c in rows.columns])
    staged = folder.staging()
    unique.withColumn("day", F.to_date(time_column)).write.partitionBy("day").parquet(f"{folder.path}/{staged}")
    days = set(folder.names(staged))
    shared = [f"{b}/{day}" for b in known for day in days.intersection(folder.names(b))]
    if shared:
        held = spark.read.schema(schema).parquet(*(f"{folder.path}/{s}" for s in shared)).select(id_column)
        typed = StructType([*schema.fields, StructField("day", DateType())])
        new = spark.read.schema(typed).parquet(f"{folder.path}/{staged}").join(held, id_column, "left_anti")
        first, staged = staged, folder.staging()
        new.select(*typed.names).write.partitionBy("day").parquet(f"{folder.path}/{staged}")
        folder.remove(first)
    folder.commit(staged, name)
    return True


# --- a keyed table -----------------------------------------------------------------------------------------------

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Keyed:
    """A table of one row per key, dealt into buckets by the key's hash.

    ``<path>/buckets=<n>/version=<number>-<label>/bucket=<b>`` holds the rows of a bucket as of a version; a version has only the
    buckets that its upsert touched, and the newest one of each bucket is the table.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.keys, self.buckets = spark, list(keys), buckets
        given = _label(Folder(spark, path).names(), "buckets=")
        if given and given != [str(buckets)]:
            raise ValueError(f"{path} has {given[0]} buckets")
        self.folder = Folder(spark, f"{path.rstrip('/')}/buckets={buckets}")

    def versions(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("version=")]

    def labels(self) -> list[str]:
        return [n.partition("-")[2] for n in self.versions()]

    def live(self) -> dict[str, str]:
        """Bucket -> folder of its newest rows."""
        found: dict[str, str] = {}
        for version in self.versions():
            for bucket in self.folder.names(version):
                found[bucket] = f"{version}/{bucket}"
        return found

    def _read(self, places: Sequence[str], schema: StructType) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder.path}/{p}" for p in places))

    def rows(self, schema: StructType) -> DataFrame:
        return self._read(sorted(self.live().values()), schema)

    def _stage(self, rows: DataFrame) -> str:
        """Rows by bucket, sorted by key, with Bloom filters on the keys, so that a reader can skip row groups."""
        staged = self.folder.staging()
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        writer = rows.withColumn("bucket", place).repartition("bucket").sortWithinPartitions("bucket", *self.keys).write
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.partitionBy("bucket").parquet(f"{self.folder.path}/{staged}")
        return staged

    def get(self, schema: StructType, *values) -> DataFrame:
        """The row of one key: reads the files of its bucket only, and of those the row groups that may hold it."""
        types = [schema[k].dataType.simpleString() for k in self.keys]
        names = [f"v{i}" for i in range(len(values))]
        cast = ", ".join(f"CAST(:{n} AS {t})" for n, t in zip(names, types, strict=True))
        place = self.spark.sql(f"SELECT pmod(xxhash64({cast}), {self.buckets}) AS b", dict(zip(names, values, strict=True)))
        found = self.live().get(f"bucket={place.first()['b']}")
        test = F.lit(True)
        for key, value, kind in zip(self.keys, values, types, strict=True):
            test = test & (F.col(key).isNull() if value is None else F.col(key) == F.lit(value).cast(kind))
        return self._read([found] if found else [], schema).filter(test)

    def replaced(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """The old rows without those whose key changes, and the changes. NULL is a key like others."""
        same = F.lit(True)
        for key in self.keys:
            same = same & F.col(f"o.{key}").eqNullSafe(F.col(f"c.{key}"))
        return old.alias("o").join(changes.select(*self.keys).alias("c"), same, "left_anti").unionByName(changes)

    def upsert(self, changes: DataFrame, label: str = "", merge: Merge | None = None) -> bool:
        """Put in rows of new keys and replace those of known keys; False if a version with this label is there.

        ``changes`` has one row for each key, unless ``merge(old rows of the buckets, changes)`` takes care of that. Only the
        buckets that hold a changed key are read and written. Without changes a version is written that has no bucket.
        """
        if label and label in self.labels():
            return False
        schema = changes.schema
        staged = self._stage(changes)
        live = self.live()
        touched = self.folder.names(staged)
        old = [live[b] for b in touched if b in live]
        if touched and (old or merge):
            given = self.spark.read.schema(schema).parquet(f"{self.folder.path}/{staged}").select(*schema.names)
            first, staged = staged, self._stage((merge or self.replaced)(self._read(old, schema), given))
            self.folder.remove(first)
        number = 1 + max((int(v.removeprefix("version=").partition("-")[0]) for v in self.versions()), default=0)
        self.folder.commit(staged, f"version={number:09d}-{label}")
        return True

    def vacuum(self) -> None:
        """Delete folders of buckets that a newer version replaced, and what killed runs staged. The versions' names stay, as
        they tell which labels are done. Not while others read the table."""
        live = set(self.live().values())
        for version in self.versions():
            for bucket in self.folder.names(version):
                if f"{version}/{bucket}" not in live:
                    self.folder.remove(f"{version}/{bucket}")
        self.folder.remove("_staging")
