"""Sharding by fixed virtual slots and a versioned map from slot to shard.

Every record is hashed into one of some thousand slots, for ever. Shards are sets of slots: bytes are summed for each slot, the
map is made from these sums, stored under a version, and edited (few slots move) when shards are added or loads change. The map
has one row for each slot, so it is small whatever the data: it is worked out on the driver and broadcast.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.frames import written
from wardline.session import work_path

SLOTS = 4096
# Equal rows that are numbered at once.
RUN = 4096
MAP_SCHEMA = "vslot int, shard int, bytes long, rows long"


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard_of: tuple[int, ...]

    def loads(self, bytes_of: dict[int, int]) -> list[int]:
        held = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            held[shard] += bytes_of.get(slot, 0)
        return held


def records(docs: DataFrame, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes and 1), text_crc32, vslot of each row.

    The slot comes from the id and the text, so that copies under other ids, and rows without an id, spread too. Rows that agree in
    all three are counted and numbered from 0, and all but the first take their slot from the number as well: they spread like
    others, whatever order they come in.
    """
    text = F.col(text_column).cast("string")
    slim = docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    own = ["id", "size", "text_crc32"]
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {RUN}"))
    last = F.least(F.lit(RUN), F.col("__n") - F.col("__block") * RUN) - 1
    counted = slim.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).withColumn("__block", F.explode(blocks))
    numbered = counted.withColumn("__place", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    copy = F.col("__block") * RUN + F.col("__place")
    place = F.when(copy == 0, F.xxhash64(*own)).otherwise(F.xxhash64(*own, copy))
    return numbered.select(*own, F.pmod(place, F.lit(slots)).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """bytes and rows of each slot that has rows; one row for each slot comes to the driver."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return {r["vslot"]: (r["bytes"], r["rows"]) for r in sums.collect()}


def first_map(bytes_of: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Slots by falling size, each to the shard with the fewest bytes; empty slots in turn."""
    shard_of = [slot % shards for slot in range(slots)]
    heap = [(0, shard) for shard in range(shards)]
    for slot in sorted(bytes_of, key=lambda s: (-bytes_of[s], s)):
        held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (held + bytes_of[slot], shard))
    return SlotMap(1, shards, tuple(shard_of))


def rebalanced(old: SlotMap, bytes_of: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version for new loads or more shards: slots move from the fullest to the emptiest shard only, as long as that
    brings them closer and they differ by more than ``tolerance`` of the mean. All other slots stay where they are; if shards are
    added, slots move to the new ones only."""
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("a map keeps its shards; merge them by moving their slots")
    shard_of = list(old.shard_of)
    held = SlotMap(0, shards, old.shard_of).loads(bytes_of)
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        own[shard].append((bytes_of.get(slot, 0), slot))
    for group in own:
        group.sort()
    mean = sum(held) / shards
    takers = range(old.shards, shards) if shards > old.shards else range(shards)
    while True:
        full, empty = max(range(shards), key=held.__getitem__), min(takers, key=held.__getitem__)
        gap = held[full] - held[empty]
        if gap <= tolerance * mean:
            break
        fitting = [x for x in own[full] if 0 < x[0] <= gap / 2]
        if not fitting:
            break
        size, slot = fitting[-1]
        own[full].remove((size, slot))
        own[empty].append((size, slot))
        own[empty].sort()
        held[full] -= size
        held[empty] += size
        shard_of[slot] = empty
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def store_map(spark: SparkSession, path: str, slot_map: SlotMap, loads: dict[int, tuple[int, int]]) -> None:
    """Write a version beside the earlier ones; an existing version is never overwritten."""
    rows = [(slot, shard, *loads.get(slot, (0, 0))) for slot, shard in enumerate(slot_map.shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).withColumn("shards", F.lit(slot_map.shards)).write.parquet(
        f"{path}/version={slot_map.version}")


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The given version, or the latest one."""
    table = spark.read.parquet(path)
    version = version or table.agg(F.max("version")).first()[0]
    rows = sorted(table.filter(F.col("version") == version).select("vslot", "shard", "shards").collect())
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def placed(rows: DataFrame, slot_map: SlotMap, loads: dict[int, tuple[int, int]]) -> DataFrame:
    """Every row with its shard and its place in the shard (``slot``, gapless from 0).

    A shard holds its virtual slots one after the other, so a place is the rows of the slots before plus the rank in the own
    slot; only one virtual slot is ordered at a time.
    """
    spark = rows.sparkSession
    before = [0] * slot_map.shards
    table = []
    for vslot, shard in enumerate(slot_map.shard_of):
        table.append((vslot, shard, before[shard]))
        before[shard] += loads.get(vslot, (0, 0))[1]
    places = F.broadcast(spark.createDataFrame(table, "vslot int, shard int, __before long"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size"))
    return (
        rows.withColumn("__rank", rank).join(places, "vslot")
        .withColumn("slot", F.col("__before") + F.col("__rank") - 1)
        .withColumn("map_version", F.lit(slot_map.version)).drop("__before", "__rank")
    )


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text",
          map_path: str | None = None) -> DataFrame:
    """One row for each row given: id, size, text_crc32, vslot, shard, slot, map_version. Shards have nearly equal bytes.

    With ``map_path``, the latest map stored there is edited for the present loads and stored as the next version; without one,
    or with a missing or empty folder, a first map is made. Equal texts are not kept together: each copy has its own slot. A NULL text has size 1; NULL ids and repeated rows are rows like any other;
    an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(records(docs, slots, id_column, text_column), "records")
    loads = slot_loads(rows)
    bytes_of = {slot: held[0] for slot, held in loads.items()}
    path = map_path or work_path(spark, "slot-map")
    try:
        old = stored_map(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        old = None
    new = rebalanced(old, bytes_of, shards) if old else first_map(bytes_of, shards, slots)
    store_map(spark, path, new, loads)
    return placed(rows, new, loads)
