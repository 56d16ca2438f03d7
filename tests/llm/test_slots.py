import zlib
from collections import Counter

import pytest
from conftest import SF, rows
from llm.cases import EDGES

from wardline.llm import slots
from wardline.llm.queries import op2_virtual_slot_shards


def test_whole_table(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = op2_virtual_slot_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    held = Counter()
    for r in found:
        blob = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(blob) + 1, zlib.crc32(blob), "bytes", None)
        held[r.shard] += r["size"]
    assert set(held) == set(range(8))
    largest = max(r["size"] for r in found)
    assert max(held.values()) - min(held.values()) <= largest
    for shard in range(8):
        places = sorted(r.slot for r in found if r.shard == shard)
        assert places == list(range(len(places)))


def test_edges_and_order(spark, clashing):
    found = slots.shard(clashing, shards=3)
    assert found.count() == len(EDGES)
    again = slots.shard(clashing.repartition(5), shards=3)
    assert rows(found) == rows(again)
    assert slots.shard(clashing.limit(0), shards=3).collect() == []
    sizes = sorted(r["size"] for r in found.collect())
    assert sizes == sorted(len((t or "").encode()) + 1 for _, t, *_ in EDGES)


def test_map_is_versioned_and_edited(spark, edges):
    from wardline.session import work_path

    path = work_path(spark, "map")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = slots.shard(docs, shards=4, map_path=path).collect()
    old = slots.stored_map(spark, path)
    second = slots.shard(docs, shards=5, map_path=path).collect()
    new = slots.stored_map(spark, path)
    assert (old.version, new.version) == (1, 2) and slots.stored_map(spark, path, 1) == old
    was, now = ({r["id"]: r["shard"] for r in x} for x in (first, second))
    moved = [i for i in was if was[i] != now[i]]
    assert moved and all(now[i] == 4 for i in moved)
    held = Counter()
    for r in second:
        held[r["shard"]] += r["size"]
    assert max(held.values()) - min(held.values()) <= 2 * max(r["size"] for r in second)


def test_an_empty_map_folder_gets_a_first_map(spark, edges, tmp_path):
    slots.shard(edges, shards=2, map_path=f"{tmp_path}").collect()
    assert slots.stored_map(spark, f"{tmp_path}").version == 1


def test_copies_without_an_id_spread(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(slots, "RUN", 100)
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("xy").alias("text"))
    other = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"))
    twice = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("zz").alias("text"))
    found = slots.shard(same.unionAll(other).unionAll(twice), shards=8)
    loads = {r["shard"]: r["n"] for r in found.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert sum(loads.values()) == 30_000 and max(loads.values()) - min(loads.values()) <= 30
    assert found.filter("id = 7").count() == 2001 and found.filter("id IS NULL").count() == 4000
    assert found.select("shard", "slot").distinct().count() == 10_000


def test_rebalancing_moves_little():
    loads = {i: 100 + i % 7 for i in range(slots.SLOTS)}
    old = slots.first_map(loads, 8)
    assert slots.rebalanced(old, loads).shard_of == old.shard_of
    heavier = loads | {i: 400 for i in range(0, slots.SLOTS, 64)}
    new = slots.rebalanced(old, heavier)
    moved = sum(a != b for a, b in zip(old.shard_of, new.shard_of, strict=True))
    held = new.loads(heavier)
    assert moved < slots.SLOTS / 20 and max(held) - min(held) <= 0.011 * sum(held) / 8
    with pytest.raises(ValueError, match="keeps its shards"):
        slots.rebalanced(old, loads, 7)
