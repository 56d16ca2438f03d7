"""Near-duplicate documents by SetSketch registers (MinHash family).

A document's set of word shingles becomes 256 registers. For each shingle the register values are the order statistics of
256 exponential variables, handed to the registers in an order of the shingle's own; a register keeps the smallest value
it is given, on a scale of exponentially spaced steps (base 1.001, rate 20), cut off at both ends. So registers of a union are
the larger ones of the parts, register by register, and two registers agree with about the Jaccard similarity.

1. Sketch: one pass over the texts. Documents with the same set become one class; its first row stands for it.
2. Bands: 42 bands of 6 registers. A pair with similarity 0.8 shares no band with a chance of about 3 in a million. Band values that
   one class has, which are almost all, are counted by 48 bits and left out before classes are dealt out by them.
3. Stars: in each bucket (documents with one band value) every class is paired with the first one only. Pairs
   are judged by the likelihood of their registers given both set sizes; what isn't far below the threshold is then
   confirmed on the full sets of shingles, taken from the texts. Confirmed links give components.
4. Second stars: in buckets whose classes lie in several components, classes outside the largest one are paired with
   one of its members, another one in each bucket.
5. The rest: what still lies in several components is compared in full with all classes of the largest one and of the other
   ones, in groups of bounded size that send out links, not pairs. Pairs inside one component need no check, as they change no
   component. So no link found by a band is lost, whatever the size of a bucket, and no bucket is cut.

Nothing here is sampled or capped. Whatever is used more than once is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.frames import IdFilter, ready, written
from wardline.llm.graph import components
from wardline.llm.text import Words, blocks, jaccard_counts, mix

REGISTERS = 256
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
BAND = 6
BANDS = REGISTERS // BAND
# Bits of a band key by which keys are counted first.
SHORT = 48
# Pairs whose likeliest similarity lies this many standard errors below the threshold are not confirmed.
ERRORS = 5.0
# Classes of one side in a group of the last step.
BLOCK = 512
U64 = np.uint64


def registers(value: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """SetSketch registers, one row of 256 for each document, from distinct (shingle hash, document) pairs.

    A shingle hands out its values from the smallest up, and stops as soon as the next one can't lower any register of its
    document; so a long document costs few steps for each shingle.
    """
    least = np.full((docs, REGISTERS), np.inf)
    flat = least.reshape(-1)
    x = np.zeros(len(value))
    seed = mix(value ^ U64(0x5851F42D4C957F2D))
    place = (seed >> U64(20)).astype(np.int64) & (REGISTERS - 1)
    step = ((seed >> U64(40)).astype(np.int64) & (REGISTERS - 1)) | 1
    for j in range(REGISTERS):
        draw = mix(value + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(11)
        x = x - np.log((draw.astype(np.float64) + 0.5) * 2.0**-53) / (RATE * (REGISTERS - j))
        np.minimum.at(flat, doc * REGISTERS + place, x)
        useful = x < least.max(axis=1)[doc]
        if not useful.all():
            value, doc, x, place, step = value[useful], doc[useful], x[useful], place[useful], step[useful]
            if not len(value):
                break
        place = (place + step) & (REGISTERS - 1)
    with np.errstate(divide="ignore"):
        kept = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(kept, 0, TOP).astype("<u2")


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets."""
    return np.maximum(left, right)


def likeliest(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of each pair of register rows, given both set sizes."""
    above = (left > right).sum(axis=-1).astype(float)
    below = (left < right).sum(axis=-1).astype(float)
    same = REGISTERS - above - below
    u = n_left / (n_left + n_right)
    v = 1 - u

    def chance(share: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(share, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        more, less = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return (above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny))
                + same * np.log(np.maximum(1 - more - less, tiny)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rising = score(a) < score(b)
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    return (low + high) / 2


def sketches(docs: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """One written row for each document: uid, id, mark, n_shingles, digest of the set, registers, text."""
    ready(docs.sparkSession)
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in blocks(texts):
                value, doc = Words(texts[low:high]).shingles(width)
                size = np.bincount(doc, minlength=high - low)
                held = registers(value, doc, high - low)
                at = np.concatenate(([0], np.cumsum(size)))
                digest = [
                    hashlib.blake2b(value[at[i]:at[i + 1]].tobytes(), digest_size=16).digest() if size[i] else None
                    for i in range(high - low)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, high - low), pa.array(size, pa.int64()),
                     pa.array(digest, pa.binary()),
                     pa.array([held[i].tobytes() if size[i] else None for i in range(high - low)], pa.binary()),
                     pa.array(texts[low:high], pa.string())],
                    ["id", "n_shingles", "digest", "regs", "text"],
                )

    rows = given.mapInArrow(sketch, f"id {kind}, n_shingles long, digest binary, regs binary, text string")
    rows = rows.withColumn("mark", _mark(F.col("id"), F.col("text")))
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "sketches")


def _mark(key: Column, text: Column) -> Column:
    """What stands for a missing id: a hash of the text."""
    return F.when(key.isNull(), F.xxhash64(text))


def may_reach(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, floor: float) -> np.ndarray:
    """If the likeliest similarity of each pair is at least ``floor``: the likelihood still rises there."""
    above = (left > right).sum(axis=-1).astype(float)
    below = (left < right).sum(axis=-1).astype(float)
    same = REGISTERS - above - below
    u = n_left / (n_left + n_right)
    v = 1 - u
    share = (BASE - 1) / BASE
    more, less = (np.clip(x, 1e-9, 1) for x in (u - v * floor, v - u * floor))
    p_more, p_less = (-np.log1p(-x * share) / np.log(BASE) for x in (more, less))
    slope_more, slope_less = (-k * share / (1 - x * share) / np.log(BASE) for k, x in ((v, more), (u, less)))
    rise = (above * slope_more / p_more + below * slope_less / p_less
            - same * (slope_more + slope_less) / np.maximum(1 - p_more - p_less, 1e-12))
    return (rise >= 0) & (np.minimum(n_left, n_right) >= floor * np.maximum(n_left, n_right))


def _floor(percent: int) -> float:
    bar = percent / 100
    return bar - ERRORS * (bar * (1 - bar) / REGISTERS) ** 0.5


def _rows_of(held: DataFrame, uids: DataFrame, *columns: str) -> DataFrame:
    """Some columns of some rows; what an id filter keeps away isn't shuffled."""
    near = IdFilter(uids, "uid")
    return held.filter(near.maybe(F.col("uid"))).select("uid", *columns)


def _with_both(pairs: DataFrame, held: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both rows, named ``column_a`` and ``column_b``."""
    ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    rows = _rows_of(held, ends, *columns)
    for end in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("uid").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def likely(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs that may reach the threshold by their registers and set sizes, as a written table."""
    floor = _floor(percent)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS)
                               for c in ("regs_a", "regs_b"))
                sizes = (batch.column(c).to_numpy().astype(float) for c in ("n_shingles_a", "n_shingles_b"))
                good = pa.array(may_reach(left, right, *sizes, floor))
                yield batch.select(["a", "b"]).filter(good)

    both = _with_both(pairs, held, "n_shingles", "regs").select("a", "b", "n_shingles_a", "n_shingles_b", "regs_a", "regs_b")
    return written(both.mapInArrow(judge, "a long, b long"), "pairs")


def confirmed(pairs: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of uids whose sets have ``100 * intersection >= percent * union``, as a written table.

    Texts are moved only for pairs that may reach the threshold by their registers.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                shared, union = jaccard_counts(left, right, width)
                good.append(100 * shared >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = _with_both(likely(pairs, held, percent), held, "text").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(judge, "a long, b long"), "links")


def open_buckets(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, uid, component, main) of the buckets whose classes lie in several components; main is the bucket's most
    frequent one. The star's centre has been compared with all others and is left out."""
    placed = (
        buckets.filter("uid != centre")
        .join(parts.withColumnRenamed("node", "uid"), "uid", "left")
        .select("key", "uid", F.coalesce("component", "uid").alias("component"))
    )
    by_part = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = by_part.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select("key", "main")
    return written(placed.join(keys, "key"), "open")


def second_stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b): every class outside a bucket's main component, with one member of that component, another one in each
    bucket. So a class meets up to 42 different members of a group."""
    centres = rows.filter("component = main").groupBy("key").agg(
        F.min_by("uid", F.xxhash64("uid", "key")).alias("b"))
    return rows.filter("component != main").join(centres, "key").select(F.col("uid").alias("a"), "b").distinct()


def settle(rows: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links that join different components of open buckets: one at least for every two components that any
    bucket's pair of classes links.

    Classes outside the main component of one of their buckets ask; all classes of the buckets with that main component answer.
    Askers and answerers are cut into blocks, and each pair of blocks is one group of bounded size, in which pairs are judged by
    registers and confirmed on full sets. Only links leave a group.
    """
    asks = rows.filter("component != main").select("main", "uid", "component").distinct()
    answers = rows.select("main", "uid", "component").distinct()

    def cells(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))

    grid = cells(asks, "n_i").join(cells(answers, "n_j"), "main")
    sketch = _rows_of(held, answers.select("uid").distinct(), "n_shingles", "regs", "text")

    def dealt(of: DataFrame, own: str, other: str, asking: bool) -> DataFrame:
        cell = F.pmod(F.xxhash64("uid"), F.col(f"n_{own}")).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)).alias(other)
        placed = of.join(grid, "main").select("main", "uid", "component", cell, f"n_{other}")
        return placed.join(sketch, "uid").select(
            "main", "uid", "component", "n_shingles", "regs", "text", own, every, F.lit(asking).alias("asks"))

    both = dealt(asks, "i", "j", True).unionByName(dealt(answers, "j", "i", False))
    floor = _floor(percent)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["asks", "uid"], ignore_index=True)
        uid, part, size = (group[c].to_numpy() for c in ("uid", "component", "n_shingles"))
        regs = np.frombuffer(b"".join(group["regs"]), "<u2").reshape(-1, REGISTERS)
        text = group["text"].tolist()
        asking = group["asks"].to_numpy()
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        sets: list[np.ndarray] = []
        for low, high in blocks(text):
            value, doc = Words(text[low:high]).shingles(width)
            sets.extend(np.split(value, np.cumsum(np.bincount(doc, minlength=high - low))[:-1]))
        answer = np.flatnonzero(~asking)
        links: list[tuple[int, int]] = []
        for q in np.flatnonzero(asking):
            near = answer[(part[answer] != part[q])
                          & (100 * np.minimum(size[answer], size[q]) >= percent * np.maximum(size[answer], size[q]))]
            if not len(near):
                continue
            mine = np.broadcast_to(regs[q], (len(near), REGISTERS))
            likely = may_reach(mine, regs[near], np.full(len(near), float(size[q])), size[near].astype(float), floor)
            for m in near[likely]:
                a, b = root(int(part[q])), root(int(part[m]))
                if a == b:
                    continue
                at = np.minimum(np.searchsorted(sets[m], sets[q]), len(sets[m]) - 1)
                shared = int((sets[m][at] == sets[q]).sum())
                if 100 * shared < percent * (len(sets[q]) + len(sets[m]) - shared):
                    continue
                shared, union = jaccard_counts(text[q], text[m], width)
                if 100 * shared >= percent * union:
                    top[max(a, b)] = min(a, b)
                    links.append((int(uid[q]), int(uid[m])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return written(both.groupBy("main", "i", "j").applyInPandas(compare, "a long, b long"), "settled")


def classes(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """uid, id, mark, n_shingles and component (the smallest uid of the component's first rows) of every row.

    A document without words is alone. Ids may be NULL or repeated: rows are told apart by uid.
    """
    held = sketches(docs, width, id_column, text_column)
    worded = held.filter("digest IS NOT NULL")
    first = worded.groupBy("digest").agg(F.min("uid").alias("first"))
    own = ["uid", "id", "mark", "n_shingles"]
    members = written(
        worded.select(*own, "digest").join(first, "digest").select(*own, "first")
        .unionByName(held.filter("digest IS NULL").select(*own, F.col("uid").alias("first"))), "members")
    leaders = members.filter("uid = first AND n_shingles > 0").select("uid")
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * 2 * BAND + 1, F.lit(2 * BAND))))
    # Registers stay where they are: copies of a leader are kept away by a filter, the few it lets through by the join below.
    near = IdFilter(leaders, "uid")
    banded = worded.filter(near.maybe(F.col("uid"))).select("uid", "n_shingles", F.explode(bands).alias("key"))
    # Almost all keys have one class. They are counted by a part of the key, and only classes under a key that may be shared are dealt out.
    part = F.col("key").bitwiseAND((1 << SHORT) - 1)
    common = written(
        banded.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part"), "common")
    rows = banded.filter(IdFilter(common, "part").maybe(part)).join(leaders, "uid", "left_semi")
    rows = written(rows, "banded")
    shared = rows.groupBy("key").agg(
        F.min(F.struct("uid", "n_shingles")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(rows.join(shared.select(
        "key", F.col("first.uid").alias("centre"), F.col("first.n_shingles").alias("n_centre")), "key"), "buckets")
    # A pair whose sizes are too far apart can't reach the threshold.
    sized = F.least("n_shingles", "n_centre") * 100 >= F.greatest("n_shingles", "n_centre") * percent
    stars = buckets.filter((F.col("uid") != F.col("centre")) & sized).select(
        F.col("uid").alias("a"), F.col("centre").alias("b")).distinct()
    buckets = buckets.select("key", "uid", "centre")
    parts = components(confirmed(written(stars, "stars"), held, width, percent))

    def with_links(links: DataFrame) -> DataFrame:
        return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    rows = open_buckets(buckets, parts)
    if not rows.isEmpty():
        parts = with_links(confirmed(written(second_stars(rows), "stars"), held, width, percent))
        rows = open_buckets(buckets, parts)
    if not rows.isEmpty():
        links = settle(rows, held, width, percent)
        if not links.isEmpty():
            parts = with_links(links)
    return members.join(parts.withColumnRenamed("node", "first"), "first", "left").select(
        "uid", "id", "mark", "n_shingles", F.coalesce("component", "first").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row given.

    ``component_id`` is the smallest id of the documents reachable by links, its own included; ``kept`` marks the document
    that has it. A NULL text and a text without words have no shingles and no links. A NULL id is never the smallest one
    unless it is alone; its row is kept only if its component has no id at all (component_id NULL). Rows with the same id and
    the same words are both marked. An empty table gives an empty one. Other columns are not read.
    """
    members = written(classes(docs, width, percent, id_column, text_column), "classes")
    least = members.groupBy("component").agg(F.min("id").alias("component_id"))
    return members.join(least, "component").select(
        F.col("id").alias(id_column), "n_shingles", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest id.

    All columns stay. Rows without an id are told apart by their text, and come after those with one. Rows with one id are copies
    of one document, and one of them stays. Only rows that an id filter can't tell from removed or repeated ones are joined.
    """
    members = written(classes(docs, width, percent, id_column, text_column), "classes")
    name = F.struct(F.col("id").isNull().alias("missing"), "id", "mark")
    best = members.groupBy("component").agg(F.min(name).alias("best"))
    gone = written(
        members.join(best, "component").filter(~name.eqNullSafe(F.col("best"))).select("id", "mark").distinct(), "gone")
    twice = written(
        members.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "mark"), "twice")
    near = IdFilter(gone.unionByName(twice), "id", "mark")
    own = docs.columns
    docs = docs.withColumn("__mark", _mark(F.col(id_column), F.col(text_column).cast("string")))
    maybe = near.maybe(F.col(id_column), F.col("__mark"))
    other = gone.select(F.col("id").alias("__id"), F.col("mark").alias("__other"))
    same = F.col(id_column).eqNullSafe(F.col("__id")) & F.col("__mark").eqNullSafe(F.col("__other"))
    left = docs.filter(maybe).join(other, same, "left_anti").dropDuplicates([id_column, "__mark"])
    return docs.filter(~maybe).unionByName(left).select(*own)


# The same components by all pairs that share a shingle, for tables of moderate size.
ORACLE = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) > 1 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))
    ELSE words END AS found FROM split
), listed AS (
  SELECT doc_id, len(found) AS n, unnest(found) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM listed a JOIN listed b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other
)
SELECT s.doc_id, len(s.found)::BIGINT AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reached r USING (doc_id) GROUP BY s.doc_id, s.found"""
