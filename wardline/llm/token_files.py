"""Token files: ids ranked by frequency, in whole bytes, with the lengths in control bytes apart from the data.

A file (little endian) holds
  "RVB1", documents u32, ranks u32, ids u64, data bytes u64,
  doc_id i64 x documents, doc_id missing u8 x documents, tokens u32 x documents,
  id of each rank u32 x ranks (most frequent id of the file first),
  control bytes: two bits for each id, its length less one, four ids in a byte, the first in the low bits,
  data: each id's rank in 1 to 4 bytes, low byte first.
So the 256 most frequent ids of a file take one byte. Reading needs no loop over ids: a table of 256 x 4 lengths gives the places.

Files are written by the tasks of one range-partitioned, sorted pass over the texts, at ``path`` in the shared folder, first
under a name of their own and then renamed, so a task that is run again leaves whole files only. Names sort by doc_id.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.bpe import Runs, Units, gathered
from wardline.llm.frames import ready, written
from wardline.llm.text import grouped, sized
from wardline.session import work_path

MAGIC = b"RVB1"
HEAD = np.dtype([("docs", "<u4"), ("ranks", "<u4"), ("ids", "<u8"), ("data", "<u8")])
# Ids in a file, about.
FILE_IDS = 1 << 21
# Words that the library encodes as one text.
TOGETHER = 1000
# Short texts that the library gets at once.
AT_ONCE = 4096
# Bytes of text in a part of the sorted pass, about.
PART_BYTES = 16 << 20
# Bytes of text that are encoded together.
BLOCK_BYTES = 10 << 20
# The four lengths that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def packed(rank: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data) of unsigned 32-bit numbers."""
    rank = rank.astype(np.uint32)
    extra = (rank > 0xFF).astype(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        if len(rank) and rank.max() > limit:
            extra += rank > limit
    ends = np.cumsum(extra + np.uint8(1), dtype=np.int64)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - extra - 1
    data[start] = rank & np.uint32(0xFF)
    for j in range(1, 1 + int(extra.max(initial=0))):
        there = np.flatnonzero(extra >= j)
        data[start[there] + j] = (rank[there] >> np.uint32(8 * j)) & np.uint32(0xFF)
    codes = np.zeros(-(-len(rank) // 4) * 4, np.uint8)
    codes[:len(rank)] = extra
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes(), data.tobytes()


def unpacked(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    length = LENGTHS[control].ravel()[:count]
    start = np.cumsum(length) - length
    rank = data[start].astype(np.uint32)
    for j in range(1, int(length.max(initial=1))):
        there = np.flatnonzero(length > j)
        rank[there] |= data[start[there] + j].astype(np.uint32) << np.uint32(8 * j)
    return rank


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    times = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(times)
    used = used[np.lexsort((used, -times[used]))]
    rank = np.zeros(len(times), np.uint32)
    rank[used] = np.arange(len(used), dtype=np.uint32)
    control, data = packed(rank[ids])
    head = np.array([(len(doc_ids), len(used), len(ids), len(data))], HEAD)
    return b"".join((
        MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), counts.astype("<u4").tobytes(),
        used.astype("<u4").tobytes(), control, data))


def file_content(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids of each document, all ids) of a file's bytes."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token file")
    head = np.frombuffer(blob, HEAD, 1, 4)[0]
    docs, ranks, count = int(head["docs"]), int(head["ranks"]), int(head["ids"])
    at = 4 + HEAD.itemsize

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(blob, kind, n, at)
        at += found.nbytes
        return found

    doc_id, missing, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
    used = take("<u4", ranks)
    control = take("u1", -(-count // 4))
    rank = unpacked(control, take("u1", int(head["data"])), count)
    if at != len(blob):
        raise ValueError("token file cut short or too long")
    return [None if m else int(d) for d, m in zip(doc_id, missing, strict=True)], counts.astype(np.int64), used[rank]


_units: dict[str, Units] = {}


def _tokenizer(path: str) -> Units:
    """The words of texts are encoded by the tokenizers library as it comes, once each while they are remembered; a text that holds
    the string of a special token goes to the library as a whole."""
    if path not in _units:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        special = [t.content for t in library.get_added_tokens_decoder().values()]

        spaced = np.zeros(library.get_vocab_size(), bool)
        # The library writes the byte of a space as this letter.
        spaced[[number for token, number in library.get_vocab().items() if token[0] == "\u0120"]] = True

        def ids_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts, size = [np.empty(0, np.int32)], np.empty(len(texts), np.int64)
            low = 0
            # What the library returns is many times as large as the numbers, so only some texts are encoded at a time.
            for part in grouped(texts, AT_ONCE if texts and len(texts[0]) < AT_ONCE else 32):
                found = [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
                size[low:low + len(part)] = np.fromiter(map(len, found), np.int64, len(found))
                parts.append(np.fromiter(chain.from_iterable(found), np.int32, int(size[low:low + len(part)].sum())))
                low += len(part)
            return np.concatenate(parts), size

        def encode(texts: list[str]) -> Runs:
            """Words with a space before them are encoded together: the tokens that begin with a space tell them apart."""
            single = [i for i, t in enumerate(texts) if t.count(" ") == 1 and t[0] == " " and not t[-1].isspace()]
            other = sorted(set(range(len(texts))).difference(single))
            flat, size = ids_of([texts[i] for i in other])
            joined, _ = ids_of(["".join(texts[i] for i in part) for part in grouped(single, TOGETHER)])
            first = np.flatnonzero(spaced[joined])
            if len(first) != len(single):
                joined, more = ids_of([texts[i] for i in single])
            else:
                more = np.diff(np.append(first, len(joined)))
            sizes = np.concatenate((size, more))
            back = np.argsort(np.concatenate((np.array(other, np.int64), np.array(single, np.int64))))
            return Runs(np.concatenate((flat, joined)), (np.cumsum(sizes) - sizes)[back], sizes[back])

        _units[path] = Units(encode, special)
    return _units[path]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the files in ascending id order.

    Returns the written table of files: file, n_docs, n_ids. NULL ids come first; rows with one id are ordered by the hash of the
    text. Ids are whole numbers. A NULL text counts as empty: it has the end id only. The string of a special token in a text is that
    token, as the library has it. An empty table writes no file.
    """
    spark = docs.sparkSession
    ready(spark)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES), 2 * spark.sparkContext.defaultParallelism if total > PART_BYTES else 1)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("id"), "tie").sortWithinPartitions(
        F.asc_nulls_first("id"), "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _tokenizer(tokenizer)
        system, folder = _place(path)
        system.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        files: list[tuple[str, int, int]] = []

        def write_file(doc_ids: list[int | None], counts: np.ndarray, flat: np.ndarray) -> None:
            ids = np.full(int(counts.sum()), end_id, np.int32)
            own = np.ones(len(ids), bool)
            own[np.cumsum(counts) - 1] = False
            ids[own] = flat
            name = f"{part:06d}-{len(files):05d}.rvb"
            temporary = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as out:
                out.write(file_bytes(doc_ids, counts, ids))
            system.move(temporary, f"{folder}/{name}")
            files.append((name, len(doc_ids), len(ids)))

        for batch in sized(batches, 1, BLOCK_BYTES):
            flat, count = units.texts(pc.cast(batch.column(1), pa.large_string()))
            doc_ids, ends = batch.column(0).to_pylist(), np.concatenate(([0], np.cumsum(count)))
            low = 0
            while low < len(doc_ids):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + FILE_IDS)))
                write_file(doc_ids[low:high], count[low:high] + 1, flat[ends[low]:ends[min(high, len(doc_ids))]])
                low = high
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in files], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["file", "n_docs", "n_ids"])

    return written(rows.mapInArrow(write, "file string, n_docs long, n_ids long"), "token-files")


def read_files(files: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """One row for each document, from the files: doc_id, file, start, n_tokens, ids (array<int>).

    ``start`` is the number of ids of all documents before it. The files' own sums are added up over the table of files, which
    has a row for some million ids.
    """
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    # One file in a task at a time, whatever their number.
    dealt = placed.repartition(max(1, files.count()), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_stream(f"{folder}/{name}") as source:
                    doc_ids, counts, ids = file_content(source.read())
                ends = np.concatenate(([0], np.cumsum(counts)))
                for low in range(0, len(doc_ids), 256):
                    high = min(low + 256, len(doc_ids))
                    lists = pa.ListArray.from_arrays(
                        pa.array((ends[low:high + 1] - ends[low]).astype(np.int32)),
                        pa.array(ids[ends[low]:ends[high]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[low:high], pa.int64()), pa.array([name] * (high - low)),
                         pa.array(first + ends[low:high]), pa.array(counts[low:high]), lists],
                        [id_column, "file", "start", "n_tokens", "ids"])

    return dealt.mapInArrow(read, f"{id_column} long, file string, start long, n_tokens long, ids array<int>")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    own = ["doc_id", "start", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], [*own, "ids_crc32"])

    return rows.select(*own, "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_path(spark: SparkSession) -> str:
    return work_path(spark, "tokens")
