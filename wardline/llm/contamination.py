"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are sequences of words (runs of letters and digits, ASCII letters in lower case; in scripts without spaces each character is
a word), so case, punctuation and white space don't count. Items of two to four words, which allow no edits, are looked up as they
are, in the same pass; a single word identifies no passage. A
window of a document matches an item of n words if their word edit distance is at most ``edits(n)`` (a fifth of n).

1. Windows: item-sized, at every word of the document where one can lie at all. An item within k edits of a window shares at
   least n - 1 - 2k of its word pairs with it (the q-gram lemma), so windows with fewer pairs of any item are left out; this
   loses nothing and keeps the rest of the work to a few windows.
2. CGK embedding: a random walk over the window. Step j writes the word under the pointer and moves on by one or not,
   by a random bit for (j, word). Two sequences walk alike until they differ and meet again soon after few edits, so a small
   edit distance becomes a small Hamming distance.
3. Bit sampling: each of the tables hashes a few steps of one walk; windows and items with one value in any table are
   candidates. There are as many tables as it takes for the target recall at the largest distance, by a simulation of random
   edits on the items.
4. Candidates are verified by the exact edit distance, with the window's end free within the allowed edits.

The benchmark is the query set. It goes to the tasks in blocks of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from wardline.llm.frames import ready
from wardline.llm.text import Words, blocks, mix

U64 = np.uint64
# Share of an item's words that may be edited.
EDITS = 0.2
# Items with fewer words allow no edits and are matched exactly.
LEAST_WORDS = 5
# Shortest items, in words, for which ``decontaminate`` takes a document out: one word identifies no passage.
SHORTEST = 2
# Steps that a table hashes; walks that tables take their steps from.
SAMPLED = 3
RECALL = 0.99
# With as many tables and less than the target recall the search is given up with an error.
MOST_TABLES = 4096
# Items in a block of the query set.
ITEMS = 5000

_GAP = np.ones(256, bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _GAP[_low:_high + 1] = False
# Characters of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, Tai, kana and Han.
_ALONE = (
    "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3040-\u309f\u30a1-\u30ff"
    "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f"
    "\U0001aff0-\U0001b16f\U00020000-\U000323af")


_SINGLE = re.compile(f"([{_ALONE}])")


def _kinds() -> np.ndarray:
    """For each character 1 if it is punctuation, a symbol or a space beyond ASCII, 2 if it stands alone."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(128, sys.maxunicode + 1):
        if code < 160 or unicodedata.category(chr(code))[0] in "PSZ":
            kinds[code] = 1
    for first, last in re.findall("(.)-(.)", _ALONE):
        part = kinds[ord(first):ord(last) + 1]
        part[part == 0] = 2
    return kinds


_KINDS = _kinds()


def plain(text: str | None) -> str | None:
    """The text with spaces for signs beyond ASCII and around the characters of scripts without spaces."""
    if not text or text.isascii():
        return text
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[codes]
    most = kinds.max()
    if not most:
        return text
    text = np.where(kinds == 1, np.uint32(32), codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return _SINGLE.sub(r" \1 ", text) if most == 2 else text


def edits(n: np.ndarray | int) -> np.ndarray:
    return np.floor(EDITS * np.asarray(n) + 1e-9).astype(np.int64)


def pairs_of(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])


def walk(rows: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """CGK embedding of rows of word hashes (0 behind the end): the words under the pointers, step by step."""
    out = np.zeros((len(rows), steps), U64)
    at = np.zeros(len(rows), np.int64)
    line = np.arange(len(rows))
    width = rows.shape[1]
    for j in range(steps):
        word = np.where(at < width, rows[line, np.minimum(at, width - 1)], U64(0))
        out[:, j] = word
        key = (seed << 20) + j + 1
        at += (mix(word + U64(key * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> U64(63)).astype(np.int64)
    return out


def pattern_bits(words: np.ndarray) -> dict[int, int]:
    """For each word the places where an item has it, as bits."""
    bits: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        bits[word] = bits.get(word, 0) | 1 << i
    return bits


def distance_at_most(bits: dict[int, int], n: int, right: list[int], most: int) -> int | None:
    """Edit distance of an item of ``n`` words to the nearest beginning of ``right``, None if it is above ``most``.

    A column of the distance table is two integers, the places where it rises and falls; a word moves them on at once.
    """
    mask, last = (1 << n) - 1, 1 << n - 1
    rises, falls, here, best = mask, 0, n, n
    for word in right:
        same = bits.get(word, 0)
        down = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        up = falls | ~(across | rises) & mask
        back = rises & across
        if up & last:
            here += 1
        elif back & last:
            here -= 1
            best = min(best, here)
        up = (up << 1 | 1) & mask
        back = back << 1 & mask
        rises = back | ~(down | up) & mask
        falls = up & down
    return best if best <= most else None


@dataclass(frozen=True)
class Index:
    """A block of items, ready for the search."""

    ids: list[int | None]
    words: list[np.ndarray]
    bits: list[dict[int, int]]
    pairs: list[frozenset[int]]
    known_pairs: np.ndarray
    # For each class of lengths (windows of one size): window words, pairs needed, table values -> items.
    classes: list[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]
    # Items that are matched exactly: number of words, their values in order, items.
    short: list[tuple[int, np.ndarray, np.ndarray]]


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    words = Words([plain(t) for t in texts], letters=_GAP)
    return np.split(words.hash, np.cumsum(words.count)[:-1]) if len(texts) else []


def tables_needed(items: list[np.ndarray], size: int, recall: float) -> list[tuple[int, np.ndarray]]:
    """(walk seed, sampled steps) of each table, until ``recall`` of randomly edited items share a value with their item."""
    random = np.random.default_rng(11)
    some = [items[i] for i in random.permutation(len(items))[:64]]
    # Edits of the largest allowed number: substitutions, insertions and deletions alike, each item some times.
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for item in some:
        for _ in range(max(1, 512 // len(some))):
            edited = item.tolist()
            for _ in range(int(edits(len(item)))):
                kind, at = random.integers(3), int(random.integers(len(edited)))
                word = int(random.integers(1, 1 << 62))
                if kind == 0:
                    edited[at] = word
                elif kind == 1:
                    edited.insert(at, word)
                elif len(edited) > 1:
                    del edited[at]
            pairs.append((item, np.array(edited, U64)))
    left, right = _padded([a for a, _ in pairs], size), _padded([b for _, b in pairs], size)
    left = np.where(np.arange(size) < np.array([len(a) for a, _ in pairs])[:, None], left, U64(0))
    found = np.zeros(len(pairs), bool)
    tables: list[tuple[int, np.ndarray]] = []
    least = min(len(i) for i in items)
    while found.mean() < recall:
        if len(tables) >= MOST_TABLES:
            raise RuntimeError(f"{len(tables)} tables find {found.mean():.3f} of edited items of {size} words, not {recall}")
        seed = len(tables)
        # Steps up to the item's length: most walks are still inside both sequences.
        steps = np.sort(random.choice(least, SAMPLED, replace=False))
        tables.append((seed, steps))
        a, b = walk(left, seed, int(steps[-1]) + 1)[:, steps], walk(right, seed, int(steps[-1]) + 1)[:, steps]
        found |= (a == b).all(axis=1)
    return tables


def _padded(rows: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(rows), size), U64)
    for i, row in enumerate(rows):
        out[i, :min(size, len(row))] = row[:size]
    return out


def _value(embedded: np.ndarray, seed: int) -> np.ndarray:
    value = np.full(len(embedded), seed + 1, U64)
    for j in range(embedded.shape[1]):
        value = mix(value * U64(0x9E3779B97F4A7C15) + embedded[:, j])
    return value


def index(ids: list, texts: list[str | None], recall: float = RECALL, shortest: int = 1) -> Index:
    words = item_words(texts)
    good = [i for i, w in enumerate(words) if len(w) >= shortest]
    ids, words = [ids[i] for i in good], [words[i] for i in good]
    long = [w for w in words if len(w) >= LEAST_WORDS]
    known = np.unique(np.concatenate([pairs_of(w) for w in long])) if long else np.empty(0, U64)
    short = []
    for n in range(max(1, shortest), LEAST_WORDS):
        members = np.array([i for i, w in enumerate(words) if len(w) == n], np.int64)
        if len(members):
            value = _value(np.array([words[i] for i in members]), 0)
            order = np.argsort(value, kind="stable")
            short.append((n, value[order], members[order]))
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) < LEAST_WORDS:
            continue
        groups.setdefault(-(-len(w) // 8) * 8, []).append(i)
    classes = []
    for top, members in sorted(groups.items()):
        size = top + int(edits(top))
        items = [words[i] for i in members]
        needed = min(len(w) - 1 - 2 * int(edits(len(w))) for w in items)
        tables = []
        rows = _padded(items, size)
        for seed, steps in tables_needed(items, size, recall):
            value = _value(walk(rows, seed, int(steps[-1]) + 1)[:, steps], seed)
            order = np.argsort(value, kind="stable")
            tables.append((seed, steps, value[order], np.array(members)[order]))
        classes.append((size, max(1, needed), tables))
    return Index(ids, words, [pattern_bits(w) for w in words],
                 [frozenset(pairs_of(w).tolist()) for w in words], known, classes, short)


def search(texts: list[str | None], held: Index) -> list[tuple[int, int, int, int]]:
    """(text number, item number, first word, edit distance) of the best match of each text and item."""
    words = Words([plain(t) for t in texts], letters=_GAP)
    h = words.hash
    if not len(h):
        return []
    best = _exact(words, held)
    if len(held.known_pairs) and len(h) > 1:
        _near(words, held, best)
    return [(doc, item, int(s - words.offset[doc]), d) for (doc, item), (d, s) in sorted(best.items())]


def _exact(words: Words, held: Index) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (0, first place) of the short items."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    h = words.hash
    for n, values, items in held.short:
        if len(h) < n:
            continue
        value = _value(np.lib.stride_tricks.sliding_window_view(h, n), 0)
        low, high = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
        inside = words.doc[:len(value)] == words.doc[n - 1:]
        for s in np.flatnonzero((high > low) & inside).tolist():
            for item in items[low[s]:high[s]].tolist():
                if np.array_equal(h[s:s + n], held.words[item]):
                    best.setdefault((int(words.doc[s]), item), (0, s))
    return best


def _near(words: Words, held: Index, best: dict[tuple[int, int], tuple[int, int]]) -> None:
    """Add the matches of all other items to ``best``."""
    h = words.hash
    value = pairs_of(h)
    at = np.minimum(np.searchsorted(held.known_pairs, value), len(held.known_pairs) - 1)
    hit = (held.known_pairs[at] == value) & (words.doc[:-1] == words.doc[1:])
    sums = np.concatenate(([0], np.cumsum(hit)))
    ends = (words.offset + words.count)[words.doc]
    start = np.arange(len(h) - 1)
    fits = np.zeros((len(held.classes), len(start)), bool)
    for i, (size, needed, _) in enumerate(held.classes):
        stop = np.maximum(np.minimum(start + size, ends[:-1]) - 1, start)
        fits[i] = sums[np.minimum(stop, len(hit))] - sums[start] >= needed
    some = np.flatnonzero(fits.any(axis=0))
    for low in range(0, len(some), 1 << 14):
        part = some[low:low + (1 << 14)]
        for window, item in _candidates(part, fits[:, part], h, ends, held):
            s = int(part[window])
            key = (int(words.doc[s]), item)
            n = len(held.words[item])
            most = int(edits(n))
            old = best.get(key)
            if old and old[0] == 0:
                continue
            end = min(s + n + most, int(ends[s]))
            # The lemma once more, for this item alone.
            if sum(map(held.pairs[item].__contains__, value[s:end - 1].tolist())) < n - 1 - 2 * most:
                continue
            d = distance_at_most(held.bits[item], n, h[s:end].tolist(), most)
            if d is not None and (old is None or (d, s) < old):
                best[key] = (d, s)


def _candidates(start: np.ndarray, fits: np.ndarray, h: np.ndarray, ends: np.ndarray, held: Index) -> list[list[int]]:
    """(window, item) pairs that share a value in a table. A walk from a word is the same for windows of all sizes, so
    each walk is taken once, as far as any table of it looks."""
    longest = max(int(steps[-1]) + 1 for _, _, tables in held.classes for _, steps, *_ in tables)
    place = start[:, None] + np.arange(longest)
    rows = np.where(place < ends[start][:, None], h[np.minimum(place, len(h) - 1)], U64(0))
    found: list[np.ndarray] = []
    for seed in range(max(len(tables) for _, _, tables in held.classes)):
        of_seed = [(i, tables[seed]) for i, (_, _, tables) in enumerate(held.classes) if seed < len(tables)]
        walked = walk(rows, seed, max(int(steps[-1]) + 1 for _, (_, steps, *_) in of_seed))
        for i, (_, steps, values, items) in of_seed:
            window = np.flatnonzero(fits[i])
            code = _value(walked[window][:, steps], seed)
            low, high = np.searchsorted(values, code, "left"), np.searchsorted(values, code, "right")
            there = high > low
            window, low, high = window[there], low[there], high[there]
            while len(window):
                found.append(np.column_stack((window, items[low])))
                low = low + 1
                there = high > low
                window, low, high = window[there], low[there], high[there]
    return np.unique(np.concatenate(found), axis=0).tolist() if found else []


def matches(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, items: int = ITEMS, id_column: str = "doc_id",
            text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_item_words, distance, first_word: one row for each row of ``docs`` and item with a match, the best one.

    ``first_word`` counts from 0. NULL and empty texts and items match nothing, items of one to four words match exactly. NULL ids
    are carried like others; rows with one id each have their matches. Empty tables give an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    asked = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text"))
    item_kind = asked.schema["item"].dataType
    blocks_of = max(1, -(-asked.count() // items))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks_of)))
    found: DataFrame | None = None
    for block in range(blocks_of):
        rows = asked.filter(F.col("block") == block).orderBy("item", "text").collect()
        part = _searched(given, index([r["item"] for r in rows], [r["text"] for r in rows], recall), kind, item_kind)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("id").alias(id_column), F.col("item").alias(item_column), "n_item_words", "distance", "first_word")


def _searched(given: DataFrame, held: Index, kind: str, item_kind: DataType) -> DataFrame:
    item_type = to_arrow_type(item_kind)
    sent = given.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in blocks(texts):
                found = search(texts[low:high], known)
                if found:
                    doc, item, first, distance = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array([low + d for d in doc])),
                         pa.array([known.ids[i] for i in item], item_type),
                         pa.array([len(known.words[i]) for i in item], pa.int64()),
                         pa.array(distance, pa.int64()), pa.array(first, pa.int64())],
                        ["id", "item", "n_item_words", "distance", "first_word"])

    return given.mapInArrow(run, f"id {kind}, item {item_kind.simpleString()}, n_item_words long, distance long, first_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, text_column: str = "text",
                  item_text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` without a match, all columns. Items of fewer than ``shortest`` words take no document out.

    The decision is taken row by row, in the pass that reads the row, so nothing is joined and rows without an id are judged too.
    Here the benchmark is one block: a larger one than ``ITEMS`` is applied block after block.
    """
    ready(docs.sparkSession)
    asked = benchmark.select(F.col(item_text).cast("string").alias("text")).distinct()
    blocks_of = max(1, -(-asked.count() // ITEMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks_of)))
    own = docs.columns
    at = own.index(text_column)
    for block in range(blocks_of):
        rows = asked.filter(F.col("block") == block).orderBy("text").collect()
        sent = docs.sparkSession.sparkContext.broadcast(
            index([None] * len(rows), [r["text"] for r in rows], recall, shortest))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pc.cast(batch.column(at), pa.string()).to_pylist()
                clean = np.ones(len(texts), bool)
                for low, high in blocks(texts):
                    clean[[low + found[0] for found in search(texts[low:high], sent.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
