"""Hashing of words in blocks of texts, in numpy, for code that runs inside Spark tasks.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D. The hashes are 64 bits wide and fixed: they do not
depend on the process, the machine or the block a text is in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words hashed at once; bounds the memory of the running sums.
WORDS_AT_ONCE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2^64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, (n - 1).bit_length())
        held = np.full(size, base, U64)
        held[0] = 1
        held = np.cumprod(held, dtype=U64)
        if size <= 1 << 22:
            _powers[base] = held
    return held[:n]


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes that follow each other."""
    out = np.empty(len(start), U64)
    for low in range(0, len(start), WORDS_AT_ONCE):
        high = min(low + WORDS_AT_ONCE, len(start))
        begin, stop = int(start[low]), int(end[high - 1])
        part = _BYTE[data[begin:stop]] * powers(_BASE, stop - begin)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(part, dtype=U64)))
        at = start[low:high] - begin
        out[low:high] = (sums[end[low:high] - begin] - sums[at]) * powers(_BACK, stop - begin)[at]
    return mix(out)


class Words:
    """The words of a block of texts: hash, text number, and place in the joined bytes."""

    def __init__(self, texts: Sequence[str | None], lower: bool = True, letters: np.ndarray | None = None):
        """``letters`` marks the bytes that separate words, if they are not the usual ones."""
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(blobs) + b"\n", np.uint8)
        self.sizes = np.fromiter((len(b) for b in blobs), np.int64, len(blobs))
        self.first = np.concatenate(([1], 1 + np.cumsum(self.sizes + 1)))[:-1].astype(np.int64)
        self.data = LOWER[data] if lower else data
        space = (SPACE if letters is None else letters)[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        bounds = np.searchsorted(self.start, self.first)
        self.count = np.diff(np.append(bounds, len(self.start)))
        self.offset = bounds
        self.doc = np.repeat(np.arange(len(blobs)), self.count)
        self.hash = hash_runs(self.data, self.start, self.end)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of each distinct run of ``width`` words of each text, ordered by text and hash.

        A text with fewer words, but at least one, has one shingle: all its words.
        """
        n = len(self.hash)
        if not n:
            return np.empty(0, U64), np.empty(0, np.int64)
        steps = powers(0xD1B54A32D192ED03, width)
        whole = np.repeat(self.count >= width, self.count)
        rest = np.arange(n) - self.offset[self.doc]
        at = np.flatnonzero(whole & (rest <= self.count[self.doc] - width))
        value = np.zeros(len(at), U64)
        for j in range(width):
            value += self.hash[at + j] * steps[j]
        short = np.flatnonzero((self.count > 0) & (self.count < width))
        few = np.zeros(len(short), U64)
        for j in range(width - 1):
            there = self.count[short] > j
            few[there] += self.hash[self.offset[short][there] + j] * steps[j]
        few += self.count[short].astype(U64) * U64(0xA0761D6478BD642F)
        value = mix(np.concatenate((value, few)))
        doc = np.concatenate((self.doc[at], short))
        return distinct(value, doc)


def distinct(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (value, doc) pairs, ordered by doc, then value."""
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def blocks(texts: Sequence[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of texts with about ``limit`` characters in all, one text at least."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def sized(batches: Iterator[pa.RecordBatch], at: int, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about ``limit`` bytes of the texts in column ``at``, one text at least."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        whole = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return whole

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(pc.cast(batch.column(at), pa.string())), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64) + 32)
        low = 0
        while low < len(ends):
            before = int(ends[low - 1]) if low else 0
            high = min(len(ends), int(np.searchsorted(ends, before + limit - size)) + 1)
            held.append(batch.slice(low, high - low))
            size += int(ends[high - 1]) - before
            low = high
            if size >= limit:
                yield joined()
                size = 0
    if held:
        yield joined()


def jaccard_counts(left: str | None, right: str | None, width: int) -> tuple[int, int]:
    """(intersection, union) of the full shingle sets of two texts, by the words themselves."""
    a, b = word_set(left, width), word_set(right, width)
    both = len(a & b)
    return both, len(a) + len(b) - both


_SPLIT = bytes(i if not SPACE[i] else 32 for i in LOWER)


def word_set(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def grouped(items: Iterable, n: int) -> Iterator[list]:
    held: list = []
    for item in items:
        held.append(item)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held
