"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut by the tokenizer's pattern; the pieces of a block of texts that are new are put into buckets by length, each a
matrix of token numbers with one row for each piece. In every round all rows merge their leftmost pair of minimum rank at once:
pairs are looked up in a hash table, the rows are compacted, and rows without a pair leave. Pieces too long for a matrix
are merged with a heap, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from wardline.llm.frames import ready
from wardline.llm.text import grouped, mix, sized

U64 = np.uint64
NONE = np.int32(2**31 - 1)
# Longest piece, in bytes, that is merged in a matrix; cells of a matrix at once.
LONGEST = 256
CELLS = 1 << 20
# Words, and their bytes, of one of the two generations that a worker remembers; longest word that is, in bytes.
REMEMBERED = 250_000
LETTERS = 16 << 20
LONGEST_WORD = 256
# Runs that are gathered at once. Rows that go back to Spark at once.
RUNS_AT_ONCE = 1 << 18
ROWS_OUT = 512
# Characters that are no letters, numbers or white space.
MARKS = ".,;:!?\"')]}*$%&#|"


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


class Runs:
    """Runs of token numbers in one array."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.flat, self.start, self.size = flat, start, size

    @classmethod
    def none(cls) -> Runs:
        return cls(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))

    def extended(self, more: Runs) -> Runs:
        return Runs(np.concatenate((self.flat, more.flat)), np.concatenate((self.start, len(self.flat) + more.start)),
                    np.concatenate((self.size, more.size)))

    def joined(self, which: np.ndarray, count: np.ndarray) -> Runs:
        """New runs, the next ``count`` of the runs ``which`` in each, stored one after the other."""
        size = self.size[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(int(ends[-1]), np.int32)
        # Places are made for some runs at a time.
        for low in range(0, len(which), RUNS_AT_ONCE):
            high = min(low + RUNS_AT_ONCE, len(which))
            out[ends[low]:ends[high]] = self.flat[gathered(self.start[which[low:high]], size[low:high])]
        return Runs(out, ends[bounds[:-1]], np.diff(ends[bounds]))


class Ranks:
    """The vocabulary of a rank file: token number is rank, every byte is a token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        size = max(self.rank.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, number in self.rank.items():
            self.length[number] = len(token)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        joined = bytearray(int(self.length.sum()))
        for token, number in self.rank.items():
            joined[self.start[number]:self.start[number] + len(token)] = token
        self.bytes = np.frombuffer(bytes(joined), np.uint8)
        pairs = {
            (self.rank[token[:i]] << 32 | self.rank[token[i:]]): number
            for token, number in self.rank.items() for i in range(1, len(token))
            if token[:i] in self.rank and token[i:] in self.rank
        }
        self._table(np.fromiter(pairs, U64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _table(self, key: np.ndarray, value: np.ndarray) -> None:
        """An open hash table at most a quarter full; keys that meet move on by one cell."""
        size = 1 << max(4, (4 * len(key)).bit_length())
        self.mask = U64(size - 1)
        self.keys = np.full(size, np.iinfo(U64).max, U64)
        self.values = np.full(size, NONE, np.int32)
        at = (mix(key) & self.mask).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = self.keys[at[left]] == np.iinfo(U64).max
            put = left[free]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & (size - 1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where they make no token or a side is missing (negative)."""
        key = left.astype(U64) << U64(32) | right.astype(U64)
        at = (mix(key) & self.mask).astype(np.int64)
        out = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != np.iinfo(U64).max))
        out[self.keys[at] != key] = NONE
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != np.iinfo(U64).max)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def encode_pieces(self, pieces: Sequence[bytes]) -> Runs:
        """Token numbers of each piece on its own."""
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        owners: list[Sequence[int]] = []
        buckets: dict[int, list[int]] = {}
        single: list[int] = []
        for i, piece in enumerate(pieces):
            if piece in self.rank:
                single.append(i)
            elif len(piece) > LONGEST:
                parts.append(self._heap_merge(piece))
                sizes.append(np.array([len(parts[-1])]))
                owners.append([i])
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        parts.append(np.fromiter((self.rank[pieces[i]] for i in single), np.int32, len(single)))
        sizes.append(np.ones(len(single), np.int64))
        owners.append(single)
        for width, members in buckets.items():
            for part in grouped(members, max(1, CELLS // width)):
                done = self._matrix_merge([pieces[i] for i in part], width)
                parts.append(done[done >= 0])
                sizes.append((done >= 0).sum(axis=1))
                owners.append(part)
        flat, size = np.concatenate(parts), np.concatenate(sizes)
        back = np.argsort(np.concatenate([np.asarray(o, np.int64) for o in owners]))
        return Runs(flat, (np.cumsum(size) - size)[back], size[back])

    def _matrix_merge(self, pieces: list[bytes], width: int) -> np.ndarray:
        """One row of token numbers for each piece, -1 behind its last one."""
        size = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        token = np.where(np.arange(width) < size[:, None], self.byte[data], np.int32(-1))
        rank = self.merged(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(len(pieces), width - 1)
        done = np.full((len(pieces), width), -1, np.int32)
        row = np.arange(len(pieces))
        while len(row):
            best = rank.argmin(axis=1)
            number = rank[np.arange(len(row)), best]
            ended = number == NONE
            if ended.any():
                done[row[ended], :token.shape[1]] = token[ended]
                token, rank, row, best, number = token[~ended], rank[~ended], row[~ended], best[~ended], number[~ended]
                if not len(row):
                    break
            line = np.arange(len(row))
            token[line, best] = number
            # Compact: everything behind the pair moves up by one, the last column goes.
            columns = np.arange(token.shape[1] - 1)
            token = np.take_along_axis(token, columns + (columns > best[:, None]), axis=1)
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), axis=1)
            if token.shape[1] > 1:
                for at in (best - 1, best):
                    there = np.flatnonzero((at >= 0) & (at < token.shape[1] - 1))
                    rank[there, at[there]] = self.merged(token[there, at[there]], token[there, at[there] + 1])
            else:
                rank = np.full((len(row), 1), NONE, np.int32)
        return done

    def _heap_merge(self, piece: bytes) -> np.ndarray:
        """The same merges for a long piece: the leftmost pair of minimum rank comes from a heap of (rank, place)."""
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(token)
        text = [piece[i:i + 1] for i in range(n)]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank_at(i: int) -> int | None:
            j = after[i]
            return self.rank.get(text[i] + text[j]) if j < n else None

        heap = [(r, i, 1, 1) for i in range(n) if (r := rank_at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size, next_size = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or len(text[i]) != size or j >= n or len(text[j]) != next_size:
                continue
            token[i], text[i] = r, text[i] + text[j]
            alive[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank_at(k)) is not None:
                    heapq.heappush(heap, (r, k, len(text[k]), len(text[after[k]])))
        return np.array([t for t, a in zip(token, alive, strict=True) if a], np.int32)

    def encode_units(self, units: Sequence[str]) -> Runs:
        """Token numbers of texts that are cut by the pattern first; each distinct piece is merged once."""
        cut = [self.pattern.findall(u) for u in units]
        number: dict[str, int] = {}
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter((number.setdefault(p, len(number)) for pieces in cut for p in pieces), np.int64,
                            int(count.sum()))
        return self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in number]).joined(which, count)

    def decode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the tokens, one after the other, and how many each has."""
        size = self.length[tokens]
        return self.bytes[gathered(self.start[tokens], size)], size


def _spaced(words: pa.Array) -> pa.Array:
    """The words with a space before each."""
    space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    return pc.binary_join_element_wise(space, words, nothing)


class Known:
    """Words and their runs of token numbers, up to ``REMEMBERED`` words and ``LETTERS`` bytes, in arrays.

    Entry 0 stands for all words that aren't kept: it tells that their text must be encoded as a whole.
    """

    def __init__(self):
        self.words: list[pa.Array] = []
        self.letters = 0
        self.count = 0
        self.used = 0
        self.flat = np.empty(1 << 12, np.int32)
        self.start, self.size = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64)
        self.whole = np.empty(1 << 10, bool)
        # No word has two spaces.
        self.add(pa.array(["  "], pa.large_string()), Runs(self.flat[:0], np.zeros(1, np.int64), np.zeros(1, np.int64)), np.ones(1, bool))

    def full(self) -> bool:
        return self.count > REMEMBERED or self.letters > LETTERS

    def places(self, words: pa.Array, since: int = 0) -> np.ndarray:
        """The entry of each word, -1 where there is none among the arrays of words from number ``since`` on."""
        known = self.words[since:] or [words[:0]]
        found = pc.fill_null(pc.index_in(words, value_set=pa.chunked_array(known)), -1)
        places = found.to_numpy(zero_copy_only=False).astype(np.int64)
        places[places >= 0] += sum(map(len, self.words[:since]))
        return places

    def add(self, words: pa.Array, found: Runs, whole: np.ndarray) -> None:
        """Arrays grow by doubling, so an entry is copied a few times only."""
        first, n = self.count, len(words)
        for name, used, more in (("flat", self.used, len(found.flat)), ("start", first, n), ("size", first, n), ("whole", first, n)):
            held = getattr(self, name)
            if used + more > len(held):
                grown = np.empty(max(2 * len(held), used + more), held.dtype)
                grown[:used] = held[:used]
                setattr(self, name, grown)
        self.flat[self.used:self.used + len(found.flat)] = found.flat
        self.start[first:first + n] = self.used + found.start
        self.size[first:first + n] = found.size
        self.whole[first:first + n] = whole
        self.used += len(found.flat)
        self.count += n
        self.words.append(words)
        self.letters += pc.sum(pc.binary_length(words)).as_py() or 0

    def runs(self) -> Runs:
        return Runs(self.flat[:self.used], self.start[:self.count], self.size[:self.count])


class Units:
    """Encodes whole texts, word by word, and remembers the words.

    A cut of the pattern always lies before a single space behind a character that isn't white space, so a text is the run of its
    words with the space before each. A text where a space follows other white space (or a sign that may count as such), one with
    a word of more than ``LONGEST_WORD`` bytes, and one that holds one of the texts ``special``, is encoded as a whole.

    Words are numbered and looked up by Arrow, so only new ones become Python texts. Two generations of them are kept. When the
    younger one is full it becomes the older one, and words of that one that are met again move on, so frequent words are
    encoded once.
    """

    def __init__(self, encode: Callable[[Sequence[str]], Runs], special: Sequence[str] = ()):
        self.encode, self.special = encode, tuple(special)
        self.young, self.old = Known(), Known()

    def _special(self, words: pa.Array) -> np.ndarray:
        found = np.zeros(len(words), bool)
        for text in self.special:
            found |= pc.match_substring(words, text).to_numpy(zero_copy_only=False)
        return found

    def _take(self, words: pa.Array) -> None:
        """Put distinct words into the young generation that aren't there: from the old one, or by encoding them."""
        places = self.old.places(words)
        held = places >= 0
        if held.any():
            places = places[held]
            self.young.add(words.filter(pa.array(held)), self.old.runs().joined(places, np.ones(len(places), np.int64)),
                           self.old.whole[places])
            words = words.filter(pa.array(~held))
        if len(words):
            self._learn(words)

    def _learn(self, new: pa.Array) -> None:
        """Encode words. Marks behind a letter are a cut's run of their own, so a word's tokens are those of the word without
        them and those of the marks."""
        base = pc.utf8_rtrim(new, characters=MARKS)
        marked = pc.and_(pc.less(pc.binary_length(base), pc.binary_length(new)), pc.match_substring_regex(base, r"\pL$"))
        plain = new.filter(pc.invert(marked))
        new, base = new.filter(marked), base.filter(marked)
        halves, known = new[:0], np.empty(0, np.int64)
        if len(new):
            marks = _spaced(pc.extract_regex(new, f"(?P<m>[{re.escape(MARKS)}]+)$").field("m").cast(pa.large_string()))
            halves = pa.concat_arrays([base, marks]).unique()
            known = self.young.places(halves)
            among = pc.fill_null(pc.index_in(halves, value_set=plain), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.where(among >= 0, self.young.count + among, known)
            missing = known < 0
            known[missing] = self.young.count + len(plain) + np.arange(int(missing.sum()))
            plain = pa.concat_arrays([plain, halves.filter(pa.array(missing))])
        first = pc.starts_with(plain, " ")
        texts = pc.if_else(first, pc.utf8_slice_codeunits(plain, 1), _spaced(plain))
        whole = pc.match_substring_regex(plain, r"[\pZ\pC]$|^$").to_numpy(zero_copy_only=False) | self._special(plain)
        self.young.add(plain, self.encode(texts.to_pylist()), whole)
        if len(new):
            which = np.empty(2 * len(new), np.int64)
            for k, part in enumerate((base, marks)):
                which[k::2] = known[pc.index_in(part, value_set=halves).to_numpy(zero_copy_only=False).astype(np.int64)]
            self.young.add(new, self.young.runs().joined(which, np.full(len(new), 2)), self._special(new))

    def texts(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token numbers of all texts one after the other, how many each has)."""
        if self.young.full():
            self.young, self.old = Known(), self.young
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        given = pc.fill_null(given, "")
        lists = pc.split_pattern(given, " ")
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count) - count
        flat = lists.flatten()
        # The first word has no space before it; it is kept under a key that no other word can have.
        begins = _spaced(flat.take(pa.array(first)))
        coded = flat.dictionary_encode()
        words = pa.concat_arrays([coded.dictionary, begins])
        indices = coded.indices.to_numpy()
        del lists, flat, coded
        place = self.young.places(words)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            missed = words.take(pa.array(missing))
            before = len(self.young.words)
            self._take(missed.filter(pc.less_equal(pc.binary_length(missed), LONGEST_WORD)).unique())
            place[missing] = np.maximum(self.young.places(missed, before), 0)
        number = place[indices]
        number[first] = place[len(words) - len(given):]
        del words, indices
        runs = self.young.runs()
        whole = np.flatnonzero(np.logical_or.reduceat(self.young.whole[number], first))
        found = runs.joined(number, count)
        if len(whole):
            other = self.encode(given.take(pa.array(whole)).to_pylist())
            both = found.extended(other)
            order = np.arange(len(given))
            order[whole] = len(given) + np.arange(len(whole))
            found = both.joined(order, np.ones(len(given), np.int64))
        pa.default_memory_pool().release_unused()
        return found.flat, found.size


_ranks: dict[tuple[str, str], Ranks] = {}
_units: dict[tuple[str, str], Units] = {}


def ranks(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _ranks:
        _ranks[path, pattern] = Ranks(path, pattern)
    return _ranks[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text", name: str = "ids") -> DataFrame:
    """All columns and ``ids``, the token numbers of the whole text (array<int>; empty for NULL and empty texts).

    ``path`` is a rank file that every executor has; special tokens are ordinary text. A given column of the name is replaced.
    """
    ready(docs.sparkSession)
    own = [c for c in docs.columns if c != name]
    docs = docs.select(*own)
    at = own.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ranks(path, pattern)
        units = _units.setdefault((path, pattern), Units(held.encode_units))
        for batch in sized(batches, at):
            flat, count = units.texts(pc.cast(batch.column(at), pa.large_string()))
            ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            for low in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(low, ROWS_OUT)
                yield pa.RecordBatch.from_arrays([*part.columns, ids.slice(low, ROWS_OUT)], [*own, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """``ids`` is replaced by ``decoded``, the bytes that the token numbers stand for (binary). All other columns stay."""
    ready(rows.sparkSession)
    own = [c for c in rows.columns if c not in (name, ids_column)]
    rows = rows.select(*own, ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ranks(path, pattern)
        for batch in batches:
            lists = batch.column(len(own))
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                ids = lists.slice(low, 64)
                count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, size = held.decode(ids.flatten().to_numpy(zero_copy_only=False))
                ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
                blob = pa.Array.from_buffers(
                    pa.large_binary(), len(part),
                    [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], blob.cast(pa.binary())], [*own, name])

    fields = rows.select(*own).schema.fields
    return rows.mapInArrow(run, StructType([*fields, StructField(name, BinaryType())]))


def digest(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows; the ids are decoded for the last one."""
    slim = rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode(slim, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
