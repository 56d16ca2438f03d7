"""Token counts without tokens: pieces are counted once for each distinct pre-token of the corpus.

1. The pre-tokens of all texts are summed to one table, each with the times it occurs.
2. The tokenizer's model cuts each pre-token of that table once; only the number of pieces stays.
3. The frequencies of pre-tokens of each document are joined with the table, and times x pieces added up.

The join has two sides. The most frequent pre-tokens, a table of at most ``HEAD`` rows, are broadcast and joined where the
frequencies are made; what is left are frequencies of rare pre-tokens, which are written and joined by a shuffle. So no key of the shuffle
is frequent, and little is moved, but every pre-token counts.

Texts of letters below U+0300 are cut by the pattern of the tokenizer's file, in ``re`` with explicit classes. White space never is
part of a pre-token, so other texts are split at blanks first, and words with other letters are normalised and cut by
the tokenizers library. A word that holds a special token is a pre-token as a whole, counted by the whole tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardline.llm.frames import ready, written

# Pre-tokens that are broadcast at most, each a key of at most LONGEST letters.
HEAD = 1 << 18
LONGEST = 64
# Distinct pre-tokens, or words with their pre-tokens, that a task holds, and their characters.
HELD, LETTERS = 400_000, 8 << 20
# First letters of keys that no pre-token begins with.
WHOLE, DIGEST = " ", "\t"
# Letters from here on may be changed by normalisation, or be classified differently by another version of Unicode.
FIRST_ODD = 0x300


def _fast_pattern(pattern: str) -> re.Pattern:
    """A pattern of literals, runs of letters, single numbers and runs of other signs, with the classes spelled out for what
    lower-case texts of letters below ``FIRST_ODD`` hold."""
    held = sorted({x for c in range(FIRST_ODD) for x in chr(c).lower()})

    def among(name: str) -> str:
        return "".join(re.escape(x) for x in held if regex.match(name, x))

    letters, numbers, spaces = among(r"\p{L}"), among(r"\p{N}"), among(r"\s")
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(
        r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
    if "\\p" in spelled:
        raise ValueError(f"pattern of another form: {pattern}")
    return re.compile(spelled)


class Cutter:
    """Cuts texts into pre-tokens, and counts the pieces of one, for a tokenizer file that lowers letters, drops white space and
    has byte letters (a ValueError for others)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        given = json.loads(self.library.to_str())
        steps = [n["type"] for n in (given["normalizer"] or {}).get("normalizers", [])]
        cuts = (given["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or (
                cuts[0]["behavior"], cuts[0]["invert"], cuts[1]["use_regex"]) != ("Removed", True, False):
            raise ValueError(f"{path} is a tokenizer of another kind")
        pattern = cuts[0]["pattern"]["Regex"]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cut = _fast_pattern(pattern).findall
        self.odd = re.compile(f"[{chr(FIRST_ODD)}-\U0010ffff]").search
        self.words: dict[str, list[str]] = {}
        self.letters = 0

    def pretokens(self, text: str | None) -> list[str]:
        if not text:
            return []
        special = any(s in text for s in self.special)
        if not special and not self.odd(text):
            return self.cut(text.lower())
        plain: list[str] = []
        found: list[str] = []
        for word in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if special and any(s in word for s in self.special):
                found.append(WHOLE + word)
            elif self.odd(word):
                found += self._odd_word(word)
            else:
                plain.append(word)
        return found + self.cut(" ".join(plain).lower())

    def _odd_word(self, word: str) -> list[str]:
        found = self.words.get(word)
        if found is None:
            found = [p for p, _ in self.split.pre_tokenize_str(self.library.normalizer.normalize_str(word))]
            if len(word) <= 4 * LONGEST:
                if len(self.words) >= HELD or self.letters > LETTERS:
                    self.words, self.letters = {}, 0
                self.words[word] = found
                self.letters += len(word)
        return found

    def pieces(self, pretoken: str) -> int:
        if pretoken[:1] == WHOLE:
            return len(self.library.encode(pretoken[1:], add_special_tokens=False).ids)
        return sum(len(self.library.model.tokenize(p)) for p, _ in self.byte_level.pre_tokenize_str(pretoken))


_cutters: dict[str, Cutter] = {}


def cutter(path: str) -> Cutter:
    if path not in _cutters:
        _cutters[path] = Cutter(path)
    return _cutters[path]


def key_of(pretoken: str) -> str:
    """The pre-token, or a digest of a long one."""
    if len(pretoken) <= LONGEST:
        return pretoken
    return DIGEST + hashlib.blake2b(pretoken.encode("utf-8", "surrogatepass"), digest_size=24).hexdigest()


def _texts(batch: pa.RecordBatch, at: int) -> list[str | None]:
    return pc.cast(batch.column(at), pa.string()).to_pylist()


def vocabulary(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """key, pretoken, times, pieces: one row for each distinct pre-token of all texts."""
    ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(path)
        found: Counter[str] = Counter()

        def summed() -> Iterator[pa.RecordBatch]:
            names = list(found)
            for low in range(0, len(names), 8192):
                part = names[low:low + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(key_of, part), pa.string()),
                     pa.array((p if len(p) > LONGEST else None for p in part), pa.string()),
                     pa.array([found[p] for p in part], pa.int64())], ["key", "long", "times"])
            found.clear()

        letters = 0  # of long pre-tokens: the others are bounded by their number
        for batch in batches:
            for text in _texts(batch, 0):
                before = len(found)
                found.update(cut.pretokens(text))
                letters += len(text or "") if len(text or "") > LONGEST * max(1, len(found) - before) else 0
                if len(found) > HELD or letters > LETTERS:
                    yield from summed()
                    letters = 0
        yield from summed()

    def cut_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(path)
        for batch in batches:
            pieces = pa.array([cut.pieces(p) for p in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["key", "pretoken", "times", "pieces"])

    found = docs.select(F.col(text_column).cast("string")).mapInArrow(count, "key string, long string, times long")
    table = found.groupBy("key").agg(
        F.coalesce(F.min("long"), F.col("key")).alias("pretoken"), F.sum("times").alias("times"))
    return written(
        table.mapInArrow(cut_once, "key string, pretoken string, times long, pieces long"), "pretokens")


def head_of(table: DataFrame, most: int = HEAD) -> dict[str, int]:
    """Key -> pieces of the most frequent pre-tokens, ``most`` at most. How many times make one frequent comes from a
    histogram of some hundred steps, so the driver sees no more than these rows."""
    if most < 1:
        return {}
    step = F.floor(F.log2(F.col("times")) * 16).cast("int")
    short = table.filter(F.length("key") <= LONGEST).withColumn("step", step)
    seen, least = 0, None
    for row in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        seen += row["count"]
        if seen > most:
            break
        least = row["step"]
    if least is None:
        return {}
    return {r["key"]: r["pieces"] for r in short.filter(F.col("step") >= least).select("key", "pieces").collect()}


def count_tokens(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text_column: str = "text",
                 head: int = HEAD) -> DataFrame:
    """One row for each document: the columns ``keep``, n_bytes (of the text in UTF-8) and n_tokens.

    n_tokens is what the library's ``encode(text, add_special_tokens=False)`` returns ids; ``path`` is a tokenizer file that every
    executor has. A NULL text is an empty one and has none. Rows with equal or missing ids stay rows of their own. An empty table
    gives an empty one. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    table = vocabulary(docs, path, text_column)
    known = spark.sparkContext.broadcast(head_of(table, head))

    own = [f"__keep{i}" for i in range(len(keep))]
    text = F.col(text_column).cast("string")
    slim = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, own, strict=True)),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("__text"))
    fields = slim.drop("__text").schema.fields

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = cutter(path), known.value.get
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            totals, rare = [], []
            for text in _texts(batch, len(fields)):
                total, rest = 0, []
                for pretoken, times in Counter(cut.pretokens(text)).items():
                    n = pieces(pretoken)
                    if n is None:
                        rest.append((key_of(pretoken), times))
                    else:
                        total += n * times
                totals.append(total)
                rare.append(rest)
            rows = range(row, row + len(totals))
            row += len(totals)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array(rare, pa.map_(pa.string(), pa.int64()))], [*(f.name for f in fields), "__row", "__known", "__rare"])

    counted = written(slim.mapInArrow(frequencies, StructType([
        *fields, *StructType.fromDDL("__row long, __known long, __rare map<string,bigint>").fields])), "pretoken-frequencies")
    rest = (
        counted.select("__row", F.explode("__rare").alias("key", "__times"))
        .join(table.select("key", "pieces"), "key")
        .groupBy("__row").agg(F.sum(F.col("__times") * F.col("pieces")).alias("__more"))
    )
    return counted.drop("__rare").join(rest, "__row", "left").select(
        *(F.col(n).alias(c) for c, n in zip(keep, own, strict=True)), "n_bytes",
        (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_tokens"))
