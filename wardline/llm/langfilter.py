"""Language identification by Bloom filters whose cells are bitmasks of languages.

One table of cells serves all languages: a cell holds one bit for each language, and an n-gram's languages are the AND of its
three cells. A text's n-grams are looked up together; the hits of each language, corrected for the hits that a filter as full as
that one gives by chance, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.frames import ready
from wardline.llm.text import blocks, mix

U64 = np.uint64
CELLS = 1 << 18
HASHES = 3
SIZES = (2, 3, 4)
# Texts of one language that the fit looks at, at most (those with the smallest hashes of their ids), and the n-grams kept for
# each language, at most (the most frequent ones): the size of the model, a parameter of ``fit``.
SAMPLE = 3000
GRAMS = 15_000
# Parts in which the rows of a language are ranked first.
SPREAD = 32
# A language has an n-gram if its share there is at least this part of the largest share that any language has.
FAIR = 0.2
PARTS = 4
UNKNOWN = "und"

# Letters in lower case; everything else in ASCII is a gap. The second byte of a two-byte capital (Latin-1) is lowered too.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    # One row of cells for each 64 languages.
    cells: np.ndarray
    chance: np.ndarray
    usual: str


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all n-grams of bytes that have no gap inside and aren't all gap."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" " + b"  ".join(blobs) + b" ", np.uint8)
    data = _FOLD[raw]
    capital = np.zeros(len(raw), bool)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    data = data + 32 * capital.astype(np.uint8)
    sizes = np.fromiter((len(b) + 2 for b in blobs), np.int64, len(blobs))
    doc = np.repeat(np.arange(len(blobs)), sizes)
    gap = data == 32
    wide = data.astype(U64)
    found, of = [], []
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, U64)
        inside = np.ones(n, bool)
        for j in range(size):
            value = (value << U64(8)) | wide[j:j + n]
            if 0 < j < size - 1:
                inside &= ~gap[j:j + n]
        inside &= ~(gap[:n] & gap[size - 1:]) if size == 2 else True
        found.append(mix(value[inside]))
        of.append(doc[:n][inside])
    return np.concatenate(found), np.concatenate(of)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _first(rows: DataFrame, order: list[Column], spread: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each language. They are ranked in parts first, so that a language is not one task's, and what is
    left of all parts is bounded."""
    for keys in (("lang", "__part"), ("lang",)):
        ranked = rows if "__part" in rows.columns else rows.withColumn("__part", F.pmod(spread, F.lit(SPREAD)))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = ranked.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")
    return rows.drop("__part")


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE, most: int = GRAMS, id_column: str = "doc_id",
        text_column: str = "text", lang_column: str = "lang") -> Filters:
    """Filters from at most ``sample`` texts of each language of the ``usable`` rows (a condition on the id)."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.filter(usable & F.col(lang_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(lang_column).alias("lang"))
    chosen = _first(rows, [F.xxhash64("id"), F.col("id")], F.xxhash64("id", F.lit(7)), sample).select("id", "lang").distinct()
    texts = (
        docs.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"),
                    F.col(text_column).cast("string").alias("text"))
        .join(F.broadcast(chosen), ["id", "lang"])
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(PARTS)))
    )

    def count(group: pd.DataFrame) -> pd.DataFrame:
        listed = group["text"].tolist()
        value, times = [], []
        for low, high in blocks(listed):
            v, c = np.unique(grams(listed[low:high])[0], return_counts=True)
            value.append(v)
            times.append(c)
        gram, at = np.unique(np.concatenate(value), return_inverse=True)
        n = np.bincount(at, np.concatenate(times), minlength=len(gram)).astype(np.int64)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "gram": gram.view(np.int64), "n": n})

    counted = texts.groupBy("lang", "part").applyInPandas(count, "lang string, gram long, n long")
    # An n-gram seen once, in all parts together, tells nothing.
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1")
    # Not more than ``most`` n-grams of each language, and one total.
    held = _first(sums, [F.desc("n"), F.col("gram")], F.col("gram"), most).select("lang", "gram", "n").toPandas()
    totals = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = tuple(sorted(totals))
    every, at = np.unique(held["gram"].to_numpy(np.int64), return_inverse=True)
    lang = held["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64)
    share = held["n"].to_numpy(float) / np.maximum(np.bincount(lang, held["n"], minlength=len(names)), 1)[lang]
    most_shared = np.zeros(len(every))
    np.maximum.at(most_shared, at, share)
    belongs = share >= FAIR * most_shared[at]
    cells = np.zeros((max(1, -(-len(names) // 64)), CELLS), U64)
    chance = np.zeros(len(names))
    for i, _ in enumerate(names):
        for cell in places(every[at[belongs & (lang == i)]].view(U64)):
            cells[i // 64, cell] |= U64(1 << i % 64)
        chance[i] = float(((cells[i // 64] >> U64(i % 64)) & U64(1)).mean()) ** HASHES
    usual = max(names, key=lambda n: (totals[n], n)) if names else UNKNOWN
    return Filters(names, cells, chance, usual)


def places(value: np.ndarray) -> list[np.ndarray]:
    return [(mix(value + U64(j * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) % U64(CELLS)).astype(np.int64)
            for j in range(HASHES)]


def shares(texts: list[str | None], filters: Filters) -> np.ndarray:
    """For each text and language the share of its n-grams that the language has, without the hits by chance."""
    value, doc = grams(texts)
    count = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    at = places(value)
    out = np.zeros((len(texts), len(filters.languages)))
    for word in range(len(filters.cells)):
        mask = filters.cells[word][at[0]]
        for j in range(1, HASHES):
            mask &= filters.cells[word][at[j]]
        for i in range(64 * word, min(64 * word + 64, len(filters.languages))):
            hits = np.bincount(doc, ((mask >> U64(i % 64)) & U64(1)).astype(np.float64), minlength=len(texts))
            out[:, i] = np.clip((hits / count - filters.chance[i]) / max(1 - filters.chance[i], 1e-9), 0, 1)
    return out


def identify(docs: DataFrame, filters: Filters, text_column: str = "text") -> DataFrame:
    """All columns, ``lang_pred`` and ``score`` (the language's part of all languages' shares; new columns replace given ones).

    ``und`` with score 0 if the text is NULL or has no letter, or nothing was learned. A text whose n-grams no language has is
    given the language with most learned texts, with score 0. Ties go to the first language by name.
    """
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def decide(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = held.value
        for part in parts:
            texts = part.tolist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for low, high in blocks(texts, 1 << 20):
                if not known.languages:
                    break
                found = shares(texts[low:high], known)
                best, total = found.argmax(axis=1), found.sum(axis=1)
                for i in range(high - low):
                    if has_letter(texts[low + i]):
                        names[low + i] = known.languages[best[i]] if total[i] else known.usual
                        scores[low + i] = found[i, best[i]] / total[i] if total[i] else 0.0
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("__found", decide(F.col(text_column).cast("string"))).select(
        *own, F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))
