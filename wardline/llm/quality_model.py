"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text: its words, pairs of words (all pairs of a word with itself are one more feature), and runs of one to three
word shapes (letters, capitals, digits and marks, runs of the same kind once), hashed into a fixed number of weights; each
occurrence counts, divided by the root of their number. The model is fitted on a bounded sample of labelled rows (a parameter), by
learners on parts of it side by side, whose weights are averaged. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.frames import ready
from wardline.llm.text import SPACE, Words, blocks, hash_runs, mix

U64 = np.uint64
WEIGHTS = 1 << 18
# Labelled rows that the fit looks at, at most: those with the smallest hashes of their ids.
SAMPLE = 16_384
# Rows of one learner, about.
LEARNER = 2048
PASSES = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.001
RULE = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight number, text number) of every feature occurrence, ordered by text, and their number for each text."""
    words = Words(texts, lower=False)
    shape = _SHAPE[words.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | SPACE[shape[1:]]
    place = np.concatenate(([0], np.cumsum(keep)))
    shapes = hash_runs(shape[keep], place[words.start], place[words.end])
    doc = words.doc
    found, of = [mix(words.hash ^ U64(1)), mix(shapes ^ U64(2))], [doc, doc]

    def runs(h: np.ndarray, width: int, kind: int) -> None:
        if len(h) < width:
            return
        n = len(h) - width + 1
        value = np.full(n, kind, U64)
        for j in range(width):
            value = mix(value * U64(0x9E3779B97F4A7C15) + h[j:j + n])
        inside = doc[:n] == doc[width - 1:]
        found.append(value[inside])
        of.append(doc[:n][inside])

    runs(words.hash, 2, 3)
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1]))
    found.append(np.full(len(again), mix(np.full(1, 6, U64))[0], U64))
    of.append(doc[again])
    runs(shapes, 2, 4)
    runs(shapes, 3, 5)
    number, owner = np.concatenate(found), np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    number, owner = (number[order] % U64(WEIGHTS)).astype(np.int64), owner[order]
    return number, owner, np.bincount(owner, minlength=len(texts))


def train(texts: list[str | None], labels: list[int], passes: int = PASSES) -> Model:
    """FTRL-proximal, one text at a time."""
    z, n = np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for low, high in blocks(texts):
        number, _, count = features(texts[low:high])
        for part in np.split(number, np.cumsum(count)[:-1]):
            at, times = np.unique(part, return_counts=True)
            scale = 1 / np.sqrt(max(1, len(part)))
            held.append((np.append(at, WEIGHTS).astype(np.int32), np.append(times * scale, 1.0).astype(np.float32)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(held)):
            at, x = held[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, learner: int = LEARNER,
        id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Fit on at most ``sample`` rows of ``labels`` that are ``usable`` (a condition on the id) and have a label.

    Several labels of one id: the lowest counts; several texts: the least one. Without any labelled row all weights are 0 and every score is 0.5.
    """
    spark = docs.sparkSession
    ready(spark)
    chosen = (
        labels.filter(usable & F.col(label_column).isNotNull())
        .groupBy(F.col(id_column).alias("id")).agg(F.min(label_column).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    learners = max(1, -(-chosen.count() // learner))
    rows = (
        docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
        .withColumn("learner", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(learners)))
    )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        model = train(group["text"].tolist(), group["label"].tolist())
        return pd.DataFrame({"rows": [len(group)], "bias": [model.bias], "weights": [model.weights.tobytes()]})

    # One row of fixed size for each learner.
    found = rows.groupBy("learner").applyInPandas(learn, "rows long, bias double, weights binary").collect()
    total = sum(r["rows"] for r in found)
    mean = np.zeros(WEIGHTS)
    for r in found:
        mean += np.frombuffer(r["weights"]) * (r["rows"] / total)
    return Model(mean, sum(r["bias"] * r["rows"] for r in found) / total if total else 0.0)


def score(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """All columns and ``score``: the probability of label 1, from the text alone; NULL and empty texts have the bias only."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float64), model.bias))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = held.value
        for part in parts:
            texts, out = part.tolist(), np.empty(len(part))
            for low, high in blocks(texts):
                number, owner, count = features(texts[low:high])
                dot = np.bincount(owner, weights[number], minlength=high - low) / np.sqrt(np.maximum(count, 1))
                out[low:high] = 1 / (1 + np.exp(-np.clip(dot + bias, -35, 35)))
            yield pd.Series(out)

    return docs.withColumn(name, scored(F.col(text_column).cast("string")))


def fold(id_column: str, parts: int) -> Column:
    """The remainder of the crc32 of the id as text."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts
