import random

import numpy as np
import pytest
from conftest import rows
from llm.cases import EDGES, brute_components, shingles

from wardline.llm import setsketch
from wardline.llm.text import Words, jaccard_counts

KIND = "doc_id long, text string"


def variants(seed, groups=6, copies=25, words=60):
    """Copies with more and less edits, so that similarities lie on both sides of the threshold."""
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice((0, 1, 2, 3, 5, 9, 14))):
                text[r.randrange(len(text))] = f"x{r.randint(0, 10**6)}"
            out.append(" ".join(text))
    return list(enumerate(out))


@pytest.mark.parametrize("width", [2, 5])
def test_shingles_are_the_distinct_runs_of_words(width):
    texts = [t for _, t, *_ in EDGES] + ["a a a a a a", "A b a B a b", "x"]
    value, doc = Words(texts).shingles(width)
    sizes = np.bincount(doc, minlength=len(texts))
    assert sizes.tolist() == [len(shingles(t, width)) for t in texts]
    assert jaccard_counts("a b c", "A b d", 2) == (1, 3)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:2500], r.integers(0, 2**63, 400).astype(np.uint64))))
    both = np.unique(np.concatenate((a, b)))
    ra, rb, rboth = (setsketch.registers(x, np.zeros(len(x), np.int64), 1)[0] for x in (a, b, both))
    assert (setsketch.merge(ra, rb) == rboth).all()
    true = len(np.intersect1d(a, b)) / len(both)
    seems = setsketch.likeliest(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(seems - true) < 5 * (true * (1 - true) / setsketch.REGISTERS) ** 0.5


@pytest.mark.parametrize(("width", "seed"), [(2, 1), (5, 2)])
def test_same_components_as_all_pairs(spark, width, seed):
    given = variants(seed)
    found = setsketch.near_duplicates(spark.createDataFrame(given, KIND), width=width)
    want = brute_components(given, width, 80)
    assert rows(found) == sorted(((i, n, c, i == c) for i, (n, c) in want.items()), key=repr)


def test_blocks_of_the_last_step_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 7)
    given = variants(3, groups=2, copies=60, words=40)
    found = setsketch.near_duplicates(spark.createDataFrame(given, KIND), width=2)
    want = brute_components(given, 2, 80)
    assert rows(found) == sorted(((i, n, c, i == c) for i, (n, c) in want.items()), key=repr)


def test_edges(spark, clashing):
    found = rows(setsketch.near_duplicates(clashing, width=2))
    assert len(found) == len(EDGES)
    by_id = {r[0]: r for r in found if r[0] is not None}
    assert by_id[1] == (1, 0, 1, True) and by_id[2] == (2, 0, 2, True) and by_id[3] == (3, 0, 3, True)
    assert by_id[5] == (5, 1, 4, False) and by_id[4] == (4, 1, 4, True)
    nulls = [r for r in found if r[0] is None]
    assert sorted(nulls, key=repr) == [(None, 0, None, True), (None, 1, 6, False)]


def test_empty_table(spark, edges):
    assert setsketch.near_duplicates(edges.limit(0)).collect() == []
    assert setsketch.deduplicate(edges.limit(0)).collect() == []


def test_deduplicate_keeps_one_of_each_component(spark, clashing):
    given = variants(5, groups=3)
    frame = spark.createDataFrame([(i, t, "s") for i, t in given], KIND + ", kept string")
    want = brute_components(given, 5, 80)
    assert rows(setsketch.deduplicate(frame), "doc_id") == sorted(((i,) for i, (_, c) in want.items() if i == c), key=repr)
    left = setsketch.deduplicate(clashing, width=2)
    assert left.columns == clashing.columns
    ids = [r[0] for r in left.collect()]
    # Of the rows without an id, the one whose words no other row has stays.
    assert sorted(ids, key=repr) == sorted([1, 2, 3, 4, 6, 8, 9, 10, None], key=repr)
