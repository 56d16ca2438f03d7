import random

import numpy as np
from conftest import SF, rows
from llm.cases import EDGES

from wardline.llm import contamination
from wardline.llm.queries import op9_cgk_decontamination


def brute_distance(left, right):
    """Edit distance of left to the nearest run of words anywhere in right."""
    row = [0] * (len(right) + 1)
    for i, word in enumerate(left, 1):
        new = [i]
        for j, other in enumerate(right, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (word != other)))
        row = new
    return min(row)


def brute(docs, items):
    out = set()
    for item, text in items:
        (left,) = contamination.item_words([text])
        if len(left) < contamination.LEAST_WORDS:
            continue
        for doc, body in docs:
            (right,) = contamination.item_words([body])
            d = brute_distance(left.tolist(), right.tolist())
            if d <= contamination.edits(len(left)):
                out.add((doc, item, d))
    return out


def planted(seed, items=20, docs=250):
    """Documents with items in them, some as they are, some with edits up to and beyond the limit."""
    r = random.Random(seed)

    def prose(n):
        return [f"w{int(r.paretovariate(0.4)) % 5000}" for _ in range(n)]

    bench = [prose(r.randint(12, 50)) for _ in range(items)]
    out = []
    for _ in range(docs):
        words = prose(r.randint(0, 120))
        if r.random() < 0.6:
            passage = list(r.choice(bench))
            for _ in range(r.randint(0, len(passage) // 4)):
                at = r.randrange(len(passage))
                kind = r.randrange(3)
                if kind == 0:
                    passage[at] = "edited"
                elif kind == 1:
                    passage.insert(at, "more")
                elif len(passage) > 1:
                    del passage[at]
            at = r.randint(0, len(words))
            words[at:at] = passage
        out.append(" ".join(words))
    return list(enumerate(out)), list(enumerate(" ".join(b) for b in bench))


def test_recall_and_distances_against_all_pairs(spark):
    docs, items = planted(1)
    want = brute(docs, items)
    found = set(rows(contamination.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")),
        "doc_id", "item_id", "distance"))
    assert len(want) > 60
    pairs, all_pairs = {f[:2] for f in found}, {w[:2] for w in want}
    assert pairs <= all_pairs and len(pairs) >= 0.97 * len(all_pairs)
    assert {f[:2] for f in found if f[2] == 0} == {w[:2] for w in want if w[2] == 0}


def test_exact_passages_in_the_table(spark):
    found = {r[:2] for r in rows(op9_cgk_decontamination(spark, SF), "doc_id", "item_id")}
    docs = rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    items = rows(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    exact = {(d, i) for d, t in docs for i, b in items if b in (t or "")}
    assert exact and exact <= found


def test_blocks_of_items_and_case(spark):
    docs, items = planted(2, items=15, docs=60)
    left = spark.createDataFrame([(i, t.upper().replace(" ", ",\n")) for i, t in docs], "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    columns = "doc_id", "item_id", "distance"
    one = rows(contamination.matches(left, right), *columns)
    more = rows(contamination.matches(left, right, items=4), *columns)
    exact = [r for r in one if r[2] == 0]
    assert exact and exact == [r for r in more if r[2] == 0]


def test_edges(spark, clashing):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "one"), (None, "A b c, d e f g h i j!"), (5, "a b c d e f g h i j"), (6, "x y z q r s t")],
        "item_id long, text string")
    found = rows(contamination.matches(clashing, items), "doc_id", "item_id", "distance", "first_word")
    assert found == sorted([(8, 5, 0, 0)] * 2 + [(8, None, 0, 0)] * 2 + [(i, 3, 0, 0) for i in (4, 5, 6, None)], key=repr)
    # An item of one word is found, but takes no document out.
    kept = contamination.decontaminate(clashing, items)
    assert kept.columns == clashing.columns and kept.count() == len(EDGES) - 2
    assert contamination.matches(clashing.limit(0), items).collect() == []
    assert contamination.matches(clashing, items.limit(0)).collect() == []
    assert contamination.decontaminate(clashing, items.limit(0)).count() == len(EDGES)
    assert contamination.decontaminate(clashing, items, shortest=1).count() == len(EDGES) - 6
    named = items.selectExpr("concat('i', item_id) AS item_id", "text")
    assert set(rows(contamination.matches(clashing, named), "item_id")) == {("i5",), ("i3",), (None,)}


def test_walks_meet_again_after_an_edit():
    r = np.random.default_rng(5)
    a = r.integers(1, 2**62, (200, 60)).astype(np.uint64)
    b = a.copy()
    b[:, 20] += np.uint64(1)
    same = (contamination.walk(a, 3, 60) == contamination.walk(b, 3, 60)).mean()
    other = (contamination.walk(a, 3, 60) == contamination.walk(np.roll(a, 1, axis=0), 3, 60)).mean()
    assert same > 0.6 and other < 0.01


def test_short_items_and_scripts_without_spaces():
    items = ["Paris, France", "a red fox ran", "水を飲む前に、必ず手を洗ってください。", "ดื่มน้ำก่อนอาหาร", "one", "el niño corrió — muy rápido"]
    docs = ["We saw Paris (France) and Paris, France.", "a red dog ran, a red fox sat", "昨日、水を飲む前に必ず手を洗ってくださいと言われた。",
            "水を飲む前に、必ず手を拭いてください。", "เขาดื่มน้ำก่อนอาหารทุกวัน", "one", "«El niño corrió muy rápido»", "Paris", "France in Paris",
            "今日は天気がいいから散歩しましょう", "A RED FOX ran", None]
    held = contamination.index(list(range(len(items))), items)
    found = [(d, held.ids[i], first, n) for d, i, first, n in contamination.search(docs, held)]
    assert [f for f in found if f[3] == 0] == [(0, 0, 2, 0), (2, 2, 2, 0), (4, 3, 3, 0), (5, 4, 0, 0), (6, 5, 0, 0), (10, 1, 0, 0)]
    assert [f[:2] for f in found if f[3]] == [(3, 2)]


def test_recall_that_is_missed_is_an_error(monkeypatch):
    import pytest

    words = np.random.default_rng(1).integers(1, 1 << 62, 400).astype(np.uint64)
    monkeypatch.setattr(contamination, "MOST_TABLES", 3)
    with pytest.raises(RuntimeError):
        contamination.tables_needed([words], 480, 0.99)
