"""Running values, picks and similar columns against brute force."""

import random
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from wardline.operators import joins, monitor

def test_running_last_against_brute_force(spark):
    rng = random.Random(7)
    events = [(f"{i:04d}", rng.choice("ab"), f"2024-01-0{rng.randint(1, 3)} {rng.randint(0, 23):02d}:{rng.choice(['00', '30'])}:00",
               rng.choice([None, None, "x", "y", "z"])) for i in range(300)]
    df = spark.createDataFrame(events, "i string, k string, t string, v string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    expected = []
    for i, k, t, _ in events:
        before = sorted((u, j, w) for j, m, u, w in events if m == k and (u, j) < (t, i) and w is not None)
        expected.append((i, before[-1][2] if before else None))
    found = joins.running_last(df, "k", "t", "i", F.col("v"), "before")
    assert rows(found, "i", "before") == sorted(expected, key=repr)


def test_running_last_with_a_hot_second_and_missing_keys(spark):
    """A third of the rows in one second of one key, in all orders of time and tie; NULL keys and times."""
    rng = random.Random(8)
    base = datetime(2024, 1, 1, 5, 0, 0)
    events = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else rng.choice(["a", None])
        when = base + timedelta(microseconds=rng.randint(0, 5)) if key == "hot" else rng.choice(
            [None, base, base + timedelta(hours=rng.randint(0, 3), seconds=rng.randint(0, 2))])
        events.append((f"{rng.randint(0, 10**9):09d}-{i}", key, when, rng.choice([None, "x", "y"])))
    df = spark.createDataFrame(events, "i string, k string, t timestamp_ntz, v string")

    def place(event):
        return (event[2] is not None, event[2] or base, event[0])

    expected = []
    for event in events:
        before = sorted((o for o in events if o[1] == event[1] and place(o) < place(event) and o[3] is not None), key=place)
        expected.append((event[0], before[-1][3] if before else None))
    assert rows(joins.running_last(df, "k", "t", "i", F.col("v"), "before"), "i", "before") == sorted(expected, key=repr)


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    top = joins.top_per_key(df, ["k"], [F.desc("v")], 2)
    assert rows(top) == [(0, 996), (0, 998), (1, 997), (1, 999)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan.split("Exchange")[-1]
    assert "WindowGroupLimit" in before_shuffle


def test_no_plan_depends_on_sizes(derived):
    """One plan for all sizes. The log is read for the rows and for each of the three summaries."""
    for df, scans in ((derived.queue, 2), (derived.audit, 6)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= scans


def test_similar_columns_against_brute_force(spark):
    rng = random.Random(3)
    listed = [(i, "s", f"t{rng.randint(0, 9)}", rng.choice(["id", "id", "id", "name", "zip"]), rng.choice(["a", "b", "c"]),
               rng.random() < 0.6) for i in range(120)]
    df = spark.createDataFrame(listed, "i int, schema_name string, table_name string, column_name string, tag string, known boolean")
    found = {r.i: r for r in monitor.similar_columns(df, df.filter("known")).collect()}
    for i, _, table, name, _, _ in listed:
        same = [r for r in listed if r[5] and r[3] == name]
        others = [r for r in same if r[2] != table]
        assert found[i].n_similar == len(others)
        assert [s.path for s in found[i].similar] == sorted({f"s.{r[2]}" for r in others})[:3]
        counts = {t: sum(r[4] == t for r in same) for t in "abc"}
        common = max((n, t) for t, n in counts.items())[1]
        assert found[i].common_tag == (common if others else None)


def test_near_names_against_brute_force(spark):
    def distance(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            before = row
        return before[-1]

    rng = random.Random(5)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"ssn", "SSN", "sn", "ssnn"}
    df = spark.createDataFrame([(n,) for n in names for _ in range(2)] + [("",), (None,)], "column_name string")
    low = {n.lower() for n in names}
    expected = sorted((a, b) for a in low for b in low if distance(a, b) == 1)
    assert rows(monitor.near_names(df)) == expected
