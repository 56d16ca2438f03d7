"""Rules by index, similar names, bottom-k samples and validated values, against brute force."""

import random
import re
import time
from datetime import date

from conftest import rows
from pyspark.sql import functions as F

from wardline.functions import validators
from wardline.operators import classify, monitor, protect


def test_rule_index_against_brute_force(spark):
    r = random.Random(7)
    names = ["".join(r.choice("ab_1é") for _ in range(r.randint(0, 9))) for _ in range(300)] + [None, "same", "same", "same"]
    rules = [(r.randint(0, 60), ["".join(r.choice("ab_1é") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 3))] + [None],
              f"t{i}") for i in range(90)]
    for extra in ([], [(30, [""], "every")]):
        listed = rules + extra
        frame = spark.createDataFrame(listed, "rule_order int, keywords array<string>, tag string")
        frame = frame.select("*", *(F.lit("x").alias(n) for n in ("category", "priority", "native_class", "explanation")),
                             F.lit(0.5).alias("confidence"))
        items = spark.createDataFrame(list(enumerate(names)), "i int, column_name string").withColumn("c_key", F.col("column_name"))
        found = classify.classify_by_table(items, frame)
        want = []
        for i, name in enumerate(names):
            hits = [(o, t) for o, words, t in listed for w in words if name is not None and w is not None and w in name]
            want.append((i, *min(hits, default=(None, None))))
        assert rows(found, "i", "rule_number", "rule_tag") == sorted(want, key=repr)
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_similar_names_against_brute_force(spark, derived):
    r = random.Random(8)
    words = ["id", "id", "id", "customer", "name", "first", "last", "12", "3", "date", "Ä"]
    names = {"_".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(250)} | {"", "__", "CUSTOMER-ID", "id.customer"}
    names |= {n for (n,) in rows(derived.inventory, "column_name")[:300]}

    def tokens(name):
        return set(re.findall(r"[^\W\d_]+|\d+", name.lower()))

    for percent in (60, 80, 100, 1):
        low = sorted({n.lower() for n in names})
        sets = {n: tokens(n) for n in low}
        want = []
        for i, a in enumerate(low):
            for b in low[i + 1:]:
                both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if both and 100 * both >= percent * every:
                    want.append((a, b, round(both / every, 6)))
        frame = spark.createDataFrame([(n,) for n in names] * 2, "column_name string")
        assert rows(monitor.similar_names(frame, percent=percent), "name", "near_name", "similarity") == sorted(want, key=repr)


def test_similar_names_meet_in_no_hot_block(spark):
    """A token that all names share is in no prefix, so it is no meeting place."""
    frame = spark.range(3000).select(F.concat(F.lit("common_"), "id", F.lit("_x"), F.col("id") * 7919).alias("column_name"))
    assert monitor.similar_names(frame).count() == 0
    plan = monitor.similar_names(frame)
    met = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in met


def test_samples_are_the_smallest_hashes(spark, derived):
    people = derived.people
    found = rows(protect.masked_samples(people, {"ssn": "None", "email": "None", "c_mktsegment": "None"}, k=4))
    want = []
    for name in ("ssn", "email", "c_mktsegment"):
        values = sorted({(r[1], r[0]) for r in people.select(name, F.md5(name)).distinct().collect()})
        want += [(name, i, v) for i, (_, v) in enumerate(values[:4], 1)]
    assert found == sorted(want, key=repr)


def test_samples_of_hundred_columns_in_one_scan(spark):
    names = [f"c{i}" for i in range(100)]
    wide = spark.range(500).repartition(7).select(*(
        F.when(F.col("id") % 5 > 0, (F.col("id") * i % 101).cast("string")).alias(n) for i, n in enumerate(names)))
    begun = time.perf_counter()
    found = protect.masked_samples(wide, {n: "None" for n in names}, k=3)
    found._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - begun < 2
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 500") == 1
    counted = {r[0]: r[1] for r in found.groupBy("column_name").count().collect()}
    assert counted == {"c0": 1} | {n: 3 for n in names[1:]}


def test_samples_of_hot_empty_and_missing_values(spark):
    frame = spark.createDataFrame([("x", None)] * 5000 + [("", None), (None, None), ("y", None)], "a string, b string")
    assert rows(protect.masked_samples(frame.repartition(3), {"a": "None", "b": "None"}), "column_name", "masked_value") == [
        ("a", "x"), ("a", "y")]
    assert protect.masked_samples(frame.limit(0), {"a": "None"}).collect() == []


def checked(spark, name, values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in frame.select(validators.BY_PATTERN[name](F.col("v"))).collect()]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def real_day(text):
    try:
        date.fromisoformat(text)
        return True
    except ValueError:
        return False


def test_validators_against_plain_ones(spark):
    r = random.Random(9)
    cards = ["".join(r.choice("0123456789") for _ in range(r.randint(13, 16))) for _ in range(300)]
    cards += ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111112"]
    assert checked(spark, "card_number", cards) == [c[0] in "23456" and luhn(c) for c in cards]
    numbers = [f"{r.randint(0, 999):03d}-{r.randint(0, 2):02d}-{r.randint(0, 2):04d}" for _ in range(300)] + ["666-12-1234", "900-12-1234"]
    assert checked(spark, "ssn", numbers) == [
        n[:3] not in ("000", "666") and n[0] != "9" and n[4:6] != "00" and n[7:] != "0000" for n in numbers]
    days = [f"{r.choice((1999, 2000, 2023, 2024))}-{r.randint(0, 13):02d}-{r.randint(0, 32):02d}" for _ in range(300)]
    assert checked(spark, "birth_date", days) == [real_day(d) for d in days]
    hosts = [".".join(str(r.randint(0, 300)) for _ in range(4)) for _ in range(100)] + ["01.2.3.4", "0.0.0.0", "255.255.255.255"]
    assert checked(spark, "ip_address", hosts) == [
        all(int(p) < 256 and str(int(p)) == p for p in h.split(".")) for h in hosts]
    assert checked(spark, "email", ["a@b.de", "a..b@c.de", ".a@b.de", "a@-b.de", "a@b.d", "a@b.c1", "a.b+c@d-e.f.org"]) == [
        True, False, False, False, False, False, True]
    assert checked(spark, "phone", ["(212) 555-0100", "212-555-0100", "112.555.0100", "212-155-0100", "911-555-0100", "212-911-0100"]) == [
        True, True, False, False, False, False]


def test_counts_of_valid_values(spark):
    texts = ["pay 4111111111111111 or 4111111111111112", "born 2023-02-30, 2023-02-28", None, "", "000-12-1234 123-12-1234"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r["pattern"]: (r["n_rows_hit"], r["n_hits"], r["n_rows_valid"], r["n_valid"]) for r in protect.scan_valid(frame, ["t"]).collect()}
    assert (found["card_number"], found["birth_date"], found["ssn"], found["email"]) == ((1, 2, 1, 1), (1, 2, 1, 1), (1, 2, 1, 1), (0, 0, 0, 0))
    assert {r["n_values"] for r in protect.scan_valid(frame, ["t"]).collect()} == {4}
    plain = {r["pattern"]: (r["n_rows_hit"], r["n_hits"]) for r in protect.scan_values(frame, ["t"]).collect()}
    assert plain == {k: v[:2] for k, v in found.items()}


def test_texts_hide_every_form_that_the_scan_finds(spark):
    given = "a.b@c.de (212) 555-0100 212.555.0100 1234 5678 9012 3456, 1234-5678-9012-3456; 1970-05-06 at 10.20.30.40 123456789 123-45-6789"
    text = protect.mask_texts(spark.createDataFrame([(given,), (None,), ("",)], "t string"), ["t"]).first()["t"]
    assert text == ("a***@c.de ***-***-**** ***-***-**** **** **** **** 3456, **** **** **** 3456; 1970-**-** at *.*.*.* ****6789 "
                    "***-**-****")


def test_near_names_are_not_broadcast(spark):
    """Names are many times their size once they are listed by variant, so a small table of names is no side to broadcast."""
    names = spark.createDataFrame([(n,) for n in ("ab", "abc", "abd", "x", "AB", "", None)], "column_name string")
    found = monitor.near_names(names)
    assert rows(found) == [("ab", "abc"), ("ab", "abd"), ("abc", "ab"), ("abc", "abd"), ("abd", "ab"), ("abd", "abc")]
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def shuffled_rows(plan):
    """Rows that the exchanges of a plan have written, once it has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_near_names_are_sent_by_window(spark):
    """Names of all lengths, with runs of a character over the windows' ends; what is sent is no row for each variant or pair."""
    r = random.Random(11)
    names = {"".join(r.choice("aab_é\U0001f600") for _ in range(r.randint(1, 22))) for _ in range(300)} | {"a" * n for n in range(1, 23)}
    for n in sorted(names):
        i = r.randint(0, len(n) - 1)
        names |= {n[:i] + n[i] + n[i:], n[:i] + r.choice("ab_1") + n[i + 1:], r.choice("ab_1") + n, n + n[-1]}
    names |= {f"billed_amt_{n}" for n in range(300, 700)}
    want = set()
    for a in names:
        for i in range(len(a)):
            near = {a[:i] + a[i + 1:]} | {a[:i] + c + a[i + 1:] for c in "ab_1é\U0001f600023456789"}
            want |= {p for b in near & names - {a} for p in ((a, b), (b, a))}
    found = monitor.near_names(spark.createDataFrame([(n,) for n in names] * 2, "column_name string"))
    assert rows(found) == sorted(want, key=repr)
    characters = sum(len(n) for n in names)
    assert len(want) > 3 * len(names)
    assert len(names) < shuffled_rows(found._jdf.queryExecution().executedPlan()) < characters
