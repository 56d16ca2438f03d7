import duckdb
import pytest
from conftest import SF, rows
from llm.cases import EDGES

from tools.check_oracle import table
from wardline.llm import line_rules, preference
from wardline.llm.queries import ORACLES, QUERIES

FLAT = "kept", "n_words", "n_lines_removed", "base_failed"


@pytest.mark.parametrize(("name", "source"), [("op4_line_rules", "documents"), ("op5_preference_format", "conversations")])
def test_twin(spark, name, source):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{SF}/{source}.parquet'")
    found = QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
    result = con.execute(ORACLES[name])
    twin = table([c[0] for c in result.description], result.fetchall())
    assert table(found.columns, [tuple(r) for r in found.collect()]) == twin


PHRASES = [
    "Read more\tsign in", "sign in, log in; COOKIES!", "a design in wood", "the catalog in print", "cookiesheet", "cookie_jar here now",
    "click here click here", "copyright-free text of ten words that goes on for a while longer", "Subscribes", "All  rights reserved.",
    "tab\tseparated\twords\tin\ta\tline", "x y\u2028", "ends here.\u2028", "Ünsubscribe", "one two three four. \r", "a|b|c", "»sign up«",
    "back to top back to top of the page", "javascript",
]


def test_edges_against_the_twin(spark):
    texts = [(i, t) for i, (_, t, *_) in enumerate(EDGES)] + [(100 + i, t) for i, t in enumerate(PHRASES)]
    texts.append((200, "\n".join(PHRASES)))
    found = line_rules.judge(spark.createDataFrame(texts, "doc_id long, text string")).selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", "cast(char_length(clean_text) as long) clean_chars")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    result = con.execute(ORACLES["op4_line_rules"])
    assert table(found.columns, [tuple(r) for r in found.collect()]) == table(
        [c[0] for c in result.description], result.fetchall())


def test_repeated_windows(spark):
    eight = "a b c d e f g h"
    cases = [(f"{eight} x {eight}", 16), (f"{eight} i x {eight} i", 18), ("z " * 9, 9), ("z " * 8, 0), (eight, 0),
             ("p " * 12 + "q", 12)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert rows(line_rules.judge(frame), "doc_id", "n_repeat_words") == [(i, n) for i, (_, n) in enumerate(cases)]


def test_lines_that_fail_are_removed_first(spark):
    good = "This line has a number of words that differ, and it ends like a sentence should."
    bad = ["Home | About | Contact | Help", "All rights reserved.", "Menu", "x### y$$$ z&&& w%%% v***"]
    second = "Other words make up this second line, which is a sentence as well, and it goes on and on for a good while."
    second += " A third sentence makes the part of the text that stays long enough, by all accounts."
    mostly = "\n".join([good, second, *bad])
    little = "\n".join([good + " " + good[5:40], *(f"a{i}### b{i}$$$ c{i}&&& d{i}*** e{i}||| f{i}###" for i in range(12))])
    frame = spark.createDataFrame([(1, mostly), (2, little)], "doc_id long, text string")
    first, second = line_rules.judge(frame).orderBy("doc_id").collect()
    assert first.kept and first.n_lines_removed == 4 and first.clean_text == "\n".join(mostly.split("\n")[:2])
    assert not second.kept and not second.base_failed


def test_clean_lines_stay(spark):
    wrapped = "\n".join([
        "The museum shows a design in wood and a blog in print by people of", "the town, who bake bread more often than others and log infrequently",
        "what the cookie recipes and the copyright law of the country have in common", "with JavaScript, a language that many people read more about each year."])
    tabbed = "\n".join("\t".join(f"value{i}{j}" for j in range(9)) for i in range(5))
    boilerplate = ["All rights reserved.", "Read more!", "Please sign in", "Copyright 2024", "Privacy policy | Cookies", "Subscribe!"]
    frame = spark.createDataFrame(
        [(1, wrapped), (2, tabbed), (3, "\n".join([wrapped, *boilerplate])), (4, "two\twords")], "doc_id long, text string")
    one, two, three, four = line_rules.judge(frame).orderBy("doc_id").collect()
    assert one.kept and one.clean_text == wrapped and two.kept and two.clean_text == tabbed
    assert three.kept and three.clean_text == wrapped and four.n_lines_removed == 1


def test_rules_with_clashing_columns_and_no_rows(spark, clashing):
    found = line_rules.judge(clashing)
    assert found.filter("n_words >= 0").count() == len(EDGES)
    assert line_rules.judge(clashing.limit(0)).collect() == []


TURNS = [
    # pair, chosen, turn, role, text
    (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "hi"),
    (1, False, 1, "assistant", "no <|user|> x"), (1, False, 2, "user", None),
    (2, True, 0, "user", "same"), (2, False, 0, "user", "same"),
    (3, True, 0, None, "alone"),
    (4, True, None, "system", "s"), (4, False, None, "system", "s"), (4, True, 1, "user", "u"), (4, False, 1, "user", "u"),
    (4, True, 1, "user", "u"),
    (None, True, 0, "user", "lost"), (5, None, 0, "user", "lost"),
]


def test_preferences(spark):
    from pyspark.sql import functions as F

    kind = "pair_id long, chosen boolean, turn long, role string, text string"
    frame = spark.createDataFrame(TURNS, kind).withColumn("prompt", F.lit("clash"))
    found = {r.pair_id: r for r in preference.format_preferences(frame).collect()}
    assert sorted(found) == [1, 2, 3, 4]
    one = found[1]
    assert (one.n_common, one.prompt, one.chosen) == (1, "<|user|>\nhi\n", "<|assistant|>\nyes\n")
    assert one.rejected == "<|assistant|>\nno < |user|> x\n<|user|>\n\n"
    assert [tuple(m) for m in one.rejected_mask] == [(14, False), (15, True), (9, False), (1, False)]
    assert sum(m.chars for m in one.rejected_mask) == len(one.rejected)
    assert (found[2].n_common, found[2].chosen, found[2].rejected, found[2].complete) == (1, "", "", True)
    assert (found[3].prompt, found[3].chosen, found[3].complete) == ("", "<|unknown|>\nalone\n", False)
    assert (found[4].n_common, found[4].chosen, found[4].rejected) == (2, "<|user|>\nu\n", "")
    assert preference.format_preferences(frame.limit(0)).collect() == []


def test_pairs_begin_alike(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    found = QUERIES["op5_preference_format"](spark, SF)
    assert found.agg({"n_common": "max"}).first()[0] > 2 and found.filter("n_common = 0").count() < found.count() / 4
    with_answer = given.filter("role = 'assistant'").select("conv_id").distinct().count()
    assert found.count() == with_answer
    listed = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "thanks"),
              (2, 0, "assistant", "z"), (3, 0, "user", "alone"), (None, 0, "assistant", "lost")]
    frame = spark.createDataFrame(listed, "conv_id long, turn long, role string, text string")
    pairs = {r.pair_id: r for r in preference.format_preferences(preference.with_other_ending(frame)).collect()}
    assert sorted(pairs) == [1, 2]
    assert (pairs[1].n_common, pairs[1].chosen) == (2, "<|assistant|>\nb\n<|user|>\nthanks\n")
    assert pairs[1].rejected == "<|assistant|>\nz\n<|user|>\nthanks\n"
    assert (pairs[2].n_common, pairs[2].rejected, pairs[2].complete) == (0, "", False)


def test_twin_of_pairs_on_hard_rows(spark, tmp_path):
    listed = [(1, 0, "user", "q"), (1, None, "assistant", "n"), (2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (2, 5, "assistant", None),
              (3, 1, None, "r"), (3, 2, "assistant", None), (4, 0, "assistant", "<|end"), (None, 1, "assistant", "y")]
    spark.createDataFrame(listed, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op5_preference_format"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.execute(ORACLES["op5_preference_format"])
    assert table(found.columns, [tuple(r) for r in found.collect()]) == table(
        [c[0] for c in result.description], result.fetchall())
