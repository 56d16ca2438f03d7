"""Quality rules, line first: lines that fail are removed, then documents that lost too much text are rejected.

Built-in functions only, one pass over the texts, no shuffle: all rules of a document are expressions of its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict on a document."""

    # Punctuation: more of these marks than this share of the line's words, three at least.
    marks: str = "#*$%&|<>{}[]~^=_\\!"
    marks_per_word: float = 0.4
    least_marks: int = 3
    # Navigation: a line of this many words at most that doesn't end like a sentence, or one cut up by separators.
    stub_words: int = 3
    sentence_end: str = r"[.!?:;…\"'”’»)\]][\x20\x09-\x0D]*\z"
    separators: str = "|»›•·"
    separators_per_word: float = 0.25
    least_separators: int = 2
    # Boilerplate: these phrases, as whole words, are most of the words of a line of this many words at most.
    phrase_words: int = 30
    phrases: tuple[str, ...] = (
        "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use", "terms of service", "javascript",
        "click here", "read more", "sign in", "sign up", "log in", "subscribe", "share this", "back to top",
    )
    # A document goes if its kept lines hold less than this share of its characters.
    least_kept: float = 0.7
    # The base rules.
    least_words: int = 20
    repeat_percent: int = 30


def _marks(line: Column, marks: str) -> Column:
    return F.char_length(line) - F.char_length(F.translate(line, marks, ""))


def line_fails(line: Column, rules: Rules) -> Column:
    # The line's words, by all ASCII white space: the places where one begins.
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = _marks(line, rules.marks)
    cuts = _marks(line, rules.separators)
    # Plurals of a phrase's last word are the phrase too. Only lines with a phrase are taken apart.
    phrase = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(rules.phrases) + r")s?(?![\p{L}\p{N}_])"
    of_phrases = F.aggregate(F.regexp_extract_all(line, F.lit(phrase), F.lit(0)), F.lit(0),
                             lambda n, p: n + _marks(p, " ") + 1)
    boilerplate = F.when(line.rlike(phrase), 2 * of_phrases > words).otherwise(False)
    return (
        ((symbols >= rules.least_marks) & (symbols > rules.marks_per_word * words))
        | ((cuts >= rules.least_separators) & (cuts > rules.separators_per_word * words))
        | ((words <= rules.stub_words) & ~line.rlike(rules.sentence_end))
        | ((words <= rules.phrase_words) & boilerplate)
    )


def judge(docs: DataFrame, rules: Rules | None = None, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and, for each row:

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, clean_text, n_lines_removed, n_lines
    (lines with a word), kept. A NULL text counts as empty; an empty text fails the base rules (no words) and keeps an empty
    clean_text. ``clean_text`` holds the lines that pass and the blank lines, in their order. New columns replace given ones
    of the same name.
    """
    rules = rules or Rules()
    own = [c for c in docs.columns if c not in NEW_COLUMNS]
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"

    def step(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select("*", *(c.alias(f"__{n}") for n, c in columns.items()))

    df = step(docs.select(*own), text=text)
    df = step(df, words=F.filter(F.split("__text", BLANK), lambda w: w != ""),
              lines=F.filter(F.split("__text", "\n"), lambda x: x.rlike(has_word)))
    df = step(df, n=F.size("__words").cast("long"))
    grams = F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)),
                        lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))
    nothing = F.array().cast("array<bigint>")
    df = step(df, grams=F.when(F.col("__n") >= WINDOW, grams).otherwise(nothing))
    # Few documents repeat a window; only those are ordered.
    pairs = F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size(F.array_distinct("__grams")) < F.size("__grams")
    df = step(df, pairs=F.when(repeats, pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))

    def twice(x: Column, k: Column) -> Column:
        at = F.col("__pairs")
        before, after = F.get(at, k - 1)["g"], F.get(at, k + 1)["g"]
        return F.coalesce(before == x["g"], F.lit(False)) | F.coalesce(after == x["g"], F.lit(False))

    df = step(df, starts=F.sort_array(F.transform(F.filter("__pairs", twice), lambda x: x["i"])))

    def reach(p: Column, k: Column) -> Column:
        following = F.get(F.col("__starts"), k + 1)
        return F.least(F.lit(WINDOW), F.coalesce(following - p, F.lit(WINDOW))).cast("long")

    covered = F.aggregate(F.transform("__starts", reach), F.lit(0).cast("long"), lambda a, x: a + x)
    df = step(df, repeat=covered,
              good=F.filter(F.split("__text", "\n"), lambda x: ~x.rlike(has_word) | ~line_fails(x, rules)))
    df = step(df, clean=F.array_join("__good", "\n"), n_good=F.size(F.filter("__good", lambda x: x.rlike(has_word))),
              row=F.monotonically_increasing_id())

    def once(value: Column) -> Column:
        """The row number isn't deterministic, so a caller's filter stays above all steps. Pushed below them, it would
        repeat them inside each other, for each element of an array."""
        return F.when(F.col("__row") >= 0, value)

    failed = (F.col("__n") < rules.least_words) | (100 * F.col("__repeat") > rules.repeat_percent * F.col("__n"))
    solid = r"\x20\x09\x0A\x0B\x0C\x0D".encode().decode("unicode_escape")
    letters = F.char_length(F.translate("__text", solid, ""))
    enough = F.char_length(F.translate("__clean", solid, "")) >= rules.least_kept * letters
    return df.select(
        *own,
        once(F.col("__n")).alias("n_words"),
        letters.cast("long").alias("word_chars"),
        _marks(F.col("__text"), SYMBOLS).cast("long").alias("n_symbols"),
        once((F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).alias("n_dup_lines"),
        once(F.col("__repeat")).alias("n_repeat_words"),
        once(failed).alias("base_failed"),
        once(F.col("__clean")).alias("clean_text"),
        once((F.size("__lines") - F.col("__n_good")).cast("long")).alias("n_lines_removed"),
        once(F.size("__lines").cast("long")).alias("n_lines"),
        once(~failed & enough).alias("kept"),
    )


NEW_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text",
               "n_lines_removed", "n_lines", "kept")


def oracle_sql(rules: Rules | None = None) -> str:
    """The digest of ``judge`` over ``documents`` in DuckDB's SQL."""
    rules = rules or Rules()

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"

    def marks(of: str, which: str) -> str:
        return f"(length({of}) - length(translate({of}, {text(which)}, '')))"

    # Words by all ASCII white space. Signs are doubled, so that two phrases side by side each have one at both ends.
    count = f"len(regexp_extract_all(l, '{word}+'))"
    doubled = r"regexp_replace(l, '([^\p{L}\p{N}_])', '\1\1', 'g')"
    phrase = text(r"(?i)(?:^|[^\p{L}\p{N}_])((?:" + "|".join(p.replace(" ", "  ") for p in rules.phrases)
                  + r")s?)(?:$|[^\p{L}\p{N}_])")
    of_phrases = (f"coalesce(list_sum(list_transform(regexp_extract_all({doubled}, {phrase}, 1), "
                  f"lambda p: {marks('p', ' ')} / 2 + 1)), 0)")
    end = rules.sentence_end
    fails = (
        f"(({marks('l', rules.marks)} >= {rules.least_marks} AND {marks('l', rules.marks)} > {rules.marks_per_word} * {count})"
        f" OR ({marks('l', rules.separators)} >= {rules.least_separators}"
        f" AND {marks('l', rules.separators)} > {rules.separators_per_word} * {count})"
        f" OR ({count} <= {rules.stub_words} AND NOT regexp_matches(l, {text(end)}))"
        f" OR ({count} <= {rules.phrase_words} AND {of_phrases} > 0 AND 2 * {of_phrases} > {count}))"
    )
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(t, '{space}+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) AS lines,
    list_filter(string_split(t, chr(10)), lambda l: NOT regexp_matches(l, '{word}') OR NOT {fails}) AS good
  FROM base
), windows AS (
  SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)
), found AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM found, range({WINDOW}) AS r(j) GROUP BY rid
), counted AS (
  SELECT s.*, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    array_to_string(good, chr(10)) AS clean FROM split s LEFT JOIN covered c USING (rid)
)
SELECT doc_id, n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
  {marks('t', SYMBOLS)}::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
  (n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words) AS base_failed,
  (NOT (n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words)
    AND length(regexp_replace(clean, '{space}', '', 'g')) >= {rules.least_kept} * length(regexp_replace(t, '{space}', '', 'g'))
  ) AS kept,
  (len(lines) - len(list_filter(good, lambda l: regexp_matches(l, '{word}'))))::BIGINT AS n_lines_removed,
  length(clean)::BIGINT AS clean_chars
FROM counted"""
