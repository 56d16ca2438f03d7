"""Deadlines, concepts, similar columns, composite scores, schema changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import reference_data as ref
from wardline.operators.joins import top_per_key

PATH = ["schema_name", "table_name", "column_name"]


# --- deadlines -------------------------------------------------------------------------------------------------


def with_deadline(items: DataFrame, as_of: Column) -> DataFrame:
    """Deadline and breach of every open item (pending or escalated); categories without a deadline never breach.

    An escalated item counts from its last decision, if the state carries one.
    """
    hours = c.review_deadline_hours("category", "status")
    start = F.col("submitted_time")
    if "decided_at" in items.columns:
        start = F.when(F.col("status") == "ESCALATED", F.coalesce("decided_at", "submitted_time")).otherwise(start)
    open_items = items.filter(F.col("status").isin("PENDING", "ESCALATED"))
    due = start + F.make_dt_interval(hours=hours)
    return open_items.withColumn("due_time", due).withColumn(
        "is_breached", F.coalesce(F.col("due_time") < as_of, F.lit(False))
    )


def deadline_summary(items: DataFrame, as_of: Column) -> DataFrame:
    return with_deadline(items, as_of).groupBy("category", "status").agg(
        F.count(F.lit(1)).alias("n_open"), F.count_if("is_breached").alias("n_breached")
    )


# --- concepts --------------------------------------------------------------------------------------------------


def with_concept(items: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Add the concept of the tag. The built-in pairs are a constant map; a caller's table is left to the planner,

    which broadcasts by size, and is first reduced to one concept per tag.
    """
    if concepts is None:
        concept = F.try_element_at(c.literal_map(dict(ref.CONCEPTS)), F.col("suggested_tag"))
        return items.withColumn("concept_match", F.coalesce(concept, F.lit("")))
    known = concepts.groupBy("suggested_tag").agg(F.min("concept").alias("__concept"))
    return items.join(known, "suggested_tag", "left").withColumn(
        "concept_match", F.coalesce("__concept", F.lit(""))
    ).drop("__concept")


# --- similar columns -------------------------------------------------------------------------------------------


def similar_columns(items: DataFrame, classified: DataFrame, name: str = "column_name", k: int = 3) -> DataFrame:
    """For each item: classified columns of the same name in other tables.

    Gives their number, the most common tag among all of them and the first ``k`` as an array of (path, tag, column).
    The rows of a name are aggregated first, so its pairs are never listed: the cost is that of two
    aggregations and one lookup, however common the name is.
    ``classified`` holds schema_name, table_name, column_name, the name column and tag.
    """
    table = F.concat_ws(".", "schema_name", "table_name")
    per_tag = classified.withColumn("__table", table).groupBy(name, "__table", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.min("column_name").alias("column")
    )
    per_table = per_tag.groupBy(name, "__table").agg(
        F.sum("n").alias("n"), F.min("tag").alias("tag"), F.min("column").alias("column"))
    totals = per_tag.groupBy(name, "tag").agg(F.sum("n").alias("n"))
    # Few rows per name from here on: one per tag for the totals, k + 1 for the examples.
    by_name = totals.groupBy(name).agg(
        F.sum("n").alias("n_all"), F.max_by("tag", F.struct(F.col("n"), F.col("tag"))).alias("common_tag")
    )
    heads = top_per_key(per_table, [name], [F.asc("__table")], k + 1)
    examples = heads.groupBy(name).agg(
        F.array_sort(F.collect_list(F.struct(F.col("__table").alias("path"), F.col("tag"), F.col("column")))).alias("heads")
    )
    facts = by_name.join(examples, name)
    asked = items.withColumn("__table", table)
    own = per_table.select(name, "__table", F.col("n").alias("n_own"))
    joined = asked.join(own, [name, "__table"], "left").join(facts, name, "left")
    others = F.filter(F.coalesce("heads", F.array().cast("array<struct<path:string,tag:string,column:string>>")),
                      lambda h: h["path"] != F.col("__table"))
    found = joined.withColumn(
        "n_similar", F.coalesce(F.col("n_all") - F.coalesce("n_own", F.lit(0)), F.lit(0))
    )
    return found.withColumns(
        {
            "similar": F.slice(others, 1, k),
            "common_tag": F.when(F.col("n_similar") > 0, F.col("common_tag")),
        }
    ).drop("__table", "n_all", "n_own", "heads")


def with_similar(found: DataFrame) -> DataFrame:
    """Queue items with their similar columns filled in, from what ``similar_columns`` found for them.

    A column of the same name has similarity 97 if its tag is the same too, else 90.
    """
    def path(s: Column) -> Column:
        return F.concat_ws(".", s["path"], s["column"])

    same_tag = lambda s: F.when(s["tag"] == F.col("suggested_tag"), 97.0).otherwise(90.0)
    return found.withColumns({
        "similar_columns": F.transform("similar", lambda s: F.concat(path(s), F.lit(" ("), s["tag"], F.lit(")"))),
        "similar_columns_metrics": F.transform(
            "similar", lambda s: F.struct(path(s).alias("name"), same_tag(s).alias("similarity"))),
    }).drop("similar", "common_tag", "n_similar")


# The windows of a name have so many characters at most, and a name has so many windows at least.
WINDOW, LEAST_WINDOWS = 5, 3


def near_names(df: DataFrame, name: str = "column_name") -> DataFrame:
    """Pairs of distinct names that differ by one character inserted, dropped or replaced.

    A name is cut into windows of a few characters. Two such names are the same before and behind one window of the longer
    one. So a name is sent once for each of its windows, and once for each window that a name longer by one character
    would have, to a place that stands for all before and behind the window. Only there it is listed by its variants: each
    drops one character of the window. What is sent is a fraction of the variants, and nothing is sent after them.

    Names of one length are near if they share the variant without one position, and a longer name is near to its own
    variants, where of equal neighbours the first one is dropped. So a pair is found at one position only, and once. The names of a
    place differ within a window, so no place is hot, and nothing is cut off. Hashes only bring names together: the texts are compared.
    """
    names = df.select(F.lower(F.col(name)).alias("name")).filter(F.length("name") > 0).distinct()

    def width(length: Column) -> Column:
        return F.least(F.lit(WINDOW), F.ceil(length / LEAST_WINDOWS).cast("int"))

    def windows(length: Column) -> Column:
        return F.ceil(length / width(length)).cast("int")

    def variant(text: str, at: str) -> Column:
        """The name without the character at a position; the name itself at what is no position."""
        shorter = F.concat(F.substring(text, F.lit(1), F.col(at) - 1), F.substring(text, F.col(at) + 1, F.length(text)))
        return F.when(F.col(at) > 0, shorter).otherwise(F.col(text))

    # Windows are numbered from 1, and those of a longer name from -1 downwards. Names in order are alike and take less space.
    size, number = F.length("name"), F.abs("window")
    sent = names.sortWithinPartitions("name").select("name", F.explode(F.concat(
        F.sequence(F.lit(1), windows(size)), F.sequence(F.lit(-1), -windows(size + 1)))).alias("window"))
    more = F.when(F.col("window") < 0, 1).otherwise(0)
    length = size + more
    begin, end = (number - 1) * width(length), F.least(number * width(length), length)
    place = F.xxhash64(number, length, F.substring("name", F.lit(1), begin), F.substring("name", end - more + 1, size))
    # The number of tasks is given, as Spark would join parts by what is sent, and they grow only then.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    positions = F.when(F.col("window") > 0, F.sequence(begin + 1, end)).otherwise(F.array("window"))
    met = sent.repartition(tasks, place).select("name", place.alias("place"), F.explode(positions).alias("at"))
    listed = met.select("place", F.xxhash64(variant("name", "at")).alias("variant"), F.struct("at", "name").alias("one"))
    # Whole names stand first, then those without their first character, their second and so on. Each meets what stands before it.
    group = Window.partitionBy("place", "variant").orderBy("one").rowsBetween(Window.unboundedPreceding, -1)
    ahead = listed.withColumn("ahead", F.collect_list("one").over(group)).filter((F.col("one.at") > 0) & (F.size("ahead") > 0))
    pairs = ahead.select("one", F.explode("ahead").alias("other")).select(
        "one.name", "one.at", F.col("other.name").alias("near_name"), F.col("other.at").alias("near_at"))
    leads = (F.col("at") == 1) | (F.substring("name", F.col("at") - 1, F.lit(1)) != F.substring("name", F.col("at"), F.lit(1)))
    longer = leads & (F.col("near_at") == -F.ceil(F.col("at") / width(size)))
    near = F.when(F.col("near_at") > 0, F.col("near_at") == F.col("at")).otherwise(longer)
    found = pairs.filter(near & (variant("name", "at") == variant("near_name", "near_at")) & (F.col("name") != F.col("near_name")))
    return found.select(F.inline(F.array(
        F.struct("name", "near_name"), F.struct(F.col("near_name").alias("name"), F.col("name").alias("near_name")))))


def name_tokens(name: Column | str) -> Column:
    """The distinct runs of letters and of digits of a name, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1)))


def similar_names(df: DataFrame, name: str = "column_name", percent: int = 60) -> DataFrame:
    """Pairs of distinct names whose token sets are similar: 100 * common >= ``percent`` * all (Jaccard), with the similarity
    and the edit distance of the names.

    A set-similarity join with prefix filtering. The tokens of all names are ordered by how many names have them, the rarest
    first. Two sets of sizes x and y can only be similar if the first x - ceil(t x) + 1 tokens of one and the first
    y - ceil(t y) + 1 of the other have a token in common, and if neither size is below t times the other. So names meet by an
    equi-join on (token of the prefix, size): frequent tokens stand at the end of the order and make no block, and a block
    is split by size. A pair is kept at its first common token only, so it is listed once, and then verified. Names
    without letters and digits are similar to none.
    """
    names = df.select(F.lower(F.col(name)).alias("name")).distinct().withColumn("tokens", name_tokens("name"))
    each = names.select("name", F.explode("tokens").alias("token"))
    count = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(count, "token").groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda t: t["token"]).alias("tokens"))

    def at_least(size: Column) -> Column:
        return F.ceil(size * percent / 100).cast("int")

    size = F.size("tokens")
    sized = ordered.withColumn("size", size).withColumn("prefix", F.slice("tokens", F.lit(1), size - at_least(size) + 1))
    keyed = sized.withColumn("token", F.explode("prefix"))
    # The larger set looks for the sizes that a smaller or equal one may have.
    left = keyed.withColumn("other", F.explode(F.sequence(F.greatest(at_least(F.col("size")), F.lit(1)), F.col("size"))))
    a, b = left.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.other") == F.col("b.size")))
    once = (F.col("a.size") > F.col("b.size")) | (F.col("a.name") < F.col("b.name"))
    first = F.get(F.array_intersect("a.prefix", "b.prefix"), F.lit(0)) == F.col("a.token")
    common = F.size(F.array_intersect("a.tokens", "b.tokens"))
    whole = F.col("a.size") + F.col("b.size") - common
    return met.filter(once & first & (100 * common >= percent * whole)).select(
        F.least("a.name", "b.name").alias("name"), F.greatest("a.name", "b.name").alias("near_name"),
        F.round(common / whole, 6).alias("similarity"), F.levenshtein("a.name", "b.name").alias("distance"))


# --- composite score -------------------------------------------------------------------------------------------


def composite_confidence(scores: DataFrame, keys: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean of the workers' scores (worker, confidence) per key; workers without a weight do not count."""
    weight = F.coalesce(F.try_element_at(c.literal_map(dict(weights)), F.col("worker")), F.lit(0.0))
    known = F.col("confidence").isNotNull()
    return scores.groupBy(*keys).agg(
        F.round(
            F.try_divide(F.sum(weight * F.col("confidence")), F.sum(F.when(known, weight))), 6
        ).alias("composite_confidence"),
        F.count_if(known & (weight > 0)).alias("n_workers"),
    )


# --- schema changes --------------------------------------------------------------------------------------------


def schema_changes(before: DataFrame, after: DataFrame, as_of: Column) -> DataFrame:
    """Columns added, removed or changed in type between two inventory snapshots, as event rows."""
    old = before.select(*PATH, F.col("data_type").alias("old_type"), F.lit(True).alias("was"))
    new = after.select(*PATH, F.col("data_type").alias("new_type"), F.lit(True).alias("is"))
    kind = (
        F.when(F.col("was").isNull(), "COLUMN_ADDED")
        .when(F.col("is").isNull(), "COLUMN_REMOVED")
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "TYPE_CHANGED")
    )
    changed = old.join(new, PATH, "full_outer").withColumn("event_type", kind).filter(F.col("event_type").isNotNull())
    column = F.concat(F.lit("'"), F.col("column_name"), F.lit("'"))
    details = (
        F.when(F.col("event_type") == "COLUMN_ADDED", F.concat(F.lit("New column "), column, F.lit(" added to table schema.")))
        .when(F.col("event_type") == "COLUMN_REMOVED", F.concat(F.lit("Column "), column, F.lit(" removed from table schema.")))
        .otherwise(F.concat(F.lit("Column "), column, F.lit(" changed from "), F.coalesce("old_type", F.lit("unknown")),
                            F.lit(" to "), F.coalesce("new_type", F.lit("unknown")), F.lit(".")))
    )
    target = F.concat_ws(".", "schema_name", "table_name")
    event = F.sha2(F.concat_ws("|", "event_type", *PATH, c.second_text(as_of)), 256)
    return changed.select(
        F.concat(F.lit("EVT-"), F.substring(event, 1, 12)).alias("event_id"),
        "event_type",
        target.alias("target_table"),
        details.alias("details"),
        F.lit("Queued for classification").alias("action_taken"),
        F.lit("PENDING").alias("status"),
        as_of.alias("ts"),
    )
