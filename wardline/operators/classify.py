"""From column inventory and prior results to the review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import reference_data as ref
from wardline.functions.reference_data import Rule
from wardline.operators.joins import top_per_key

KEYS = ["t_key", "c_key"]
RULE_FIELDS = ("tag", "category", "confidence", "priority", "native_class", "explanation")


def with_keys(df: DataFrame) -> DataFrame:
    """Add the normalised table and column names."""
    return df.withColumns({"t_key": c.clean("table_name"), "c_key": c.clean("column_name")})


def discoverable(inventory: DataFrame) -> DataFrame:
    """Drop what discovery skips: nameless columns, comment rows and the results table itself."""
    name = F.col("column_name")
    return inventory.filter(
        (F.length(name) > 0) & ~name.startswith("#") & (c.clean("table_name") != ref.RESULTS_TABLE)
    )


def numbered(df: DataFrame, rules: Sequence[Rule] = ref.QUEUE_RULES) -> DataFrame:
    """Add rule_number, the first matching rule.

    The long chain of tests is evaluated here once per row, before any join; later steps carry the small number.
    """
    keyed = df if "c_key" in df.columns else df.withColumn("c_key", c.clean("column_name"))
    return keyed.withColumn("rule_number", c.rule_number("c_key", rules))


def with_rule_values(df: DataFrame, rules: Sequence[Rule] = ref.QUEUE_RULES) -> DataFrame:
    return df.withColumns({f"rule_{f}": c.rule_value("rule_number", f, rules) for f in RULE_FIELDS})


def classify(df: DataFrame, rules: Sequence[Rule] = ref.QUEUE_RULES) -> DataFrame:
    """Add the six rule outputs. The rules are constants, so this is one projection without join or shuffle."""
    return with_rule_values(numbered(df, rules), rules)


def rule_table(spark, rules: Sequence[Rule] = ref.QUEUE_RULES) -> DataFrame:
    """The rules as rows, for callers that keep their own rule table."""
    rows = [(n, list(r.keywords), *[getattr(r, f) for f in RULE_FIELDS]) for n, r in enumerate(rules, 1)]
    return spark.createDataFrame(
        rows,
        "rule_order int, keywords array<string>, tag string, category string, confidence double, priority string, "
        "native_class string, explanation string",
    )


# Characters of the runs under which keywords are listed.
RUN = 4


def _grams(text: str, size: int) -> Column:
    """All runs of ``size`` characters of a text column."""
    count = F.length(text) - (size - 1)
    return F.when(count > 0, F.transform(
        F.sequence(F.lit(1), count), lambda i: F.substring(F.col(text), i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def classify_by_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``classify`` for a rule table of any length: the first rule (by rule_order) with a keyword in the name counts.

    Keywords are found through an index of runs of four characters. Each keyword is listed once, under the run of its own that the
    fewest names have (shorter keywords under themselves), so a run that most names have is no meeting place unless it
    is all there is. Names meet keywords by an equi-join on runs, and ``contains`` verifies. Only distinct names are looked at, and
    get their rule back by a join. Runs and found names grow with the names but look small to the planner, so these joins are
    merged: nothing is broadcast by a guess. Of rules of one order the smallest in its values counts; an empty keyword is in every
    name; missing names and keywords match nothing.
    """
    keyed = df if "c_key" in df.columns else df.withColumn("c_key", c.clean("column_name"))
    words = (
        rules.select(F.struct("rule_order", *RULE_FIELDS).alias("rule"), F.explode("keywords").alias("word"))
        .filter(F.col("word").isNotNull()).groupBy("word").agg(F.min("rule").alias("rule"))
    )
    # Names are cut into runs of the sizes that keywords need.
    sizes = words.agg(F.collect_set(F.least(F.length("word"), F.lit(RUN))).alias("sizes")).scalar()
    none = F.array().cast("array<string>")
    runs = F.concat(*(F.when(F.array_contains(sizes, n), _grams("c_key", n)).otherwise(none) for n in range(1, RUN + 1)))
    names = keyed.select("c_key").filter(F.col("c_key").isNotNull()).distinct()
    probes = names.select("c_key", F.explode(F.array_distinct(runs)).alias("gram"))
    held = probes.groupBy("gram").agg(F.count(F.lit(1)).alias("n_names"))
    own = F.when(F.length("word") < RUN, F.array("word")).otherwise(F.array_distinct(_grams("word", RUN)))
    # A keyword of which a run is in no name at all needs no listing; the count of its runs tells.
    listed = (
        words.filter(F.length("word") > 0).select("word", "rule", F.size(own).alias("n_runs"), F.explode(own).alias("gram"))
        .join(held.hint("merge"), "gram")
        .groupBy("word").agg(F.min(F.struct("n_names", "gram")).alias("rarest"), F.count(F.lit(1)).alias("n_held"),
                             F.max("n_runs").alias("n_runs"), F.min("rule").alias("rule"))
        .filter("n_held = n_runs").select("rarest.gram", "word", "rule")
    )
    found = probes.hint("merge").join(listed, "gram").filter(F.contains("c_key", "word")).groupBy("c_key").agg(F.min("rule").alias("__rule"))
    every = words.filter(F.length("word") == 0).agg(F.min("rule").alias("rule")).scalar()
    joined = keyed.join(found.hint("merge"), "c_key", "left").withColumn(
        "__rule", F.when(F.col("c_key").isNotNull(), F.least("__rule", every)))
    return joined.select(
        *keyed.columns, F.col("__rule")["rule_order"].alias("rule_number"),
        *(F.coalesce(F.col("__rule")[f], F.lit(getattr(ref.UNMATCHED, f))).alias(f"rule_{f}") for f in RULE_FIELDS))


def latest_prior(prior: DataFrame) -> DataFrame:
    """One prior result per (table, column): highest readable confidence, then the greatest tag."""
    keyed = with_keys(prior).filter((F.col("t_key") != "") & (F.col("c_key") != ""))
    best = keyed.withColumn("prior_confidence", c.confidence("confidence")).withColumn(
        "prior_tag", F.btrim(F.col("class_tag"), F.lit(c.BLANKS))
    )
    order = [F.desc("prior_confidence"), F.desc_nulls_last("prior_tag")]
    return top_per_key(best.select(*KEYS, "prior_tag", "prior_confidence"), KEYS, order)


def join_prior(inventory: DataFrame, prior: DataFrame) -> DataFrame:
    """Inventory with its prior result, by normalised table and column name (the schema is not part of the key)."""
    keyed = inventory if "t_key" in inventory.columns else with_keys(inventory)
    return keyed.join(latest_prior(prior), KEYS, "left")


def merged(inventory: DataFrame, prior: DataFrame, rules: Sequence[Rule] = ref.QUEUE_RULES) -> DataFrame:
    """A usable prior tag overrides the rules; blank tags fall back to them."""
    joined = join_prior(numbered(with_keys(inventory), rules), prior)
    flagged = with_rule_values(joined, rules).withColumn("from_prior", ~c.is_blank_tag("prior_tag"))
    from_prior = {
        "suggested_tag": (F.col("prior_tag"), "tag"),
        "category": (c.tag_category("prior_tag"), "category"),
        "confidence_score": (F.col("prior_confidence"), "confidence"),
        "priority": (c.prior_priority("prior_confidence"), "priority"),
        "native_classification": (c.prior_native_class("prior_tag"), "native_class"),
        "ai_explanation": (F.lit(ref.PRIOR_EXPLANATION), "explanation"),
    }
    usable = F.col("from_prior")
    return flagged.withColumns(
        {name: F.when(usable, value).otherwise(F.col(f"rule_{field}")) for name, (value, field) in from_prior.items()}
    )


def tagged_only(df: DataFrame) -> DataFrame:
    """Columns without a tag do not enter the queue."""
    return df.filter(F.col("suggested_tag").isNotNull())


def review_queue(inventory: DataFrame, prior: DataFrame, submitted: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The full queue row of every tagged column. ``keep`` names inventory columns to carry along."""
    rows = tagged_only(merged(discoverable(inventory), prior)).withColumn("submitted_time", submitted)
    return rows.select(
        *keep,
        c.item_id("schema_name", "table_name", "column_name").alias("id"),
        "schema_name",
        "table_name",
        "column_name",
        F.expr("coalesce(nullif(data_type, ''), 'STRING') AS data_type"),
        "suggested_tag",
        "native_classification",
        F.expr("'' AS ontology_match"),
        F.expr("cast(array() AS array<string>) AS similar_columns"),
        "confidence_score",
        c.recommendation("confidence_score").alias("supervisor_recommendation"),
        "ai_explanation",
        F.expr("cast(array() AS array<string>) AS sample_values"),
        F.expr("'PENDING' AS status"),
        "submitted_time",
        "priority",
        "category",
        c.domain("schema_name").alias("domain"),
        F.expr("'' AS concept_match"),
        F.expr("confidence_score AS concept_confidence"),
        F.expr("cast(array() AS array<struct<name:string,similarity:double>>) AS similar_columns_metrics"),
        c.initial_timeline("submitted_time").alias("governance_timeline"),
    )
