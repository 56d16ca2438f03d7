"""The catalog view: tags with their policies, search, explorer figures, tag upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import columns as c
from wardline.functions import reference_data as ref
from wardline.operators.classify import join_prior, with_keys
from wardline.operators.joins import top_per_key

PATH = ["schema_name", "table_name", "column_name"]
SYSTEM_REVIEWER = "system-agent"
CLASS_DATE = "2026-07-01"


def with_catalog_rule(df: DataFrame, name_key: str) -> DataFrame:
    """Add rule_tag, the catalog rules' tag for a lower-case name; the empty text if no rule matches."""
    numbered = df.withColumn("rule_number", c.rule_number(name_key, ref.CATALOG_RULES))
    ruled = F.coalesce(c.rule_value("rule_number", "tag", ref.CATALOG_RULES), F.lit(""))
    return numbered.withColumn("rule_tag", ruled).drop("rule_number")


def catalog_view(inventory: DataFrame, prior: DataFrame, class_date: str = CLASS_DATE, keep=()) -> DataFrame:
    """One row per column with tag, policies and status. The results table's own columns stay Unclassified."""
    named = inventory.filter(
        (F.length("column_name") > 0) & ~F.col("column_name").startswith("#") & (F.length("data_type") > 0)
    )
    joined = join_prior(with_catalog_rule(with_keys(named), "c_key"), prior)
    own = F.col("t_key") == ref.RESULTS_TABLE
    tag = F.when(own, F.lit("")).when(c.is_blank_tag("prior_tag"), F.col("rule_tag")).otherwise(F.col("prior_tag"))
    return with_policies(joined.withColumn("tag", tag), class_date, keep)


def with_policies(tagged: DataFrame, class_date: str = CLASS_DATE, keep=()) -> DataFrame:
    has_tag = F.col("tag") != ""
    return tagged.select(
        *keep,
        *PATH,
        "tag",
        c.masking_policy("tag").alias("masking_policy"),
        c.access_policy("tag").alias("abac_policy"),
        F.when(has_tag, class_date).otherwise("").alias("class_date"),
        F.when(has_tag, SYSTEM_REVIEWER).otherwise("").alias("last_reviewer"),
        F.when(has_tag, "Classified").otherwise("Unclassified").alias("status"),
        "data_type",
    )


def search_hit(query: str) -> Column:
    """If schema, table, column or tag contains the query; an empty query hits all rows."""
    if not query:
        return F.lit(True)
    word = query.lower()
    test = F.lit(False)
    for name in (*PATH, "tag"):
        test = test | F.coalesce(F.lower(F.col(name)).contains(word), F.lit(False))
    return test


def search(catalog: DataFrame, query: str) -> DataFrame:
    return catalog.filter(search_hit(query))


def column_metadata(catalog: DataFrame, schema: str | Column, table: str | Column, column: str | Column) -> DataFrame:
    """The entry of one column; the names may be scalar subqueries."""
    return catalog.filter(
        (F.col("schema_name") == schema) & (F.col("table_name") == table) & (F.col("column_name") == column)
    )


def filled_tags(catalog: DataFrame) -> DataFrame:
    """Give untagged rows the rule tag of their name, as the explorer does; the status column stays as it is."""
    ruled = with_catalog_rule(catalog.withColumn("__key", F.lower("column_name")), "__key")
    tag = F.when(c.is_blank_tag("tag"), F.col("rule_tag")).otherwise(F.col("tag"))
    return ruled.withColumn("tag", tag).drop("__key", "rule_tag")


def explorer_masks(catalog: DataFrame) -> DataFrame:
    """Boolean columns for the three groups, which may overlap, and for none of them."""
    low = F.lower(F.coalesce("tag", F.lit("")))
    flagged = catalog.withColumns(
        {"is_pii": low.contains("pii"), "is_phi": low.contains("phi"), "is_financial": low.contains("financial")}
    )
    return flagged.withColumn(
        "is_unclassified", ~(F.col("is_pii") | F.col("is_phi") | F.col("is_financial"))
    )


def explorer_rows(catalog: DataFrame, show_all: bool = False) -> DataFrame:
    return catalog if show_all else catalog.filter(F.length("tag") > 0)


def explorer_totals(catalog: DataFrame) -> DataFrame:
    """Columns, columns per group and the classified share, in one pass."""
    masks = explorer_masks(catalog)
    tagged = F.count_if(F.length("tag") > 0)
    return masks.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if("is_pii").alias("pii_columns"),
        F.count_if("is_phi").alias("phi_columns"),
        F.count_if("is_financial").alias("financial_columns"),
        F.count_if("is_unclassified").alias("unclassified_columns"),
        F.coalesce(F.try_divide(tagged, F.count(F.lit(1))) * 100, F.lit(0.0)).alias("classified_pct"),
    )


def tags_by_group(catalog: DataFrame) -> DataFrame:
    """Columns per tag within each group, plus the number of distinct tags of the group.

    Rows are first counted per tag, so the second step sees only one row per tag.
    """
    per_tag = catalog.groupBy("tag").agg(F.count(F.lit(1)).alias("n_columns"))
    masks = explorer_masks(per_tag)
    groups = F.filter(
        F.array(
            F.when(F.col("is_pii"), F.lit("PII")),
            F.when(F.col("is_phi"), F.lit("PHI")),
            F.when(F.col("is_financial"), F.lit("Financial")),
        ),
        lambda g: g.isNotNull(),
    )
    return masks.select(F.explode(groups).alias("category"), "tag", "n_columns")


def distinct_tags(catalog: DataFrame) -> DataFrame:
    return tags_by_group(catalog).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_tags"), F.sum("n_columns").alias("n_columns")
    )


def catalog_totals(catalog: DataFrame) -> DataFrame:
    tagged = F.count_if(F.length("tag") > 0)
    total = F.count(F.lit(1))
    return catalog.agg(
        total.alias("tracked"), tagged.alias("classified"), (total - tagged).alias("unclassified")
    )


def current_tags(tag_events: DataFrame) -> DataFrame:
    """The last tag written to each column."""
    return top_per_key(tag_events, PATH, [F.desc("ts"), F.desc("decision_id")])


def upsert_tags(catalog: DataFrame, tag_events: DataFrame) -> DataFrame:
    """Catalog after the tag writes: known columns keep their policies, new ones start with policy 'None'."""
    new = current_tags(tag_events).select(
        *PATH,
        F.col("tag").alias("new_tag"),
        F.col("user_email").alias("new_reviewer"),
        F.date_format("ts", "yyyy-MM-dd").alias("new_date"),
    )
    written = F.col("new_tag").isNotNull()
    joined = catalog.join(new, PATH, "full_outer")
    return joined.select(
        *PATH,
        F.coalesce("new_tag", "tag").alias("tag"),
        F.coalesce("masking_policy", F.lit(c.NONE)).alias("masking_policy"),
        F.coalesce("abac_policy", F.lit(c.NONE)).alias("abac_policy"),
        F.coalesce("new_date", "class_date").alias("class_date"),
        F.coalesce("new_reviewer", "last_reviewer").alias("last_reviewer"),
        F.when(written, "Classified").otherwise(F.col("status")).alias("status"),
        "data_type",
    )
