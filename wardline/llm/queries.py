"""The registered queries of this package, and their SQL twins where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    bpe,
    contamination,
    langfilter,
    line_rules,
    preference,
    quality_model,
    setsketch,
    slots,
    token_counts,
    token_files,
    turn_repair,
    whitening,
    wrapper,
)

# The folder of the public tokenizers' files is that of their package, if no other is given here.
TOKENIZERS: str | None = None


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_setsketch_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, folder, "documents"), width=2, percent=80)


def op2_virtual_slot_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = slots.shard(_table(spark, folder, "documents"), shards=8)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op3_ftrl_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.coalesce(quality_model.fold("doc_id", 5) == 0, F.lit(False))
    model = quality_model.fit(docs, _table(spark, folder, "labels"), quality_model.fold("doc_id", 5) != 0)
    return quality_model.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= quality_model.RULE, 1).otherwise(0).alias("predicted"))


def op4_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", F.char_length("clean_text").cast("long").alias("clean_chars"))


def op5_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """The table names no pairs: each conversation is paired with itself under another ending."""
    turns = preference.with_other_ending(_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    return (
        preference.format_preferences(turns)
        .withColumn("chosen_mask", preference.mask_text(F.col("chosen_mask")))
        .withColumn("rejected_mask", preference.mask_text(F.col("rejected_mask")))
    )


def op6_matrix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern()
    return bpe.digest(bpe.encode(docs, path, pattern).drop("text"), path, pattern)


def op7_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.coalesce(quality_model.fold("doc_id", 4) == 2, F.lit(False))
    filters = langfilter.fit(docs, quality_model.fold("doc_id", 4) != 2)
    return langfilter.identify(docs.select("doc_id", "text"), filters).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    path = token_files.fresh_path(spark)
    files = token_files.write_files(docs, tokenizer_file("byte_bpe_50k.json"), path)
    return token_files.checksums(token_files.read_files(files, path))


def op9_cgk_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_wrapper_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return wrapper.main_text(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    audits, repaired = turn_repair.repair(turn_repair.damaged(turns))
    found = audits.alias("a").join(
        turn_repair.digests(repaired).alias("r"), F.col("a.conv_id").eqNullSafe(F.col("r.conv_id")), "left"
    ).select("a.*", "repaired_sha256")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    # A conversation that lost all rows has no faults left, and nothing to hash.
    return turns.select("conv_id").distinct().alias("o").join(
        found.alias("f"), F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")), "left"
    ).select("o.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
             F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = token_counts.count_tokens(docs, tokenizer_file("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def op13_lanczos_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=16)
    return whitening.per_component(spark, whitening.apply(vectors, model), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_setsketch_near_duplicates": op1_setsketch_near_duplicates,
    "op2_virtual_slot_shards": op2_virtual_slot_shards,
    "op3_ftrl_quality": op3_ftrl_quality,
    "op4_line_rules": op4_line_rules,
    "op5_preference_format": op5_preference_format,
    "op6_matrix_bpe": op6_matrix_bpe,
    "op7_language_filters": op7_language_filters,
    "op8_token_files": op8_token_files,
    "op9_cgk_decontamination": op9_cgk_decontamination,
    "op10_wrapper_text": op10_wrapper_text,
    "op11_turn_repair": op11_turn_repair,
    "op12_token_counts": op12_token_counts,
    "op13_lanczos_whitening": op13_lanczos_whitening,
}

ORACLES: dict[str, str] = {
    "op1_setsketch_near_duplicates": setsketch.ORACLE,
    "op4_line_rules": line_rules.oracle_sql(),
    "op5_preference_format": preference.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
}
