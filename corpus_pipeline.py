"""A training corpus from the table of documents, in five stages.

Each stage works on all documents that the one before has kept. What a stage returns is written as Parquet in the shared folder and
read again as the next one's input, so a lost executor costs a part of one stage. All stages but the last return the columns
of the documents table; the last one adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, contamination, line_rules, quality_model, setsketch
from wardline.llm.queries import tokenizer_file, tokenizer_pattern
from wardline.session import work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that they remove."""
    judged = line_rules.judge(docs).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        judged = judged.withColumn(
            "n_chars", F.when(F.col("n_lines_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
            .otherwise(F.col("n_chars")))
    return judged.select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least the rule; the model learns from the labelled rows of the whole table."""
    model = quality_model.fit(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"),
        quality_model.fold("doc_id", 5) != 0)
    scored = quality_model.score(docs, model, name="__score")
    return scored.filter(F.col("__score") >= quality_model.RULE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return setsketch.deduplicate(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, their number, and the bytes that the ids decode to, as a checksum."""
    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern()
    found = bpe.encode(docs, path, pattern).withColumn("n_tokens", F.size("ids").cast("long"))
    back = bpe.decode(found.withColumn("__ids", F.col("ids")), path, pattern, ids_column="__ids", name="__decoded")
    return back.withColumn("decoded_sha256", F.sha2("__decoded", 256)).drop("__decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# The classifier's fit, the sketches and the encoder can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
