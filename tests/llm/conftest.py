import pytest
from llm.cases import EDGES


@pytest.fixture(scope="session")
def edges(spark):
    """Rows that are hard: NULLs, empty and very long texts, repeated rows, and columns named like results."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(EDGES, kind)


@pytest.fixture(scope="session")
def clashing(edges):
    from pyspark.sql import functions as F

    names = ("component_id", "kept", "score", "ids", "n_words", "shard", "slot", "uid", "size", "lang_pred", "id", "start")
    for name in names:
        edges = edges.withColumn(name, F.lit("clash"))
    return edges
