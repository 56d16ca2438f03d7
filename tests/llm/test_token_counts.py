import random

import public_tokenizers
import pytest
from conftest import SF, rows
from llm.cases import EDGES
from tokenizers import Tokenizer

from wardline.llm import token_counts
from wardline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_query_as_the_library(spark, library):
    given = rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    want = [(i, len((t or "").encode()), n := count(library, t), n > 2048) for i, t in given]
    assert rows(QUERIES["op12_token_counts"](spark, SF)) == sorted(want, key=repr)


@pytest.mark.parametrize("head", [0, 400, token_counts.HEAD])
def test_odd_texts_as_the_library(spark, library, monkeypatch, head):
    """Whatever part of the pre-tokens is broadcast, and however often words are forgotten."""
    r = random.Random(4)
    letters = "ab A\n\t  \x0b\x0c\r\x85\xa0 éÉΣσςİıßǅ日1²½'s'T'LL.,!\x1c\u0301\u0308A\u030aK한ᄀ각🎉"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "a<|endoftext|>b <|startoftext|>x", "<|ENDOFTEXT|>", "don't I'LL we'Re", "x" * 5000, "e\u0301\u0144x", " \u0301",
              "ab" * 3000 + "!" * 3000, "word " * 40_000, "<|endoftext|>" * 200, "=" * 100 + " " + "=" * 100]
    texts += ["=" * 80] * 300
    monkeypatch.setattr(token_counts, "HELD", 300)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = token_counts.count_tokens(frame, PATH, head=head)
    assert rows(found) == sorted(((i, len((t or "").encode()), count(library, t)) for i, t in enumerate(texts)), key=repr)


def test_pieces_are_counted_once_for_each_pretoken(spark, library):
    frame = spark.createDataFrame([(1, "Don't don't, DON'T"), (2, "don , <|endoftext|>"), (3, None)], "doc_id long, text string")
    found = {r["pretoken"]: (r["times"], r["pieces"]) for r in token_counts.vocabulary(frame, PATH).collect()}
    assert found == {"don": (4, 1), "'t": (3, 1), ",": (2, 1), token_counts.WHOLE + "<|endoftext|>": (1, 1)}
    assert token_counts.head_of(token_counts.vocabulary(frame, PATH), 2) == {"don": 1, "'t": 1}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="another kind"):
        token_counts.Cutter(public_tokenizers.path("byte_bpe_50k.json"))


def test_edges(spark, library, clashing):
    found = token_counts.count_tokens(clashing.withColumn("n_tokens", clashing.doc_id).withColumn("key", clashing.text), PATH)
    want = [(i, len((t or "").encode()), count(library, t)) for i, t, *_ in EDGES]
    assert rows(found) == sorted(want, key=repr)
    assert token_counts.count_tokens(clashing.limit(0), PATH).collect() == []
