import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF, rows
from llm.cases import EDGES
from tokenizers import Tokenizer

from wardline.llm import bpe, token_files
from wardline.llm.queries import QUERIES
from wardline.session import work_path

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Ranks(PATH, public_tokenizers.PATTERN)


def test_random_texts_as_the_library(own, library):
    r = random.Random(1)
    letters = "ab A\n\t   é日1²'s.,!'t\x1c\x0b\r\x85\xa0🎉"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["", None, " ", "  ", "a\n b", "a \n  b ", "ha" * 2000, "the" * 300 + "é" * 300, "<|endoftext|> x", "x" * 5000]
    units = bpe.Units(own.encode_units)
    for low in range(0, len(texts), 97):
        part = texts[low:low + 97]
        flat, count = units.texts(part)
        found = np.split(flat, np.cumsum(count)[:-1])
        assert [f.tolist() for f in found] == [library.encode_ordinary(t or "") for t in part]


def test_long_pieces_by_matrix_and_heap_alike(own, monkeypatch):
    r = random.Random(2)
    pieces = ["".join(r.choice("abehnrt") for _ in range(r.randint(2, 250))).encode() for _ in range(300)]
    plain = own.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "LONGEST", 1)
    heaped = own.encode_pieces(pieces)
    assert plain.size.tolist() == heaped.size.tolist()
    every = np.arange(len(pieces)), np.ones(len(pieces), np.int64)
    assert (plain.joined(*every).flat == heaped.joined(*every).flat).all()


def test_query_as_the_library(spark, library):
    docs = dict(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want = []
    for i, text in docs.items():
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows(QUERIES["op6_matrix_bpe"](spark, SF)) == sorted(want, key=repr)


def test_round_trip_of_edges(spark, clashing):
    pattern = public_tokenizers.PATTERN
    found = bpe.decode(bpe.encode(clashing, PATH, pattern), PATH, pattern)
    got = sorted((bytes(r.decoded), r.text or "") for r in found.select("decoded", "text").collect())
    assert got == sorted(((t or "").encode(), t or "") for _, t, *_ in EDGES)
    assert bpe.decode(bpe.encode(clashing.limit(0), PATH, pattern), PATH, pattern).collect() == []


def test_variable_length_code():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        rank = r.integers(0, 2 ** r.integers(1, 33, n, dtype=np.int64), dtype=np.int64).astype(np.uint32)
        control, data = token_files.packed(rank)
        assert len(control) == -(-n // 4)
        back = token_files.unpacked(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert (back == rank).all()


def test_file_round_trip():
    ids = np.array([5, 5, 5, 70_000, 2, 9, 2, 2], np.int32)
    blob = token_files.file_bytes([7, None, -1], np.array([5, 2, 1]), ids)
    doc_ids, counts, back = token_files.file_content(blob)
    assert (doc_ids, counts.tolist(), back.tolist()) == ([7, None, -1], [5, 2, 1], ids.tolist())
    assert token_files.file_content(token_files.file_bytes([], np.zeros(0, int), np.zeros(0, np.int32)))[0] == []
    with pytest.raises(ValueError, match="not a token file"):
        token_files.file_content(b"xxxx" + blob[4:])
    with pytest.raises(ValueError, match="cut short|smaller"):
        token_files.file_content(blob[:-1])


def library_rows(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 20_000)
    monkeypatch.setattr(token_files, "PART_BYTES", 100_000)
    texts = rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    texts.sort(key=lambda r: r[0])
    found = QUERIES["op8_token_files"](spark, SF)
    assert sorted(map(tuple, found.collect())) == library_rows(texts)


def test_random_texts_as_the_tokenizers_library(monkeypatch):
    """Special strings included, and whatever is forgotten between blocks."""
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    monkeypatch.setattr(bpe, "LONGEST_WORD", 30)
    monkeypatch.setattr(token_files, "_units", {})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(6)
    words = ["a", "the", "The,", "x.", "don't", "<|endoftext|>", "<|endoftext|>b", "a<|endoftext|>,", "<|end", "日本", "é!?", "12", "\n", "\t", "",
             "ab" * 40, "!!", "'s"]
    texts = [r.choice(("", " ", "x")) + " ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts += ["a <|endoftext|> b", None, "", "q" * 3000, "q" * 100 + " r"]
    units = token_files._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for low in range(0, len(texts), 41):
        part = texts[low:low + 41]
        flat, count = units.texts(part)
        found = [f.tolist() for f in np.split(flat, np.cumsum(count)[:-1])]
        assert found == [library.encode(t or "", add_special_tokens=False).ids for t in part]
    assert units.young.count + units.old.count < 500


def test_special_strings_in_files(spark):
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "plain")]
    path = work_path(spark, "tokens")
    files = token_files.write_files(
        spark.createDataFrame(texts, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), path)
    found = token_files.read_files(files, path)
    ids = dict(tuple(r) for r in found.select("doc_id", "ids").collect())
    assert (ids[1], ids[2]) == ([64, 220, 50256, 275, 2], [50256, 2])
    assert sorted(map(tuple, token_files.checksums(found).collect())) == library_rows(texts)


def test_token_files_of_edges(spark, clashing):
    path = work_path(spark, "tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write_files(clashing, tokenizer, path)
    found = sorted(map(tuple, token_files.checksums(token_files.read_files(files, path)).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in EDGES), key=lambda i: -1 if i is None else i)
    lengths = {(i, n, c) for i, _, n, c in library_rows([r[:2] for r in EDGES])}
    assert {(i, n, c) for i, _, n, c in found} == lengths
    assert [r[1] for r in found] == np.concatenate(([0], np.cumsum([r[2] for r in found])[:-1])).tolist()
    path = work_path(spark, "tokens")
    none = token_files.write_files(clashing.limit(0), tokenizer, path)
    assert token_files.checksums(token_files.read_files(none, path)).collect() == []
