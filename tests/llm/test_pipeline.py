import base64
import hashlib

import corpus_pipeline
import duckdb
import public_tokenizers
import tiktoken
from conftest import SF, rows
from llm.cases import brute_components
from llm.test_contamination import brute
from llm.test_models import plain_score

from wardline.llm import quality_model
from wardline.llm.queries import ORACLES
from wardline.session import work_path


def test_stages_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_dedup", "decontamination", "encoding"]


def test_each_stage_against_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    ruled, scored, single, clean, encoded = kept[1:]
    assert all(k.columns == docs.columns for k in kept[:-1])

    # Stage 1 by the SQL twin, which has its own expressions.
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    judged = con.execute(f"SELECT doc_id, clean_chars FROM ({ORACLES['op4_line_rules']}) WHERE kept").fetchall()
    assert rows(ruled.selectExpr("doc_id", "cast(char_length(text) AS long)")) == sorted(judged, key=repr)
    given = dict(rows(docs, "doc_id", "text"))
    for i, text in rows(ruled, "doc_id", "text"):
        lines = iter((given[i] or "").split("\n"))
        assert all(line in lines for line in text.split("\n"))
    assert rows(ruled.filter("n_chars <> char_length(text)")) == []

    # Stage 2 feature by feature.
    model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality_model.fold("doc_id", 5) != 0)
    assert rows(scored) == sorted((r for r in rows(ruled) if plain_score(model, r[1]) >= 0.3), key=repr)

    want = brute_components(rows(scored, "doc_id", "text"), 5, 80)
    assert rows(single, "doc_id") == sorted(((i,) for i, (_, c) in want.items() if i == c), key=repr)

    # Stage 4 by comparing every window with every item.
    bench = rows(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    texts = rows(single, "doc_id", "text")
    dirty = {d for d, *_ in brute(texts, bench)}
    exact = {d for d, t in texts for _, b in bench if b in t}
    gone = {d for d, _ in texts} - {d for d, in rows(clean, "doc_id")}
    assert exact <= gone <= dirty and len(gone) >= 0.98 * len(dirty)
    assert rows(clean) == [r for r in rows(single) if r[0] not in gone]

    # Stage 5 by the library.
    ranks = {base64.b64decode(a): int(b) for a, b in map(
        bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert rows(encoded, *docs.columns) == rows(clean)
    for r in encoded.collect():
        assert r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_hard_rows_and_empty_tables(spark, clashing):
    for frame in (clashing, clashing.limit(0)):
        folder = work_path(spark, "hard")
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(8, 1), (None, 0), (10, None)], "doc_id long, quality int").write.parquet(
            f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert set(frame.columns) - {"ids"} <= set(out.columns)
        # Of the hard rows only those with enough different words stay.
        assert out.count() <= 1
