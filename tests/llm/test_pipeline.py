import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryflow.llm import line_dedup


def test_stages_one_by_one(spark, corpus, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = corpus.select("doc_id", "text", "lang", "source")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        if name != "bpe_tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    rows = {k: v.collect() for k, v in seen.items()}
    assert not {900, 901, 902, 903} & {r["doc_id"] for r in rows["language_id"]} and 904 in {r["doc_id"] for r in rows["language_id"]}
    assert sum(r["n_removed"] for r in line_dedup.dedup_lines(seen["line_dedup"]).collect()) == 0
    ids = Counter(r["doc_id"] for r in rows["near_duplicates"])
    assert max(ids.values()) == 1 and set(ids) <= {r["doc_id"] for r in rows["line_dedup"]}
    copies = Counter(r["doc_id"] for r in rows["source_mix"])
    assert set(copies) <= set(ids) and max(copies.values()) <= 2
    texts = {r["doc_id"]: r["text"] for r in rows["source_mix"]}
    assert Counter(r["doc_id"] for r in rows["bpe_tokens"]) == copies
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows["bpe_tokens"])


def test_run_writes_every_stage(spark, corpus, tmp_path):
    pytest.importorskip("public_tokenizers")
    corpus.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_only_similar_rows_go_whatever_their_ids(spark):
    words = [f"w{k}" for k in range(60)]
    near = words[:59] + ["other"]
    rows = [(1, " ".join(words)), (5, " ".join(near)), (5, "something else altogether with seven words"), (None, " ".join([*words[:30], "x", *words[31:]])), (7, " ".join(words)), (8, None), (9, "ab"), (9, "ab")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "unused").collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[5], rows[6]], key=str)


def test_columns_of_any_name(spark, corpus):
    pytest.importorskip("public_tokenizers")
    odd = {"score": "a", "lang_pred": "b", "copies": 3, "key": "c", "copy": 4, "n_lines": 5, "n_removed": 6, "th": "d", "size": 7, "held_out": True}
    docs = corpus.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars"), *(F.lit(v).alias(c) for c, v in odd.items()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "unused")
        rows = docs.collect()
        assert rows and all(r[c] == v for r in rows for c, v in odd.items()) and all(r["n_chars"] == len(r["text"]) for r in rows), name


def test_repeated_rows_with_columns_of_any_type(spark):
    rows = [(1, "one two three four five six", {"a": 1}, ({"b": [1]},)), (1, "one two three four five six", {"a": 2}, None), (2, "something else", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, more struct<m:map<string,array<int>>>")
    got = corpus_pipeline.near_duplicates(spark, docs, "unused")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2]
