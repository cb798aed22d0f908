import gc
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryflow.llm import language_crf as C


def brute(scores, transition):
    n, labels = scores.shape
    p = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        w = np.exp(sum(scores[i, y[i]] for i in range(n)) + sum(transition[y[i], y[i + 1]] for i in range(n - 1)))
        for i in range(n):
            p[i, y[i]] += w
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [2, 3, 128])
def test_marginals(block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(block)
    lengths = np.array([5, 1, 7, 2, 0, 3])
    scores, transition = rng.normal(size=(18, 3)), rng.normal(size=(3, 3))
    got, at = C.marginals(scores, lengths, transition), 0
    for n in lengths[lengths > 0]:
        assert np.allclose(got[at : at + n], brute(scores[at : at + n], transition))
        at += n


def test_gradient_of_transitions_is_exact():
    rng = np.random.default_rng(1)
    scores, transition, pairs = rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), np.zeros((2, 2))
    C.marginals(scores, np.array([4, 2]), transition, pairs)

    def log_z(t):
        return sum(np.log(sum(np.exp(sum(s[i, y[i]] for i in range(len(s))) + sum(t[y[i], y[i + 1]] for i in range(len(s) - 1))) for y in itertools.product(range(2), repeat=len(s)))) for s in (scores[:4], scores[4:]))

    for i, j in itertools.product(range(2), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert abs((log_z(transition + step) - log_z(transition - step)) / 2e-5 - pairs[i, j]) < 1e-6


def test_code_switching_and_rejects(spark):
    en, xx = "the house and garden with water", "zork blim vrax quun drek smol"
    rows = [(f"{en} {w}", "en") for w in en.split()] + [(f"{xx} {w}", "xx") for w in xx.split()]
    model = C.fit(rows)
    labelled = C.Labeller(model).label_words("the house zork vrax 12 garden")
    assert [x[1] for x in labelled] == ["en", "en", "xx", "xx", "en"]
    docs = spark.createDataFrame([(k, t, lang, "s") for k, (t, lang) in enumerate(rows)] + [(90, None, None, "s"), (91, "12 ?!", "en", "s"), (92, "zork", None, "s"), (None, "the", "xx", "s")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in C.identify(docs.withColumn("held_out", C.held_out()), allowed=~F.col("held_out"), keep=("held_out",)).collect()}
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and got[91]["score"] == 0
    assert got[92]["lang_pred"] == "xx" and got[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    none = C.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and C.identify(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = C.identify(docs.withColumn("held_out", C.held_out()), allowed=~F.col("held_out"), keep=("held_out",)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 150 and right / n > 0.95


def test_words_of_a_batch_go_with_it(monkeypatch):
    monkeypatch.setattr(C, "BATCH_WORDS", 50)
    labeller = C.Labeller(C.fit([("the house and the garden", "en"), ("das haus und der garten", "de")], 100, 2))
    gc.collect()
    gc.disable()
    try:
        labeller.label(["das haus qqmarker the garden"] * 100)
        assert not [x for x in gc.get_objects() if isinstance(x, dict) and "qqmarker" in x]
    finally:
        gc.enable()
