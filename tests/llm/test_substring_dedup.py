import hashlib
from collections import Counter

import numpy as np

from quarryflow.llm import substring_dedup as S

from .conftest import found


def brute(rows, window=35):
    docs = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for (i, _), d in zip(rows, docs):
        gone = [False] * len(d)
        for k in range(len(d) - window + 1):
            if seen[tuple(d[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(d), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(corpus, nothing, spark):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    rows += [(700, "a " * 300), (701, "a b " * 100), (702, " ".join(map(str, range(34)))), (703, " ".join(map(str, range(34)))), (704, " ".join(map(str, range(35)))), (705, "x " + " ".join(map(str, range(35))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = found(S.dedup_substrings(df, with_text=False))
    assert got == brute(rows) and sum(r[2] for r in got) > 500
    texts = {r["doc_id"]: r["text"] for r in S.dedup_substrings(df).collect()}
    assert texts[704] == "" and texts[705] == "x" and texts[702] == " ".join(map(str, range(34)))
    assert S.dedup_substrings(nothing).count() == 0


def test_factors_are_greedy_and_equal_their_reference(spark):
    words = [f"w{k}" for k in range(3000)]
    docs = {1: words[:2000], 2: words[300:1500] + ["cut"] + words[500:900], 3: ["own"] * 10 + words[1990:2600], 4: words[2100:2500], 5: None}
    df = spark.createDataFrame([(k, " ".join(w) if w else None) for k, w in docs.items()], "doc_id long, text string").repartition(3)
    rows = S.relative_factors(df).collect()
    for r in rows:
        if r["reference_id"] is not None:
            own = docs[r["doc_id"]][r["start"] : r["start"] + r["n_words"]]
            assert len(own) >= 35 and own == docs[r["reference_id"]][r["reference_start"] : r["reference_start"] + r["n_words"]]
    of = lambda k: [r for r in rows if r["doc_id"] == k and r["reference_id"] is not None]
    assert max(r["n_words"] for r in of(2)) > 900 and max(r["n_words"] for r in of(4)) > 250 and len(of(4)) < 4


def test_borders_depend_on_content_only():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    whole = S.least_positions(x, 28)
    for a, n in ((0, 100), (17, 900), (4000, 1000)):
        assert (S.least_positions(x[a : a + n], 28) + a == whole[a : a + n - 27]).all()
