import random
import re

import numpy as np

from quarryflow.llm import ngram_join as N

from .conftest import found

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), 1 << 60), i)
    return sorted(((i, len(sets[k]), low.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark, corpus, nothing, monkeypatch):
    monkeypatch.setattr(N, "GROUP_BLOCK", 3)
    rnd = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    for _ in range(50):
        base = [f"w{rnd.randrange(40)}" for _ in range(rnd.choice([3, 5, 6, 8, 10, 15, 25, 60, 200]))]
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, 2 + len(w) // 25)):
                k = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[k] = f"w{rnd.randrange(40)}"
                else:
                    w.insert(k, "x")
            rows.append((1000 + len(rows), " ".join(w)))
    rows += [(9000 + k, t) for k, t in enumerate(["A b", "b a", "a B c d", "é x Y z w", "é X y z w", "É x y z w"])]
    got = found(N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute(rows) and len({r[2] for r in got}) < len(got) - 50
    assert N.jaccard_components(nothing).count() == 0


def test_sketches_never_rule_a_link_out():
    rng, rule = np.random.default_rng(3), N.Rule()
    for n in (3, 4, 7, 20, 63, 64, 65, 300):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for drop in range(min(n - 1, n // 4 + 2)):
            a, b = np.unique(base), np.unique(base[drop:])
            linked = 100 * len(b) >= 75 * len(a)
            bits = [N.sketch(x, N.band_of(len(x))) for x in (a, b)]
            if linked:
                assert N._within(rule, *bits, len(a), len(b))
                table = np.zeros(1 << N.COUNT_BITS, np.uint8)
                if len(a) != len(b):
                    assert set(N.keys(a, table, rule).tolist()) & set(N.keys(b, table, rule).tolist())
