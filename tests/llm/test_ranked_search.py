import math
import random
import re
from collections import Counter

import pytest

from quarryflow.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    count, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(found, sizes):
            m = 25 + 75 * n * count // length if length else 25
            value = lambda t: math.floor(1000 * math.log((2.0 * count + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))  # noqa: E731, B023
            if (score := sum(value(t) for t in terms(text) if t in c)) > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("Ka", "lo", "ÉT", "9x", "ß") for b in ("na", "RE", "2", "é")] + ["common"] * 30
    text = lambda n: "".join(rnd.choice(words) + rnd.choice((" ", ", ", "\n", "_", "-", "\x00")) for _ in range(n))
    docs = [(k, text(rnd.choice((1, 3, 20, 200)))) for k in range(300)]
    docs += [docs[5], (5, docs[6][1]), (None, docs[7][1]), (None, docs[7][1]), (400, None), (401, ""), (402, " .;"), (403, "common " * 40_000)]
    docs += [(500 + k, docs[9][1]) for k in range(30)]  # ties across the k-th place
    items = [(k, text(rnd.choice((1, 2, 8, 25)))) for k in range(25)] + [(30, docs[9][1]), (30, docs[9][1]), (31, None), (32, "absent terms"), (33, "common"), (None, "Kana kana")]
    return docs, items


@pytest.mark.parametrize(("head", "asked"), [(50, 1 << 24), (1, 0), (10, 1)])
def test_against_all_scores(spark, monkeypatch, tables, head, asked):
    monkeypatch.setattr(R, "ASKED_BYTES", asked)
    docs, items = tables
    d = spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, row int, term string").repartition(7)
    q = spark.createDataFrame([(*r, 1, "c") for r in items], "item_id long, text string, g int, item string").repartition(3)
    got = R.search(d, q, head=head)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_few_results_and_empty_tables(spark, tables):
    docs, items = tables
    kind = "doc_id long, text string"
    d, q = spark.createDataFrame(docs[:60], kind), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 3, 100):
        assert sorted((tuple(r) for r in R.search(d, q, k=k, head=2).collect()), key=str) == brute(docs[:60], items, k)
    assert R.search(d.limit(0), q).collect() == [] and R.search(d, q.limit(0)).collect() == []
    assert R.search(spark.createDataFrame([(1, None), (2, "")], kind), q).collect() == []


def test_terms_are_those_of_the_pattern():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(chr(rnd.choice((rnd.randrange(0, 128), rnd.randrange(128, 0x300), 0x2028, 0x1F600, 0x130))) for _ in range(60))
        assert [t.decode() for t in R.as_terms(text.encode())] == terms(text)
