import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarryflow.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(id, hash) -> numbers of the lines that have an earlier line of Jaccard 3/4 or more."""
    lines, gone = [], defaultdict(set)
    for i, text, h in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            if words := frozenset(WORD.findall(line)):
                if any(4 * len(words & w) >= 3 * len(words | w) for w in lines):
                    gone[(i, h)].add(k)
                lines.append(words)
    return gone


def test_against_brute_force(corpus, nothing):
    docs = corpus.withColumn("h", F.xxhash64("text"))
    want = brute([(r["doc_id"], r["text"], r["h"]) for r in docs.collect()])
    before = Counter((r["doc_id"], r["h"], r["text"]) for r in docs.collect())
    got = L.dedup_lines(docs).collect()
    assert len(got) == docs.count() and sum(r["n_removed"] for r in got) > 50
    texts = {(i, h): t for i, h, t in before}
    for r in got:
        text = texts[(r["doc_id"], r["h"])]
        cut = want[(r["doc_id"], r["h"])]
        lines = text.split("\n") if text is not None else []
        assert r["n_lines"] == len(lines) and r["n_removed"] == len(cut)
        assert r["text"] == (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in cut))
    assert L.dedup_lines(nothing).count() == 0


def test_many_near_copies_and_short_lines(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(k, base.replace(f"w{k % 30}", f"v{k}")) for k in range(120)] + [(500 + k, x) for k, x in enumerate(("a b c", "a b c d", "c b a", "b", "a", "a b"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    want = brute([(r["doc_id"], r["text"], r["h"]) for r in docs.collect()])
    got = {(r["doc_id"], r["h"]): r["n_removed"] for r in L.dedup_lines(docs).collect()}
    assert {k: n for k, n in got.items() if n} == {k: len(v) for k, v in want.items() if v}


def test_ids_of_any_kind(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [(k, " ".join([*base[: k % 20], f"v{k}", *base[k % 20 + 1 :]])) for k in range(40)]
    for kind, ids in (("long", lambda k: k * 7 - 90), ("long", lambda k: 10**15 if k == 39 else k), ("string", lambda k: f"{(k * 7) % 40:03}"), ("double", lambda k: float("nan") if k == 3 else k / 3), ("double", lambda k: float("inf") if k == 5 else -k * 1.5)):
        docs = spark.createDataFrame([(ids(k), t) for k, t in rows], f"doc_id {kind}, text string").withColumn("h", F.xxhash64("text"))
        place = lambda r: (r["doc_id"] != r["doc_id"], 0 if r["doc_id"] != r["doc_id"] else r["doc_id"])
        want, seen = 0, []
        for r in sorted(docs.collect(), key=place):
            words = frozenset(r["text"].split())
            want += any(4 * len(words & w) >= 3 * len(words | w) for w in seen)
            seen.append(words)
        assert sum(r["n_removed"] for r in L.dedup_lines(docs).collect()) == want > 30, kind


def test_no_python_in_the_plan(corpus):
    plan = L.dedup_lines(corpus)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def written(monkeypatch, docs):
    """The rows of the tables that the join writes, by name."""
    tables, write = {}, L.Scratch.write

    def kept(self, df, name):
        tables[name] = (out := write(self, df, name)).collect()
        return out

    monkeypatch.setattr(L.Scratch, "write", kept)
    L.dedup_lines(docs)
    return tables


def test_copies_are_not_split_into_words(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"one two three four {k % 4}\nfive") for k in range(40)], "doc_id long, text string")
    tables = written(monkeypatch, docs)
    assert len(tables["words"]) == len(tables["stands"]) == 5 and len(tables["lines"]) == 80


def test_sketches_tell_long_strangers_apart(spark, monkeypatch):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(rnd.sample([f"w{i}" for i in range(3000)], n))) for k, n in enumerate((70, 94) * 60)], "doc_id long, text string")
    tables = written(monkeypatch, docs)
    rows = spark.createDataFrame(tables.get("stands", tables["lines"]), "id long, th long, at int, h long, h2 long, n int, parity long, odd long, first array<long>")
    near = L._near(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    assert rows.alias("a").join(rows.alias("b"), (F.col("a.n") < F.col("b.n")) & near).count() == 0


def test_more_repeated_lines_than_can_be_broadcast(corpus, monkeypatch):
    found = lambda: sorted((str(r["doc_id"]), r["text"] or "", r["n_removed"]) for r in L.dedup_lines(corpus).collect())
    want = found()
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert found() == want and sum(n for _, _, n in want) > 50
