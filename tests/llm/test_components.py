import random

from quarryflow.llm.common import Scratch
from quarryflow.llm.components import components


def test_chains_stars_and_cycles(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    rnd.shuffle(edges)
    up = list(range(500))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert set(got) == {x for e in edges for x in e if e[0] != e[1]}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (root(a) == root(b))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
