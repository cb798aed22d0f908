from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np

from quarryflow.llm import whitening as W
from quarryflow.llm.queries import QUERIES

KIND = "vec_id long, embedding array<float>, x string, n int"


def brute(rows, k=4):
    """Exact counts and deviations in whole numbers, components by numpy's symmetric eigenvalues."""
    usable = [(i, [floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = {}
    for i, x in usable:
        apart = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        for j in range(k):
            out[i, j + 1] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), apart @ q[:, j] / np.sqrt(e[j]), e[j] / np.trace(centred.T @ centred / n))
    return out


def check(got, want):
    assert {(r[0], r[1]) for r in got} == set(want) and len(got) >= len(want)
    assert all((r["n"], r["deviation"]) == want[r[0], r[1]][:2] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append((r["whitened"], want[r[0], r[1]][2]))
        assert abs(r["explained"] / want[r[0], r[1]][3] - 1) < 1e-9 and r["identity_error"] < 1e-9
    for pairs in by.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7 * np.abs(b).max()


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(7, 7)) * np.array([9, 5, 3, 2, 1, 0.5, 0.1])[:, None]
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=7) @ mix + 2]) for k in range(90)]
    rows += [(200 + k, rows[3][1]) for k in range(40)]  # copies count once in the fit
    bad = [(300, None), (301, []), (302, [1.0] * 6 + [None]), (303, [float("nan")] * 7), (304, [float("inf")] + [0.0] * 6), (305, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "clash", 3) for r in [*rows, *bad, rows[0]]], KIND).repartition(5)
    got = W.whiten(df).collect()
    check(got, brute(rows))
    assert len(got) == 4 * (len(rows) + 1)


def test_fewer_components_than_four(spark):
    line = [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)]
    got = W.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-9
    same = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    empty = W.whiten(same)
    assert empty.collect() == [] and W.whiten(same.limit(0)).schema.names == empty.schema.names == W.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).schema.names


def test_deviations_beyond_a_long(spark):
    rows = [(1, [1e7, 0.0]), (2, [-1e7, 3.0]), (3, [5.0, 1e7])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[int(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(rows, x)}


def test_the_query_over_the_whole_table(spark):
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001")
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), brute(rows))
