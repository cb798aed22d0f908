import numpy as np

from quarryflow.llm import vector_join as V

from .conftest import found


def brute(rows, cosine=0.9):
    ok = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    up, n = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ok:
        for b in ok:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[a] += 1
                    up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), 1 << 60), i)
    return sorted(((i, n[k], low.get(root(k)), i == low.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "INTERVAL", 24)
    monkeypatch.setattr(V, "LEAF", 7)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(18):
        c = rng.normal(size=8)
        rows += [(len(rows) + j, [float(x) for x in c + rng.normal(size=8) * s]) for j, s in enumerate(rng.choice([0, 0.1, 0.4], rng.integers(1, 30)))]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0, None]), (5004, [float("nan")] * 8), (5005, [1.0, 2.0]), (5006, [1.0, 2.1]), (3, rows[3][1]), (5007, [1e-300] * 8), (5008, [1.0] * 8)]
    for kind in ("double", "float"):
        df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, vid string").repartition(4)
        stored = [(r[0], r[1] if r[1] is None else list(r[1])) for r in df.select("vec_id", "embedding").collect()]
        got = found(V.cosine_links(df))
        assert got == brute(stored) and sum(r[1] for r in got) > 100
    assert V.cosine_links(df.limit(0)).count() == 0 and V.cosine_links(df.where("vec_id = 5002")).first()["n_links"] == 0
