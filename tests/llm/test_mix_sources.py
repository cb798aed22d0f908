import itertools
import random
from collections import Counter

import numpy as np

from quarryflow.llm import mix_sources as M

from .conftest import found


def test_targets_stop_at_the_limit():
    mix = M.Mix()
    assert M.targets([100, 100, 100], mix) == [200.0, 2 * 250 / 3, 250 / 3]
    assert M.targets([], mix) == [] and M.targets([0, 0], mix) == [0.0, 0.0]
    rnd = random.Random(1)
    for _ in range(100):
        sizes = [rnd.randrange(200) for _ in range(rnd.randrange(1, 9))]
        got = M.targets(sizes, mix)
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
        free = [t / w for t, s, w in zip(got, sizes, itertools.cycle((5, 2, 1))) if t < 2 * s - 1e-9]
        assert not free or max(free) - min(free) < 1e-6


def test_subset_sum_is_as_near_as_any_subset():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = rnd.sample(range(1, 20), rnd.randrange(1, 5))
        counts = [rnd.randrange(4) for _ in lengths]
        goal = rnd.randrange(60)
        got = M.subset_sum(lengths, counts, goal)
        assert all(0 <= g <= c for g, c in zip(got, counts))
        sums = {sum(n * k for n, k in zip(lengths, pick)) for pick in itertools.product(*(range(c + 1) for c in counts))}
        assert abs(sum(n * g for n, g in zip(lengths, got)) - goal) == min(abs(s - goal) for s in sums)


def test_large_budgets_come_near():
    got = M.fit_counts([3, 50, 70000, 200001], [5, 1000, 900, 4], 33_333_333.4)
    assert abs(3 * got[0] + 50 * got[1] + 70000 * got[2] + 200001 * got[3] - 33_333_333) <= 25


def test_fitted_counts_are_as_near_as_any_subset():
    rnd = random.Random(6)
    total = lambda lengths, take: sum(n * t for n, t in zip(lengths, take))
    assert total([100000, 150000, 200000], M.fit_counts([100000, 150000, 200000], [1, 1, 1], 250000)) == 250000
    assert total([90000, 100000], M.fit_counts([90000, 100000], [1000, 1000], 300000)) == 300000
    assert total([3_000_000, 5_000_000], M.fit_counts([3_000_000, 5_000_000], [40, 40], 121_000_000)) == 121_000_000
    for most in (30, 300_000):
        for _ in range(40):
            lengths = rnd.sample(range(1, most), rnd.randrange(1, 6))
            counts = [rnd.randrange(1, 4) for _ in lengths]
            goal = rnd.randrange(total(lengths, counts) + 1)
            got = M.fit_counts(lengths, counts, goal)
            assert all(0 <= g <= c for g, c in zip(got, counts))
            sums = {total(lengths, pick) for pick in itertools.product(*(range(c + 1) for c in counts))}
            assert abs(total(lengths, got) - goal) == min(abs(s - goal) for s in sums)


def nearest(lengths, counts, goal):
    """How far the nearest sum is: all choices of the lengths but the last, with the best count of that one."""
    sums = np.zeros(1, np.int64)
    for n, c in list(zip(lengths, counts))[:-1]:
        sums = np.unique(sums[:, None] + n * np.arange(c + 1))
    k = np.clip((goal - sums) // lengths[-1], 0, counts[-1])
    return min(int(np.abs(sums + lengths[-1] * m - goal).min()) for m in (k, np.minimum(k + 1, counts[-1])))


def test_few_long_documents_are_as_near_as_any_subset():
    rnd = random.Random(11)
    total = lambda lengths, take: sum(n * t for n, t in zip(lengths, take))
    cases = [([400009, 700001, 900017], [500] * 3, 400123457), ([5000001, 7000003, 9000007], [300] * 3, 2_100_001_099), ([1000003, 1500007, 2000011], [200] * 3, 300_002_100)]
    for _ in range(300):
        lengths = [rnd.choice((1, 1, 6)) * n for n in rnd.sample(range(1, rnd.choice((40, 4000))), rnd.randrange(1, 5))]
        if len(set(lengths)) == len(lengths):
            counts = [rnd.randrange(7) for _ in lengths]
            cases.append((lengths, counts, rnd.randrange(total(lengths, counts) + 2)))
    for lengths, counts, goal in cases:
        got = M.fit_counts(lengths, counts, goal)
        assert all(0 <= g <= c for g, c in zip(got, counts))
        assert abs(total(lengths, got) - goal) == nearest(lengths, counts, goal)
    got = M.adjusted([3, 8], [4, 4], [4, 4], 5)  # from above the goal
    assert total([3, 8], got) in (6,) and got == [2, 0]
    assert M.adjusted([5], [2], [1], 40) == [2] and M.adjusted([], [], [], 3) == []


def test_many_lengths_end_at_an_exact_sum():
    rnd = random.Random(12)
    lengths = rnd.sample(range(1, 40000), 20000)
    counts = [rnd.randrange(1, 50) for _ in lengths]
    goal = sum(n * c for n, c in zip(lengths, counts)) * 37 // 100 + 5
    assert sum(n * t for n, t in zip(lengths, M.fit_counts(lengths, counts, goal))) == goal
    lengths = rnd.sample(range(20000, 80000), 500)  # no short ones
    goal = sum(lengths) // 3
    assert sum(n * t for n, t in zip(lengths, M.fit_counts(lengths, [1] * 500, goal))) == goal


def test_many_sources(spark):
    rows = [(k, "w " * (1 + k % 7), f"host{k % 50:03d}") for k in range(400)]
    got = M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    names = sorted(size)
    want = dict(zip(names, M.targets([size[n] for n in names], M.Mix())))
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in got)


def test_whole_mix(corpus, nothing):
    rows = corpus.collect()
    got = found(M.mix_sources(corpus))
    assert len(got) == len(rows) and got == found(M.mix_sources(corpus.repartition(3)))
    size, taken = Counter(), Counter()
    for _, source, n, total, target, t, copies in got:
        size[source] += n
        taken[source] += t
        assert t == n * copies and copies in (0, 1, 2)
    for _, source, _, total, target, _, _ in got:
        assert total == size[source] and abs(taken[source] - target) <= 1.5
    assert M.mix_sources(nothing).count() == 0
