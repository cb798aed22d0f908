"""Operator 1: mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source's target is its weighted share of the mix, stopped at twice
its size. Whole passes over a source come first; the rest of its budget is fitted on the counts by length: every length
gives the same fraction of its documents, rounded down, longer ones first fill up what that leaves, and bounded-knapsack
dynamic programming over documents to add and to give back makes the remaining words exact, or as near as it can. Which
documents of a length are taken is decided by a seeded hash of their ids.

The dynamic program finds the nearest sum that any choice of documents has, and looks only at sums within one longest
document of the goal. It looks ahead by one document and ends at the first choice that no other can beat, which large
sources have at once; where none exists it sees every sum in that span that can be reached. Its tables take 24 bytes a word
of the source's longest document, in units of the lengths' greatest common divisor, and 16 for each improvement of a sum.

Sources are a table too: their order is numbered by range partitions, and the level of the targets comes from sums over
them. Only the counts by length meet in one task for each source. Documents of one length are ranked in about the root of
their number of hash buckets, so no length, however common, is gathered into one task.

Defined results: null text has size 0; a null source is a source of its own, last in the order; a source without words
takes none; rows that are equal in id, source and size are interchangeable, so reruns agree; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hinted, word_count

#: Changes that the dynamic program looks at together; a bound on memory only.
CHANGES = 1 << 18


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in order; share is the mix's size over all sizes; no source exceeds most times its size."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    seed: int = 20240229


def level(budget: float, sums: Callable[[float], tuple[float, float]]) -> float:
    """Words for each unit of weight, such that the shares sum to the budget when no source exceeds its limit. sums: of a
    level, the limits of the sources that reach theirs, and the weights of the others. Levels only rise."""
    unit = 0.0
    while True:
        full, free = sums(unit)
        if not free:
            return math.inf
        higher = max(0.0, budget - full) / free
        if higher <= unit:
            return unit
        unit = higher


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Shares of the mix by weight; what exceeds a source's limit goes to the others by weight, until none exceeds it."""
    weights, limit = [w for w, _ in zip(cycle(mix.weights), sizes)], [mix.most * s for s in sizes]
    reach = lambda unit: [w * unit >= x for w, x in zip(weights, limit)]
    sums = lambda unit: (sum(x for x, r in zip(limit, reach(unit)) if r), sum(w for w, r in zip(weights, reach(unit)) if not r))
    unit = level(mix.share * sum(sizes), sums)
    return [min(w * unit, x) if x else 0.0 for w, x in zip(weights, limit)]


def adjusted(lengths: list[int], counts: list[int], take: list[int], goal: int) -> list[int]:
    """take, with documents added or given back so that the sum is as near to goal as any choice of documents comes, the
    lower sum among equals.

    Bounded knapsack over balanced changes: while the sum is at most the goal the next change adds a document, above it
    the next one gives one back, each list in its own order. Any choice can be reached so, by sums that stay within one
    longest document of the goal; what is left over when one list is used up only leads away from it. A sum needs to know
    only how far the list to give back has been used, the less the better. Each improvement is logged with the one that it
    came from."""
    now = sum(n * t for n, t in zip(lengths, take))
    adds = [(k, c - t) for k, (c, t) in enumerate(zip(counts, take)) if c > t]
    gives = [(k, t) for k, t in enumerate(take) if t]
    unit = math.gcd(*(lengths[k] for k, _ in adds + gives)) or 1
    steps = [n // unit for n in lengths]
    widest = max((steps[k] for k, _ in adds + gives), default=0)
    ahead, rest = divmod(goal - now, unit)
    low = max(min(0, ahead - widest + 1), -sum(steps[k] * n for k, n in gives))
    high = min(max(0, ahead + widest), sum(steps[k] * n for k, n in adds))
    goal_at, best_at = ahead - low, ahead - low + (2 * rest > unit)  # places of the goal and of the nearest sum there can be
    place, step = np.array([k for k, _ in gives], np.int64), np.array([steps[k] for k, _ in gives], np.int64)
    begins = np.cumsum([0] + [n for _, n in gives])
    given, begins, ends = int(begins[-1]), begins[:-1], begins[1:]
    placed, added = np.array([k for k, _ in adds], np.int64), np.array([steps[k] for k, _ in adds], np.int64)
    by_step, by_added = np.argsort(step), np.argsort(added)
    adding = -1  # the place of the length that is being added
    used = np.full(high - low + 1, given + 1, np.int32 if given < 1 << 30 else np.int64)  # given + 1: not reached
    entry = np.zeros(high - low + 1, np.int64)
    log: list[tuple[np.ndarray, np.ndarray]] = []
    logged = 0

    def found() -> bool:
        return 0 <= best_at < len(used) and used[best_at] <= given

    def improve(at: np.ndarray, to: np.ndarray, parent: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums (each once) that are now reached with less given back, and what they knew before."""
        nonlocal logged
        better = to < used[at]
        at, before = at[better], used[at[better]]
        used[at], entry[at] = to[better], np.arange(logged, logged + len(at))
        log.append((parent[better], move[better]))
        logged += len(at)
        return at, before

    def final(need: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each need the place of a size near it, and which needs are met exactly."""
        if not len(sizes):
            return np.zeros(len(need), np.int64), np.zeros(0, np.int64)
        k = order[np.minimum(np.searchsorted(sizes, need, sorter=order), len(sizes) - 1)]
        return k, np.flatnonzero(sizes[k] == need)

    def balance(at: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Gives back from improved sums above the goal, and from those that this improves; the improved ones below it."""
        below, open_ = [], [(at, before)]
        while open_ and not found():
            at, before = open_.pop()
            low_at = at[at <= goal_at]
            below.append(low_at)
            k, last = final(best_at - low_at, added, by_added)
            last = last[k[last] > adding][:1]
            if len(last):  # one more document makes the nearest sum
                k, at = k[last], low_at[last]
                improve(at + added[k], used[at], entry[at], placed[k])
                break
            more = (at > goal_at) & (used[at] < given)
            at, before = at[more], before[more]
            if not len(at):
                continue
            k, last = final(at - best_at, step, by_step)
            last = last[ends[k[last]] > used[at[last]]][:1]
            if len(last):  # one fewer makes it
                k, at = k[last], at[last]
                improve(at - step[k], np.maximum(used[at], begins[k]) + 1, entry[at], -1 - place[k])
                break
            first = np.searchsorted(begins, used[at], side="right") - 1
            n = np.maximum(np.searchsorted(begins, np.minimum(before, given), side="left") - first, 1)
            now_ = max(1, int(np.searchsorted(np.cumsum(n), CHANGES, side="right")))
            if now_ < len(at):
                open_.append((at[now_:], before[now_:]))
                at, first, n = at[:now_], first[:now_], n[:now_]
            row = np.repeat(np.arange(len(at)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            to, new = np.maximum(used[at][row], begins[k]) + 1, at[row] - step[k]
            order = np.flatnonzero(to < used[new])
            order = order[np.lexsort((to[order], new[order]))]
            order = order[np.append(True, np.diff(new[order]) != 0)] if len(order) else order
            if len(order):
                open_.append(improve(new[order], to[order], entry[at][row[order]], -1 - place[k[order]]))
        return np.unique(np.concatenate(below)) if below else at[:0]

    balance(*improve(np.array([-low]), np.array([0]), np.array([-1]), np.array([0])))
    for adding, (k, n) in enumerate(adds):
        if found():
            break
        work = np.flatnonzero(used[: max(0, goal_at + 1)] <= given)
        while n and len(work) and not found():  # the sums that this length's last document did not improve have added it
            work = balance(*improve(work + steps[k], used[work], entry[work], np.full(len(work), k)))
            n -= 1
    sums, out = np.flatnonzero(used <= given), list(take)
    at = int(entry[sums[np.argmin(np.abs((sums + low) * unit - (goal - now)))]])
    parent, move = (np.concatenate(x) for x in zip(*log))
    while parent[at] >= 0:
        k = int(move[at])
        out[k if k >= 0 else -1 - k] += 1 if k >= 0 else -1
        at = int(parent[at])
    return out


def subset_sum(lengths: list[int], counts: list[int], goal: int) -> list[int]:
    """How many of each length to take so that the sum is as near to goal as can be, the lower sum among equals."""
    return adjusted(lengths, counts, [0] * len(lengths), goal)


def fit_counts(lengths: list[int], counts: list[int], goal: float) -> list[int]:
    """How many documents of each length to take for about goal words; lengths are distinct and positive."""
    total, goal = sum(n * c for n, c in zip(lengths, counts)), round(goal)
    if goal >= total:
        return list(counts)
    take = [c * goal // total for c in counts]
    left = goal - sum(n * t for n, t in zip(lengths, take))
    longest_first = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    for most in (1, left):  # one more of each length, then as many as there is room for
        for k in longest_first:
            more = min(most, counts[k] - take[k], left // lengths[k])
            take[k] += more
            left -= more * lengths[k]
    if not left:
        return take
    order = longest_first[::-1]
    fitted = adjusted([lengths[k] for k in order], [counts[k] for k in order], [take[k] for k in order], goal)
    return [n for _, n in sorted(zip(order, fitted))]


def source_targets(counts: DataFrame, mix: Mix, scratch: Scratch) -> DataFrame:
    """(source, words, target) of every source, written. Sources are numbered in order: each range partition's first
    number is the count of the partitions before it."""
    words = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words"))
    ordered = words.orderBy(F.col("source").asc_nulls_last()).select("source", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    ordered = scratch.write(ordered, "sources")
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    weight = F.get(F.array(*map(F.lit, mix.weights)), F.pmod(F.col("before") + F.col("nth"), F.lit(len(mix.weights))).cast("int"))
    known = ordered.join(before, "part").select("source", "words", weight.alias("weight"), (F.col("words") * mix.most).alias("limit"))
    known = scratch.write(known, "weights")
    full = lambda unit: F.col("weight") * unit >= F.col("limit")

    def sums(unit: float) -> tuple[float, float]:
        row = known.agg(F.sum(F.when(full(unit), F.col("limit"))), F.sum(F.when(~full(unit), F.col("weight")))).first()
        return row[0] or 0.0, row[1] or 0.0

    unit = level(mix.share * (known.agg(F.sum("words")).first()[0] or 0), sums)
    target = F.when(F.col("words") == 0, 0.0).otherwise(F.least(F.col("weight") * unit, F.col("limit")))
    return scratch.write(known.select("source", "words", target.alias("target")), "targets")


def mix_sources(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, taken, copies of every row: copies is how often the mix takes the row, so
    taken = copies x size."""
    mix = mix or Mix()
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.write(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    counts = scratch.write(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "counts")
    known = source_targets(counts, mix, scratch)
    wanted = counts.join(hinted(known, 64), counts["source"].eqNullSafe(known["source"])).select(counts["source"], "size", "docs", "words", "target")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        words, target = int(rows["words"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // words) if words else 0
        solid = (rows["size"] > 0).to_numpy()
        take = np.zeros(len(rows), np.int64)
        if solid.any():
            take[solid] = fit_counts(rows["size"][solid].astype(int).tolist(), rows["docs"][solid].astype(int).tolist(), target - passes * words)
        return rows.assign(passes=np.where(solid, passes, 0), take=take)

    plan = wanted.groupBy("source").applyInPandas(fit, "source string, size long, docs long, words long, target double, passes int, take long")
    plan = scratch.write(plan, "plan")
    h = F.xxhash64(F.lit(mix.seed), F.col("id").cast("string"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    carried = ("words", "target", "passes", "take")
    joined = sized.join(hinted(plan, 80), same(sized, plan)).select("id", sized["source"], sized["size"], h.alias("h"), "docs", *carried)
    ranked = joined.where((F.col("take") > 0) & (F.col("take") < F.col("docs"))).withColumn("bucket", F.pmod("h", F.ceil(F.sqrt("docs")).cast("long")))
    ranked = scratch.write(ranked, "ranked")
    group = ("source", "size", "bucket")
    before = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select(*group, F.coalesce("before", F.lit(0)).alias("before"))
    place = ranked.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("h", F.col("id").asc_nulls_last())))
    out = ("words", "target", "passes")
    chosen = place.join(before, same(place, before) & (place["bucket"] == before["bucket"])).select("id", place["source"], place["size"], *out, (F.col("before") + F.col("nth") <= F.col("take")).alias("more"))
    whole = joined.where((F.col("take") <= 0) | (F.col("take") >= F.col("docs"))).select("id", "source", "size", *out, ((F.col("take") > 0) & (F.col("take") >= F.col("docs"))).alias("more"))
    rows = chosen.unionByName(whole).withColumn("copies", F.col("passes") + F.col("more").cast("int"))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("words").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
