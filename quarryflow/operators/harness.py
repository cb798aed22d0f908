"""Statistics and grades of repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grades, the share of good runs a reserve needs, and how much slower a cold start is.
CONFIRMED, RESERVE, EXCLUDED = "시연 확정", "예비", "제외"
RESERVE_RATE, COLD = 0.8, 1.5


def run_stats(trials: DataFrame, group: str, order: str, seconds: str) -> DataFrame:
    """group, runs, mean_value, max_value, first_value, cold_start (the first run took COLD times the others' mean) of the
    runs in each group."""
    first = F.min_by(seconds, order)
    rest = F.try_divide(F.sum(seconds) - first, F.count(F.lit(1)) - 1)
    rounded = lambda c: F.round(c, 4)
    cold = F.coalesce((rest > 0) & (first > COLD * rest), F.lit(False))
    return trials.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), rounded(F.avg(seconds)).alias("mean_value"), rounded(F.max(seconds)).alias("max_value"), rounded(first).alias("first_value"), cold.alias("cold_start"))


def verdicts(trials: DataFrame, group: str, ok: Column) -> DataFrame:
    """group, good, total, verdict: confirmed if all runs were good, reserve from RESERVE_RATE on, else excluded."""
    counted = trials.groupBy(group).agg(F.count_if(ok).alias("good"), F.count(F.lit(1)).alias("total"))
    grade = F.when(F.col("good") == F.col("total"), CONFIRMED).when(F.col("good") >= RESERVE_RATE * F.col("total"), RESERVE).otherwise(EXCLUDED)
    return counted.withColumn("verdict", grade)


def holds_words(text: Column, must_all: list[str], must_any_groups: list[list[str]]) -> Column:
    """Whether a text has every word of must_all and one of each group; an empty group asks for nothing."""
    out = F.lit(True)
    for word in must_all:
        out &= F.contains(text, F.lit(word))
    for group in filter(None, must_any_groups):
        found = F.lit(False)
        for word in group:
            found |= F.contains(text, F.lit(word))
        out &= found
    return F.coalesce(out, F.lit(False))
