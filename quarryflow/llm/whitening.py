"""Operator 11: embedding whitening by MLlib's singular value decomposition of centred, distributed rows.

Entries become whole numbers x = floor(256 * c), so counts, sums and deviations are exact. The fit list holds each
distinct vector once. Its rows are centred and go to `RowMatrix.computeSVD`, which adds up their products in a tree of
tasks and decomposes the dims x dims result; squared singular values divided by n are the variances along the components.
All components are asked for, because only then MLlib takes the dense decomposition, which is exact to double precision.
The total variance does not come from the decomposition but from the exact deviations, so `explained` is right even where
small components are lost.

The driver holds the model alone: dims sums and at most `k` rows of dims numbers, whatever the number of vectors.

Defined results: vectors that are null or empty or hold null or non-finite entries are dropped; so are those whose length
is not the most common one (of several, the longest). Entries beyond a long become its bounds. Components whose singular
value is below a millionth of the largest are rounding noise and left out, hence a table of equal vectors, and an empty
one, have none and give no rows. Repeated rows give repeated results, null ids stay, other columns are ignored.
`deviation` is a decimal where it may exceed a long, and null where it may exceed 38 digits.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Singular values below this share of the largest are rounding noise.
NOISE = 1e-6
LARGEST_LONG, LARGEST_DECIMAL = 2**63 - 1, 10**38 - 1


def whole_numbers(vector: Column) -> Column:
    """The entries as longs; null if the vector cannot be used."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return F.when(finite & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("long")))


def _numbers(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v).cast(kind) for v in values))


def _total(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda total, v: (total + v).cast(kind))


@dataclass
class Whitening:
    """A fitted model. Components are unit vectors by falling variance."""

    n: int
    sums: list[int]
    components: list[list[float]]
    variances: list[float]
    total_variance: float
    deviation_bound: int
    identity_error: float = 0.0

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def deviation(self, x: Column) -> Column:
        """Sum over the dimensions of (n * x - S) ** 2, in a type that holds the largest of the fit."""
        if self.deviation_bound > LARGEST_DECIMAL:
            return F.lit(None).cast("decimal(38,0)")
        kind = "long" if self.deviation_bound <= LARGEST_LONG else "decimal(38,0)"
        n = F.lit(self.n).cast("long" if kind == "long" else "decimal(18,0)")
        apart = F.zip_with(x, _numbers(self.sums, kind), lambda c, s: (n * c - s).cast("long" if kind == "long" else "decimal(19,0)"))
        return _total(F.transform(apart, lambda d: (d * d).cast(kind)), kind)

    def whitened(self, x: Column, component: int) -> Column:
        centred = F.zip_with(x, _numbers(self.means, "double"), lambda c, m: c.cast("double") - m)
        along = F.zip_with(centred, _numbers(self.components[component], "double"), lambda c, q: c * q)
        return _total(along, "double") / F.lit(self.variances[component] ** 0.5)


def _most_common_length(x: DataFrame) -> int:
    found = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return found["dims"] if found else 0


def fit(x: DataFrame, k: int, scratch: Scratch) -> Whitening | None:
    """x: distinct vectors of one length, as whole numbers in column x, written. None if there is no component."""
    dims = x.select(F.posexplode("x").alias("i", "c"))
    moments = dims.groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high")).orderBy("i").collect()
    if not moments:
        return None
    n, sums = x.count(), [int(m["s"]) for m in moments]
    bound = sum(max(n * m["high"] - s, s - n * m["low"]) ** 2 for m, s in zip(moments, sums))
    model = Whitening(n, sums, [], [], 0.0, bound)
    deviation = model.deviation(F.col("x")) if n * bound <= LARGEST_DECIMAL else None
    if deviation is None:  # too large to be exact
        means = _numbers(model.means, "double")
        square = _total(F.zip_with("x", means, lambda c, m: (c.cast("double") - m) * (c.cast("double") - m)), "double")
        model.total_variance = x.agg(F.sum(square)).first()[0] / n
    else:
        model.total_variance = float(Fraction(int(x.agg(F.sum(deviation.cast("decimal(38,0)"))).first()[0]), n**3))
    if not model.total_variance:
        return None
    centred = F.zip_with("x", _numbers(model.means, "double"), lambda c, m: c.cast("double") - m)
    rows = MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(centred).alias("v")), "v")
    found = RowMatrix(rows, n, len(sums)).computeSVD(len(sums), computeU=False, rCond=NOISE)
    directions = found.V.toArray().T[:k]
    model.components = [[float(c) for c in d] for d in directions]
    model.variances = [float(s) ** 2 / n for s in found.s.toArray()[:k]]
    model.identity_error = _identity_error(x, model)
    return model


def _identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    count = len(model.components)
    white = x.select(*(model.whitened(F.col("x"), j).alias(f"w{j}") for j in range(count)))
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    found = white.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    scratch = Scratch(df.sparkSession, "whitening")
    rows = df.select(F.col(id_col).alias("id"), whole_numbers(F.col(vec_col)).alias("x")).where("x IS NOT NULL")
    dims = _most_common_length(rows)
    rows = rows.where(F.size("x") == dims)
    model = fit(scratch.write(rows.select("x").distinct(), "fit"), k, scratch) if dims else None
    if model is None:
        names = (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
        return rows.where(F.lit(False)).select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in names))
    along = F.array(
        *(
            F.struct(F.lit(j + 1).alias("component"), model.whitened(F.col("x"), j).alias("whitened"), F.lit(e / model.total_variance).alias("explained"))
            for j, e in enumerate(model.variances)
        )
    )
    each = rows.select("id", model.deviation(F.col("x")).alias("deviation"), F.explode(along).alias("w"))
    n, error = F.lit(model.n).cast("long").alias("n"), F.lit(model.identity_error).alias("identity_error")
    return each.select(F.col("id").alias(id_col), "w.component", n, "deviation", "w.whitened", "w.explained", error)
