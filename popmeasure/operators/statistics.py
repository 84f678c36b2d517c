"""Rank correlations, intervals, linear fits, and the bootstrap of very many rows. Other resamples and permutations are in resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .summaries import average_ranks


def spearman(rows: DataFrame, group: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """group, rho, n over rows with both values; null with fewer than `least` rows or a constant side."""
    both = average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), group, [x, y])
    return both.groupBy(*group).agg(C.guarded_corr(f"rank_{x}", f"rank_{y}", least).alias("rho"), F.count("*").alias("n"))


def partial_spearman(rows: DataFrame, group: list[str], x: str, y: str, z: str, least: int = 8) -> DataFrame:
    """Rank correlation of x and y with z held fixed, from the three pairwise ones."""
    full = average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()), group, [x, y, z])
    r = lambda a, b: C.guarded_corr(f"rank_{a}", f"rank_{b}", least)
    out = full.groupBy(*group).agg(r(x, y).alias("xy"), r(x, z).alias("xz"), r(y, z).alias("yz"), F.count("*").alias("n"))
    return out.withColumn("partial", F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt(F.nullif((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")), F.lit(0.0)))))


def poisson_cuts() -> list[float]:
    """Cumulative probabilities of Poisson(1) at 0 to 8: a uniform draw's weight is how many of them it reaches."""
    cuts, total, term = [], 0.0, math.exp(-1)
    for k in range(9):
        total += term
        cuts.append(total)
        term /= k + 1
    return cuts


def poisson_mean(rows: DataFrame, group: list[str], value: str, key: str, reps: int = 200, seed: str = "boot") -> DataFrame:
    """As resampling.bootstrap_mean, with Poisson(1) weights: each row draws its own weight in each resample, sums combine before the shuffle."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("__rep").cast("string")).cast("binary"))
    # A draw u is the first 8 of the hash's digits as a share of 2**32. Digits of one case are ordered as their numbers, so u >= c is asked of the text; most draws are below the first cuts.
    weight = None
    for k, c in enumerate(poisson_cuts()):
        below = F.col("__draw") < f"{math.ceil(c * 2**32):08x}"
        weight = F.when(below, k) if weight is None else weight.when(below, k)
    weight = weight.otherwise(len(poisson_cuts()))
    # A row costs `reps` digests, so a few large files are dealt to all cores first.
    dealt = rows.where(F.col(value).isNotNull()).select(*group, key, value).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)
    drawn = dealt.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("__draw", draw).withColumn("__w", weight)
    means = drawn.groupBy(*group, "__rep").agg(F.try_divide(F.sum(F.col("__w") * F.col(value)), F.sum("__w")).alias("__m"))
    return means.groupBy(*group).agg(F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))


def linear_fit(rows: DataFrame, group: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Slope and intercept of y on x; null with fewer than `least` rows or a constant x."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double")
    n = F.count(F.when(both, F.lit(1)))
    slope = F.when((n >= least) & (F.max(a) > F.min(a)), F.try_divide(F.covar_pop(a, b), F.var_pop(a)))
    return rows.groupBy(*group).agg(slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"), n.alias("n"))


def _eliminated(p: int, tolerance: float) -> Column:
    """Column __m, p rows of p + 1 + p numbers (a Gram matrix, its right side, the unit matrix) one after the other, brought to upper triangular form.

    That is Cholesky's factorisation without its roots, folded over the pivots for any p: in row k then stand the pivot, what is
    left of the right side, and row k of the inverse of the lower factor. Null where a pivot is next to nothing beside its
    diagonal, so where a variable is constant or follows from those before it.
    """
    wide, first = 2 * p + 1, F.col("__m")

    def step(m: Column, k: Column) -> Column:
        pivot, at = F.get(m, k * wide + k), lambda i: F.floor(i / wide).cast("int")
        left = lambda v, i: v - F.get(m, at(i) * wide + k) / pivot * F.get(m, k * wide + i - at(i) * wide)
        return F.when(pivot > tolerance * F.get(first, k * wide + k), F.transform(m, lambda v, i: F.when(at(i) > k, left(v, i)).otherwise(v)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), first, step) if p else first


def least_squares(rows: DataFrame, group: list[str], xs: list[str], y: str, pooled: bool = False, tolerance: float = 1e-10) -> DataFrame:
    """Coefficients and standard errors of y on a constant and any number of xs: group, term, b, se, n. Over rows that have them all.

    One pass adds up means and centred cross products of each group (and, if pooled, of all rows: then a column `pooled` tells that row,
    whose group columns are null); they are combined before the one shuffle. Each group's equations are then solved in its own row,
    folded over arrays. b and se are null where xs depend on each other, se also with as many terms as rows.
    """
    p, value = len(xs), [F.col(c).cast("double") for c in [*xs, y]]
    full = rows.where(" and ".join(f"({c} is not null and not isnan(cast({c} as double)))" for c in [*xs, y]))
    sets = full.groupingSets([[F.col(g) for g in group], []], *(F.col(g) for g in group)) if pooled else full.groupBy(*group)
    n = F.count("*").alias("n")
    cross = [(F.covar_pop(value[i], value[j])).alias(f"__{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    sums = sets.agg(n, *(F.avg(v).alias(f"__mean_{k}") for k, v in enumerate(value)), *cross, *([(F.grouping_id() > 0).alias("pooled")] if pooled else []))
    s = lambda i, j: F.col(f"__{min(i, j)}_{max(i, j)}") * F.col("n")
    matrix = [x for i in range(p) for x in [*(s(i, j) for j in range(p + 1)), *(F.lit(float(i == j)) for j in range(p))]]
    doubles = lambda cs: F.array(*cs).cast("array<double>")
    whole = sums.select(*group, *(["pooled"] if pooled else []), "n", doubles(matrix).alias("__m"), doubles([F.col(f"__mean_{k}") for k in range(p)]).alias("__x"), F.col(f"__mean_{p}").alias("__y"), s(p, p).alias("__yy"))
    solved = whole.withColumn("__t", _eliminated(p, tolerance))
    pivot, right = (lambda k: F.get("__t", k * (2 * p + 2))), (lambda k: F.get("__t", k * (2 * p + 1) + p))
    factor = lambda k, j: F.get("__t", k * (2 * p + 1) + p + 1 + j)
    each = F.sequence(F.lit(0), F.lit(p - 1)) if p else F.array().cast("array<int>")
    total = lambda f, over=each: F.aggregate(over, F.lit(0.0), lambda t, k: t + f(k))
    sound = F.col("__t").isNotNull()
    rest = F.col("__yy") - total(lambda k: right(k) * right(k) / pivot(k))
    solved = solved.withColumn("__s2", F.when(sound & (F.col("n") > p + 1), F.greatest(rest, F.lit(0.0)) / (F.col("n") - (p + 1))))
    slope = lambda j: total(lambda k: factor(k, j) * right(k) / pivot(k))
    spread = lambda j: total(lambda k: factor(k, j) * factor(k, j) / pivot(k))
    level = F.col("__y") - total(lambda j: slope(j) * F.get("__x", j))
    at_zero = 1 / F.col("n") + total(lambda k: F.pow(total(lambda j: factor(k, j) * F.get("__x", j)), 2.0) / pivot(k))
    term = lambda name, b, v: F.struct(name.alias("term"), F.when(sound, b).alias("b"), F.sqrt(F.col("__s2") * v).alias("se"))
    names = F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    terms = F.concat(F.array(term(F.lit("const"), level, at_zero)), F.transform(each, lambda j: term(F.get(names, j), slope(j), spread(j))))
    return solved.select(*group, *(["pooled"] if pooled else []), "n", F.explode(terms).alias("x")).select(*group, *(["pooled"] if pooled else []), "x.term", "x.b", "x.se", "n")


def accuracy(rows: DataFrame, group: list[str], hit: Column, sets: list[list[str]] | None = None) -> DataFrame:
    """Share of hits with Wilson's interval, and n. With sets, for each of these groupings in one pass; columns that a grouping lacks are null."""
    grouped = rows.groupingSets([[F.col(c) for c in g] for g in sets], *(F.col(g) for g in group)) if sets else rows.groupBy(*group)
    out = grouped.agg(F.avg(hit.cast("double")).alias("share"), F.count(hit).alias("n"))
    low, high = C.wilson(F.col("share"), F.col("n"))
    return out.withColumns({"low": low, "high": high})


def layered_spearman(means: DataFrame, anchors: DataFrame, layers: Column, least: int = 8) -> DataFrame:
    """dimension, layer, rho, n: rank correlations over units of each layer's composite (the mean of its item means) with the anchor of the dimension.

    layers: for a row of means (unit, dimension, item, mean) the names of the layers it counts for, such as its item, its class and all.
    """
    parts = means.select("unit", "dimension", F.explode(F.array_compact(layers)).alias("layer"), "mean")
    composite = parts.groupBy("unit", "dimension", "layer").agg(F.round(F.avg("mean"), 9).alias("m"))
    return spearman(composite.join(anchors.select("unit", "dimension", F.round("z", 9).alias("z")), ["unit", "dimension"]), ["dimension", "layer"], "m", "z", least)


def benchmark_agreement(z: Column, benchmark: Column) -> Column:
    """Whether z is significant and of the benchmark's sign; null without a benchmark."""
    return F.when(benchmark.isNotNull(), (F.signum(z) == F.signum(benchmark)) & (F.abs(z) > 1.96))
