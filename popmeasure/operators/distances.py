"""Distances between populations, and what follows from a table of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import dropped, written
from .order import running_totals


def cell_moments(dist: DataFrame, unit: str = "unit") -> DataFrame:
    """unit, item, mean, mean_square and the grid of values (as a hash) of each cell."""
    return dist.groupBy(unit, "item").agg(F.sum(F.col("prob") * F.col("value")).alias("mean"), F.sum(F.col("prob") * F.col("value") * F.col("value")).alias("mean_square"), F.md5(F.concat_ws(",", F.sort_array(F.collect_list(F.col("value").cast("string")))).cast("binary")).alias("grid"))


def fixation(ma: Column, sa: Column, mb: Column, sb: Column) -> Column:
    """Share of an item's variance that lies between two equally weighted populations, from means and mean squares; 0 without variance."""
    middle = (ma + mb) / 2
    total, between = (sa + sb) / 2 - middle * middle, ((ma - mb) / 2) * ((ma - mb) / 2)
    return F.when(total <= 1e-12, F.lit(0.0)).otherwise(F.try_divide(between, total))


def item_pairs(moments: DataFrame, same_grid: bool = True) -> DataFrame:
    """a, b, item, fst for each unordered pair of units with an item in common: an equality join on item, with a < b. Options never fan out."""
    left = moments.select("item", F.col("unit").alias("a"), F.col("mean").alias("ma"), F.col("mean_square").alias("sa"), F.col("grid").alias("ga"))
    right = moments.select("item", F.col("unit").alias("b"), F.col("mean").alias("mb"), F.col("mean_square").alias("sb"), F.col("grid").alias("gb"))
    both = left.join(right, "item").where("a < b")
    both = both.where("ga = gb") if same_grid else both
    return both.select("a", "b", "item", fixation(F.col("ma"), F.col("sa"), F.col("mb"), F.col("sb")).alias("fst"))


def population_distance(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.avg("fst").alias("d"), F.count("*").alias("n_items"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    return pairs.select("a", "b", "d").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def policy_unit_tvd(rows: DataFrame) -> DataFrame:
    """Mean item total variation for each policy and unit. rows: distributions.joined()."""
    items = rows.groupBy("policy", "unit", "item").agg((0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tvd"))
    return items.groupBy("policy", "unit").agg(F.avg("tvd").alias("d"), F.count("*").alias("n_items"))


def own_unit_rank(rows: DataFrame, own: Column) -> DataFrame:
    """rows: policy, unit, d. Per policy: rank of its own unit (by count of smaller), its distance, the nearest other, and the others' mean."""
    over = W.partitionBy("policy")
    placed = rows.withColumns({"__own": own, "__rank": F.rank().over(over.orderBy("d"))})
    out = placed.groupBy("policy").agg(
        F.max(F.when(F.col("__own"), F.col("__rank"))).alias("own_rank"),
        F.max(F.when(F.col("__own"), F.col("d"))).alias("own_d"),
        F.min_by(F.when(~F.col("__own"), F.col("unit")), F.when(~F.col("__own"), F.struct("d", "unit"))).alias("nearest_other"),
        F.min(F.when(~F.col("__own"), F.col("d"))).alias("best_other"),
        F.avg(F.when(~F.col("__own"), F.col("d"))).alias("mean_other"),
        F.count("*").alias("n"),
    )
    return out.where("own_d is not null").withColumn("gap", F.col("own_d") - F.col("best_other"))


def z_scores(rows: DataFrame) -> DataFrame:
    """rows: unit, dimension, x. x in population standard deviations of its dimension; null where that is 0."""
    over = W.partitionBy("dimension")
    return rows.withColumn("z", F.try_divide(F.col("x") - F.avg("x").over(over), F.nullif(F.stddev_pop("x").over(over), F.lit(0.0))))


def euclidean_pairs(z: DataFrame, strong: float = 0.3, least: int = 4) -> DataFrame:
    """a, b, d, strong dimensions and whether there are enough of them, over shared dimensions."""
    left, right = z.select("dimension", F.col("unit").alias("a"), F.col("z").alias("za")), z.select("dimension", F.col("unit").alias("b"), F.col("z").alias("zb"))
    both = left.join(right, "dimension").where("a < b").withColumn("gap", F.abs(F.col("za") - F.col("zb")))
    out = both.groupBy("a", "b").agg(F.sqrt(F.sum(F.col("gap") * F.col("gap"))).alias("d"), F.count_if(F.col("gap") > strong).alias("n_strong"), F.max_by("dimension", F.struct("gap", "dimension")).alias("widest"))
    return out.withColumn("passes", F.col("n_strong") >= least)


def pair_standing(pairs: DataFrame) -> DataFrame:
    """pairs with their rank among all (1 + how many are strictly smaller) and the share that is at most as far.

    Equal distances are counted first, so one that very many pairs have is one row; no task sees all of them. Pairs are worked out once, and written.
    """
    pairs = written(pairs, "pairs")
    same = running_totals(pairs.groupBy("d").agg(F.count("*").alias("k")), ["d"], F.col("k"))
    place = same.select(F.col("d").alias("__d"), (F.col("before") + 1).alias("rank"), ((F.col("before") + F.col("k")) / F.col("total")).alias("share"))
    return pairs.join(place, F.col("d") == F.col("__d")).drop("__d")


def class_means(pairs: DataFrame, classes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean distance within and between classes, and their ratio. classes: unit, class, and the group's columns."""
    group = group or []
    a = classes.select(*group, F.col("unit").alias("a"), F.col("class").alias("ca"))
    b = classes.select(*group, F.col("unit").alias("b"), F.col("class").alias("cb"))
    both = pairs.join(a, "a").join(b, [*group, "b"])
    inside = F.col("ca") == F.col("cb")
    out = both.groupBy(*group).agg(F.avg(F.when(inside, F.col("d"))).alias("within"), F.avg(F.when(~inside, F.col("d"))).alias("between"), F.count_if(inside).alias("n_within"))
    return out.withColumn("ratio", F.try_divide("within", "between"))


def class_spread(classes: DataFrame, pairs: DataFrame, z: DataFrame) -> DataFrame:
    """class, n, members, mean_inside (mean distance of its pairs), max_gap (the widest spread of its members in one dimension) and gap_dimension (ties: the first by name).

    classes: unit, class; pairs: a, b, d; z: unit, dimension, z. A class of one has no pairs: mean_inside is null and its gap 0.
    """
    side = lambda k: classes.select(F.col("unit").alias(k), F.col("class").alias(f"__{k}"))
    inside = pairs.join(side("a"), "a").join(side("b"), "b").where("__a = __b").groupBy(F.col("__a").alias("class")).agg(F.avg("d").alias("mean_inside"))
    gaps = z.join(classes, "unit").groupBy("class", "dimension").agg((F.max("z") - F.min("z")).alias("gap"))
    widest = gaps.groupBy("class").agg(F.max("gap").alias("max_gap"), F.min_by("dimension", F.struct(-F.col("gap"), "dimension")).alias("gap_dimension"))
    members = classes.groupBy("class").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("unit")), ",").alias("members"))
    return members.join(inside, "class", "left").join(widest, "class", "left")


def filled(pairs: DataFrame) -> DataFrame:
    """Missing distances as the mean of those that are there."""
    mean = pairs.agg(F.avg("d").alias("__m"))
    return pairs.crossJoin(F.broadcast(mean)).withColumn("d", F.coalesce("d", "__m")).drop("__m")


def classical_scaling(pairs: DataFrame, axes: int = 2, most: int = 2000) -> DataFrame:
    """unit, x1 .. of all units from their distances. Up to `most` units one task solves the matrix; of more, none holds it (spectral_axes()). The distances between the places are the same."""
    pairs = written(pairs.select("a", "b", "d"), "pairs")
    names = pairs.select("a").union(pairs.select("b")).distinct()
    if names.count() > most:
        return spectral_axes(pairs, axes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {n: k for k, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        d[i, j] = d[j, i] = pdf["d"].to_numpy()
        center = np.eye(len(names)) - 1 / len(names)
        values, vectors = np.linalg.eigh(-0.5 * center @ (d * d) @ center)
        top = np.argsort(values)[::-1][:axes]
        where = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
        return pd.DataFrame({"unit": names} | {f"x{k + 1}": where[:, k] for k in range(axes)})

    return pairs.select("a", "b", "d", F.lit(1).alias("one")).groupBy("one").applyInPandas(solve, "unit string, " + ", ".join(f"x{k + 1} double" for k in range(axes)))


def spectral_axes(pairs: DataFrame, axes: int = 2, extra: int = 4, rounds: int = 100, tolerance: float = 1e-11) -> DataFrame:
    """unit, x1 ..: the same by block power iteration over the table of pairs.

    A few vectors more than axes are multiplied with the centred matrix of squared distances again and again: a join of pairs with
    the vectors' table, and sums by unit. Between rounds only the vectors' products with each other (a matrix as wide as the
    block) pass through the driver, which keep them at right angles and tell the axes. Each round's vectors are written.
    """
    sides = written(pairs.where("d is not null").select("a", "b", (F.col("d") * F.col("d")).cast("double").alias("s")).transform(lambda p: p.union(p.select("b", "a", "s"))), "sides")
    names = [f"v{k}" for k in range(axes + extra)]
    start = sides.select(F.col("a").alias("unit")).distinct().select("unit", *((C.hash_int(F.lit(n), "unit") / 2.0**32).alias(n) for n in names))

    def centred(rows: DataFrame) -> DataFrame:
        means = rows.agg(*(F.avg(n).alias(f"__{n}") for n in names))
        return rows.crossJoin(F.broadcast(means)).select("unit", *others(rows), *((F.col(n) - F.col(f"__{n}")).alias(n) for n in names))

    def others(rows: DataFrame) -> list[str]:
        return [c for c in rows.columns if c != "unit" and c not in names]

    def products(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        sums = rows.agg(*(F.sum(F.col(p) * F.col(q)).alias(f"s{i}_{j}") for i, p in enumerate(left) for j, q in enumerate(right))).first()
        return np.array([[sums[f"s{i}_{j}"] for j in range(len(right))] for i in range(len(left))])

    def turned(rows: DataFrame, columns: list[str], by: np.ndarray, out: list[str]) -> DataFrame:
        return rows.select("unit", *(sum((F.col(c) * float(by[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(o) for j, o in enumerate(out)))

    now, before = written(centred(start), "vectors"), None
    for _ in range(rounds):
        # At right angles, without what has no length left.
        lengths, vectors = np.linalg.eigh(products(now, names, names))
        keep = lengths > lengths.max() * 1e-14
        at = turned(now, names, vectors[:, keep] / np.sqrt(lengths[keep]), kept := names[: int(keep.sum())])
        met = sides.join(at.withColumnRenamed("unit", "b"), "b").groupBy(F.col("a").alias("unit")).agg(*(F.sum(-0.5 * F.col("s") * F.col(n)).alias(n) for n in kept))
        names = kept
        old = [f"old_{n}" for n in names]
        both = written(centred(met.join(at.withColumnsRenamed(dict(zip(names, old, strict=True))), "unit")), "vectors")
        values, turn = np.linalg.eigh((h := products(both, old, names)) / 2 + h.T / 2)
        top = np.argsort(values)[::-1][:axes]
        found, previous = values[top], before
        before = found
        dropped(now)
        now = both
        if previous is not None and len(previous) == len(found) and np.abs(found - previous).max() <= tolerance * np.abs(values).max():
            break
    out = turned(now, old, turn[:, top] * np.sqrt(np.maximum(found, 0)), [f"x{k + 1}" for k in range(len(top))])
    dropped(sides)
    return out


def principal_plane(means: DataFrame, axes: int = 2) -> DataFrame:
    """item, center, x1 ..: the items that every unit has, their mean over units, and their loadings on the first principal axes.

    One row an item, so only loadings pass through the driver. On each axis the largest loading by absolute value is above 0.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    means = means.select("unit", "item", "mean").persist()
    units = means.select("unit").distinct().count()
    centers = means.groupBy("item").agg(F.avg("mean").alias("center"), F.count("*").alias("n")).where(F.col("n") == units)
    items = [(r["item"], r["center"]) for r in centers.orderBy("item").collect()]
    rows = means.where(F.col("item").isin([i for i, _ in items])).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("item", "mean"))).alias("s"))
    vectors = rows.select(array_to_vector(F.transform("s", lambda s: s["mean"])).alias("features"))
    loadings = PCA(k=axes, inputCol="features", outputCol="scores").fit(vectors).pc.toArray()
    means.unpersist()
    largest = loadings[np.abs(loadings).argmax(axis=0), range(axes)]
    rows = [(i, c, *map(float, w)) for (i, c), w in zip(items, loadings * np.sign(largest), strict=True)]
    return means.sparkSession.createDataFrame(rows, "item string, center double, " + ", ".join(f"x{k + 1} double" for k in range(axes)))


def projected(means: DataFrame, plane: DataFrame, name: str = "unit") -> DataFrame:
    """name, x1 .., n_items: where item means lie in the plane, by the items that both have. means: name, item, mean of units or policies."""
    axes = [c for c in plane.columns if c not in ("item", "center")]
    away = means.select(name, "item", "mean").join(plane, "item").withColumn("away", F.col("mean") - F.col("center"))
    return away.groupBy(name).agg(*(F.sum(F.col("away") * F.col(a)).alias(a) for a in axes), F.count("*").alias("n_items"))
