"""Weighted answer distributions over option grids, softmaxes of scores, and how two distributions are brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def long_answers(wide: DataFrame, keep: list[str], items: list[str]) -> DataFrame:
    """One row for each answer: keep, item, value. Columns other than these never leave the scan."""
    return wide.select(*keep, *(F.col(i).cast("double").alias(i) for i in items)).unpivot(keep, items, "item", "value")


def observed_support(answers: DataFrame, low: float, high: float, most: int = 150) -> DataFrame:
    """item, value: the whole numbers in range that anyone answered (rounded half to even). More than `most` of an item is an error."""
    found = answers.select("item", F.bround("value").alias("value")).where(F.col("value").between(low, high)).distinct()
    size = F.count("*").over(W.partitionBy("item"))
    return found.withColumn("n", size).where(F.when(F.col("n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit("too many options")).cast("boolean"))).drop("n")


def option_grid(spec: DataFrame) -> DataFrame:
    """spec: item, codes, labels. One row for each option: item, option_index, code, label, value. Items need two options."""
    checked = spec.where(F.when(F.size("codes") >= 2, F.lit(True)).otherwise(F.raise_error(F.lit("an item needs two options")).cast("boolean")))
    aligned = checked.withColumn("labels", C.align_labels(F.col("codes"), F.col("labels")))
    rows = aligned.select("item", F.posexplode(F.arrays_zip("codes", "labels")).alias("option_index", "o"))
    return rows.select("item", "option_index", F.col("o.codes").alias("code"), F.col("o.labels").alias("label"), F.expr("try_cast(o.codes AS double)").alias("value"))


def distribution(answers: DataFrame, group: list[str], least: int = 0, mode: str = "negative", count: str | None = None) -> DataFrame:
    """Over the options that were answered: group, item, value, n, weight, prob, n_valid, total_weight.

    answers: group, item, value, weight. Missing codes and weights that aren't above 0 are left out; so are
    cells with fewer than `least` answers. Sums are combined before the one shuffle. Where rows are sums over
    answers already, count names the column that says of how many.
    """
    valid = answers.withColumns({"value": C.mask_missing(F.col("value"), mode), "weight": C.clean_weight(F.col("weight"))}).where("value is not null and weight is not null")
    counts = valid.groupBy(*group, "item", "value").agg((F.sum(count) if count else F.count("*")).alias("n"), F.sum("weight").alias("weight"))
    cell = W.partitionBy(*group, "item")
    out = counts.withColumns({"n_valid": F.sum("n").over(cell), "total_weight": F.sum("weight").over(cell)}).withColumn("prob", F.col("weight") / F.col("total_weight"))
    return out.where(F.col("n_valid") >= least) if least else out


def grid_distribution(answers: DataFrame, group: list[str], grid: DataFrame, mode: str = "negative") -> DataFrame:
    """Over all options of a grid (item, value): those that nobody chose have probability 0. Answers outside the grid are left out."""
    inside = answers.join(F.broadcast(grid.select("item", "value")), ["item", "value"])
    got = distribution(inside, group, mode=mode)
    cells = got.select(*group, "item").distinct().join(F.broadcast(grid), "item")
    full = cells.join(got.drop("n_valid", "total_weight"), [*group, "item", "value"], "left")
    cell = W.partitionBy(*group, "item")
    zero = full.withColumns({"n": F.coalesce("n", F.lit(0)), "weight": F.coalesce("weight", F.lit(0.0)), "prob": F.coalesce("prob", F.lit(0.0))})
    return zero.withColumns({"n_valid": F.sum("n").over(cell), "total_weight": F.sum("weight").over(cell)})


def softmax(scores: DataFrame, cell: list[str], score: str = "score", temperature: float = 1.0, length: str | None = None) -> DataFrame:
    """scores with prob: exp of the score (for each of its tokens, if length names their number) over the temperature, in proportion within a cell."""
    over = W.partitionBy(*cell)
    s = F.col(score) / F.col(length) if length else F.col(score)
    shifted = scores.withColumn("__e", F.exp((s - F.max(s).over(over)) / temperature))
    return shifted.withColumn("prob", F.col("__e") / F.sum("__e").over(over)).drop("__e")


def normalised(rows: DataFrame, cell: list[str], prob: str = "prob") -> DataFrame:
    total = F.sum(prob).over(W.partitionBy(*cell))
    return rows.withColumn(prob, F.try_divide(F.col(prob), total))


def collapsed(rows: DataFrame, cell: list[str], prob: str = "prob") -> DataFrame:
    """Sums of options that a cell has more than once."""
    return rows.groupBy(*cell).agg(F.sum(prob).alias(prob))


def uniform(rows: DataFrame, cell: list[str]) -> DataFrame:
    """The policy that gives each option of a cell the same probability."""
    return rows.withColumn("prob", 1 / F.count("*").over(W.partitionBy(*cell)))


def joined(policies: DataFrame, people: DataFrame, least: int = 2) -> DataFrame:
    """policy, unit, item, value, q (policy), p (unit) over shared options, each side in proportion again; cells need `least` of them.

    Both sides are grouped by item and option, so every policy meets every unit by an equality join.
    """
    both = policies.select("policy", "item", "value", F.col("prob").alias("q")).join(people.select("unit", "item", "value", F.col("prob").alias("p")), ["item", "value"])
    cell = W.partitionBy("policy", "unit", "item")
    sized = both.withColumns({"__n": F.count("*").over(cell), "__q": F.sum("q").over(cell), "__p": F.sum("p").over(cell)})
    kept = sized.where((F.col("__n") >= least) & (F.col("__q") > 0) & (F.col("__p") > 0))
    return kept.select("policy", "unit", "item", "value", (F.col("q") / F.col("__q")).alias("q"), (F.col("p") / F.col("__p")).alias("p"))


def union_grid(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """p of a and q of b over options that either has; what one lacks is 0. Both sum to 1 again within keys."""
    full = a.select(*keys, "value", F.col("prob").alias("p")).join(b.select(*keys, "value", F.col("prob").alias("q")), [*keys, "value"], "full").fillna(0.0, ["p", "q"])
    return normalised(normalised(full, keys, "p"), keys, "q")


def precedence(rows: DataFrame, key: list[str], rank: Column, tie: list[str]) -> DataFrame:
    """The first row of each key by rank of its source, then by tie."""
    order = W.partitionBy(*key).orderBy(rank, *tie)
    return rows.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")


def temperature_sweep(rows: DataFrame, cell: list[str], temperatures: list[float], fixed: Column | None = None) -> DataFrame:
    """rows for each temperature T with prob ** (1 / T) in proportion; where `fixed` holds prob stays as it is at T = 1."""
    swept = rows.withColumn("temperature", F.explode(F.array(*(F.lit(float(t)) for t in temperatures))))
    power = F.pow("prob", 1 / (F.when(fixed, 1.0).otherwise(F.col("temperature")) if fixed is not None else F.col("temperature")))
    return normalised(swept.withColumn("prob", power), [*cell, "temperature"])


def max_entropy(grid: DataFrame, cell: list[str], value: str, mean: str, steps: int = 200, bound: float = 60.0) -> DataFrame:
    """Each cell's distribution of greatest entropy with the given mean: prob in proportion to exp(theta * value), theta by bisection.

    grid: one row for each option of a cell, each with the cell's mean. Means at or beyond an end give a point
    mass there. The bisection is an expression over a cell's options, so a cell is one row while it runs.
    """
    cells = grid.groupBy(*cell).agg(F.sort_array(F.collect_list(value)).alias("__v"), F.first(mean).alias("__m"))
    low, high = F.array_min("__v"), F.array_max("__v")
    bare = F.transform("__v", lambda v: v - low)

    def mean_at(theta: Column) -> Column:
        top = F.greatest(F.lit(0.0), theta * (high - low))
        part = lambda v: F.exp(theta * v - top)
        return F.aggregate(bare, F.lit(0.0), lambda a, v: a + v * part(v)) / F.aggregate(bare, F.lit(0.0), lambda a, v: a + part(v))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        less = mean_at(mid) < F.col("__m") - low
        return F.struct(F.when(less, mid).otherwise(s["a"]).alias("a"), F.when(less, s["b"]).otherwise(mid).alias("b"))

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(-bound).alias("a"), F.lit(bound).alias("b")), halve, lambda s: (s["a"] + s["b"]) / 2)
    solved = cells.withColumns({"__low": low, "__high": high}).withColumn("__t", F.when((F.col("__m") > low) & (F.col("__m") < high), theta))
    rows = solved.select(*cell, "__m", "__low", "__high", "__t", F.explode("__v").alias(value))
    top = F.greatest(F.lit(0.0), F.col("__t") * (F.col("__high") - F.col("__low")))
    free = F.exp(F.col("__t") * (F.col(value) - F.col("__low")) - top)
    end = F.when(F.col("__m") <= F.col("__low"), F.col("__low")).otherwise(F.col("__high"))
    weight = F.when(F.col("__t").isNull(), (F.col(value) == end).cast("double")).otherwise(free)
    return normalised(rows.withColumn("prob", weight), cell).select(*cell, value, "prob")


def sign_follower(grid: DataFrame, cell: list[str], value: str, z: str) -> DataFrame:
    """A point mass on the largest value where z is 0 or more, else on the smallest."""
    over = W.partitionBy(*cell)
    pick = F.when(F.col(z) >= 0, F.max(value).over(over)).otherwise(F.min(value).over(over))
    return grid.withColumn("prob", (F.col(value) == pick).cast("double"))
