"""Summaries of item metrics: by group, against a baseline, matched against cross, by class, pooled in two ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import written
from .order import alike, quantiles
from .resampling import bootstrap_mean


def metric_rows(rows: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric: keep, metric, value."""
    return rows.select(*keep, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keep, metrics, "metric", "value")


def summary(rows: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Over values that are there: mean, exact median, sample standard deviation (null for one) and n. Groups without a value have nulls. rows are worked out once, and written."""
    rows = rows if hasattr(rows, "written_to") else written(rows.select(*group, value), "summary-rows")
    moments = rows.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    middle = quantiles(rows, group, value, [0.5]).select(*group, F.get("q", F.lit(0)).alias("median"))
    return alike(moments, middle, group, "left").select(*group, "mean", "median", "std", "n")


def summary_with_interval(rows: DataFrame, group: list[str], value: str, order: list[str], reps: int = 2000) -> DataFrame:
    """The same with low and high, the bootstrap interval of the mean. order tells a group's rows apart."""
    rows = written(rows.select(*group, *(o for o in order if o not in group), value), "summary-rows")
    bounds = bootstrap_mean(rows, group, value, order, reps).select(*group, "low", "high")
    return alike(summary(rows, group, value), bounds, group, "left")


def weighted_mean(rows: DataFrame, group: list[str], value: str = "value", weight: str = "weight", least: int = 1, count: str | None = None) -> DataFrame:
    """Mean by weight over rows that have both, and their number; groups with fewer than `least` go. Where rows are sums over answers already, count names the column that says of how many."""
    w = F.when(F.col(value).isNotNull(), C.clean_weight(F.col(weight)))
    out = rows.groupBy(*group).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("mean"), (F.coalesce(F.sum(F.when(w.isNotNull(), F.col(count))), F.lit(0)) if count else F.count(w)).alias("n"))
    return out.where(F.col("n") >= least)


def composites(means: DataFrame, group: list[str]) -> DataFrame:
    """means: group, dimension, item, mean. The mean of item means of each dimension."""
    return means.groupBy(*group, "dimension").agg(F.avg("mean").alias("composite"), F.count("mean").alias("n_items"))


def against_baseline(rows: DataFrame, key: list[str], metrics: list[str], baseline: str = "base", policy: str = "policy") -> DataFrame:
    """Each other policy's row beside the baseline's for the same key: columns base_<metric>."""
    base = rows.where(F.col(policy) == baseline).select(*key, *(F.col(m).alias(f"base_{m}") for m in metrics))
    return rows.where(F.col(policy) != baseline).join(base, key)


def improvements(pairs: DataFrame, group: list[str], metrics: list[str], null_as_false: bool = False) -> DataFrame:
    """Baseline less candidate for each metric: mean, share above 0, n. null_as_false counts rows without a value as not improved."""
    moved = pairs.select(*group, *((F.col(f"base_{m}") - F.col(m)).cast("double").alias(m) for m in metrics)).unpivot(group, metrics, "metric", "gain")
    better = (F.col("gain") > 0).cast("double")
    return moved.groupBy(*group, "metric").agg(F.avg("gain").alias("mean_gain"), F.avg(F.coalesce(better, F.lit(0.0)) if null_as_false else better).alias("share_better"), F.count("gain").alias("n"))


def specificity(rows: DataFrame, group: list[str], metric: str) -> DataFrame:
    """Cross less matched for each key, of policies that are one or the other; only for exactly one of each."""
    paired = rows.groupBy(*group).agg(
        F.max(F.when(F.col("relationship") == "matched", F.col(metric))).alias("matched"),
        F.max(F.when(F.col("relationship") == "cross", F.col(metric))).alias("cross"),
        F.count_if(F.col("relationship") == "cross").alias("n_cross"),
    )
    return paired.where("n_cross = 1 and matched is not null").withColumn("advantage", F.col("cross") - F.col("matched"))


def correlation_and_shift(rows: DataFrame, policy: list[str], base: str) -> DataFrame:
    """For each policy and dimension the guarded correlation of its items' means with people's (to 9 digits: a side that is constant but
    for the last ones counts as constant), n, and its mean total variation less that of the base policy in the dimension."""
    near = rows.withColumns({"__q": F.round("mean_q", 9), "__p": F.round("mean_p", 9)})
    own = near.groupBy(*policy, "dimension").agg(C.guarded_corr("__q", "__p").alias("r"), F.count("__q").alias("n"), F.avg("tvd").alias("__tvd"))
    over = W.partitionBy("dimension")
    return own.withColumn("delta_tvd", F.col("__tvd") - F.max(F.when(F.col(policy[0]) == base, F.col("__tvd"))).over(over)).drop("__tvd")


def matched_and_cross(rows: DataFrame, group: list[str], metric: str) -> DataFrame:
    """For each group the matched policy's mean, and the mean and least of all cross policies' means."""
    means = rows.where("relationship in ('matched', 'cross')").groupBy(*group, "policy", "relationship").agg(F.avg(metric).alias("m"))
    cross = F.when(F.col("relationship") == "cross", F.col("m"))
    out = means.groupBy(*group).agg(F.max(F.when(F.col("relationship") == "matched", F.col("m"))).alias("matched"), F.avg(cross).alias("mean_cross"), F.min(cross).alias("best_cross"), F.count(cross).alias("n_cross"))
    return out.where("matched is not null").withColumns({"over_mean": F.col("mean_cross") - F.col("matched"), "over_best": F.col("best_cross") - F.col("matched")})


def direction_cells(pairs: DataFrame, z: str = "z") -> DataFrame:
    """Bias of baseline and candidate, the movement between them, whether it shrank and whether it goes the way of z. pairs: mean_error, base_mean_error, z."""
    move = F.col("mean_error") - F.col("base_mean_error")
    return pairs.withColumns({"movement": move, "shrunk": F.abs("mean_error") < F.abs("base_mean_error"), "z_aligned": (F.signum(move) == F.signum(F.col(z))) & (F.abs(move) > 1e-9)})


def share_of_cells(rows: DataFrame, group: list[str], flags: list[str]) -> DataFrame:
    return rows.groupBy(*group).agg(*(F.avg(F.col(f).cast("double")).alias(f) for f in flags), F.count("*").alias("n"))


def contrast(rows: DataFrame, unit: list[str], cls: str, near: str, far: str) -> DataFrame:
    """Per unit: near class less far class for the people and for the policy, whether the policy's is smaller, and their ratio."""
    mean = lambda c, name: F.avg(F.when(F.col(cls) == name, F.col(c)))
    out = rows.groupBy(*unit).agg((mean("mean_p", near) - mean("mean_p", far)).alias("people"), (mean("mean_q", near) - mean("mean_q", far)).alias("policy_contrast"))
    return out.withColumns({"compressed": F.abs("policy_contrast") < F.abs("people"), "ratio": F.when(F.col("people") != 0, F.try_divide("policy_contrast", "people"))})


def pooled(rows: DataFrame, group: list[str], unit: str, metric: str) -> DataFrame:
    """The mean over all items, and the mean of units' means; they differ where units have different items."""
    by_unit = rows.groupBy(*group, unit).agg(F.sum(metric).alias("s"), F.count(metric).alias("n"))
    return by_unit.groupBy(*group).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("item_pooled"), F.avg(F.try_divide("s", "n")).alias("unit_pooled"), F.sum("n").alias("n"))


def like_for_like(rows: DataFrame, family: str, policy: str, item: str, metrics: list[str]) -> DataFrame:
    """family, items, policies and each metric's mean of policies' means, over the items that every policy has: so families with different items compare.

    The means of a policy are over all its rows of these items; a family's is over its policies, each with the same weight.
    """
    every = rows.agg(F.count_distinct(policy).alias("__all"))
    shared = rows.groupBy(item).agg(F.count_distinct(policy).alias("__k")).crossJoin(F.broadcast(every)).where("__k = __all").select(item)
    own = rows.join(shared, item, "left_semi")
    means = own.groupBy(family, policy).agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in metrics))
    items = shared.agg(F.count("*").alias("items"))
    return means.groupBy(family).agg(F.count("*").alias("policies"), *(F.avg(m).alias(m) for m in metrics)).crossJoin(F.broadcast(items))


def coverage(answers: DataFrame, group: list[str], mode: str = "negative") -> DataFrame:
    """Share and number of answers that are no missing codes."""
    valid = C.mask_missing(F.col("value"), mode).isNotNull()
    return answers.groupBy(*group).agg(F.avg(valid.cast("double")).alias("share"), F.count_if(valid).alias("n_valid"), F.count("*").alias("n"))


def two_units(answers: DataFrame, a: str, b: str) -> DataFrame:
    """Per item: both units' means and numbers, their difference, and what is missing."""
    of = lambda u: F.when(F.col("unit") == u, F.col("value"))
    out = answers.where(F.col("unit").isin(a, b)).groupBy("item").agg(F.avg(of(a)).alias("mean_a"), F.avg(of(b)).alias("mean_b"), F.count(of(a)).alias("n_a"), F.count(of(b)).alias("n_b"))
    return out.withColumns({"difference": F.col("mean_a") - F.col("mean_b"), "status": F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "missing").otherwise("ok")})


def ranks(rows: DataFrame, within: list[str], by: str, tie: list[str]) -> DataFrame:
    """rank_by_order (1 + place in ascending order, ties by tie) and rank_by_count (1 + how many are strictly smaller)."""
    over = W.partitionBy(*within)
    return rows.withColumns({"rank_by_order": F.row_number().over(over.orderBy(by, *tie)), "rank_by_count": F.rank().over(over.orderBy(by))})


def average_ranks(rows: DataFrame, within: list[str], columns: list[str]) -> DataFrame:
    """rows with rank_<c>: ascending ranks from 1, ties share the mean of their ranks; null where c is null."""
    out = rows
    for c in columns:
        order, same = W.partitionBy(*within, F.col(c).isNull()).orderBy(c), W.partitionBy(*within, c)
        out = out.withColumn(f"rank_{c}", F.when(F.col(c).isNotNull(), F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0))
    return out


def quantile_bins(rows: DataFrame, value: str, bins: int = 3) -> DataFrame:
    """rows with bin (from 0): edges by linear interpolation, closed on the right. The edges are one row, whatever the size."""
    cuts = quantiles(rows, [], value, [k / bins for k in range(1, bins)]).select(F.col("q").alias("__cuts"))
    joined = rows.crossJoin(F.broadcast(cuts))
    at = F.aggregate("__cuts", F.lit(0), lambda n, c: n + (F.col(value) > c).cast("int"))
    return joined.withColumn("bin", F.when(F.col(value).isNotNull(), at)).drop("__cuts")


def nested_sample(rows: DataFrame, group: list[str], key: str, seed: str) -> DataFrame:
    """rows with sample_rank: a random order in each group, the same every time; rank <= k are samples that nest."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("sample_rank", F.row_number().over(W.partitionBy(*group).orderBy(draw, key)))


def failure_gate(rows: DataFrame, stream: list[str], order: str, failed: Column, last: int = 20, most: float = 0.75) -> DataFrame:
    """Share of failures in each row's last outcomes; the gate closes where all of them are there and the share is above `most`."""
    over = W.partitionBy(*stream).orderBy(order).rowsBetween(1 - last, 0)
    out = rows.withColumns({"seen": F.count("*").over(over), "failure_share": F.avg(failed.cast("double")).over(over)})
    return out.withColumn("closed", (F.col("seen") >= last) & (F.col("failure_share") > most))


def top_messages(rows: DataFrame, text: str, most: int = 5) -> DataFrame:
    """The most frequent texts as `text (xN)`; ties by text."""
    return rows.groupBy(text).agg(F.count("*").alias("n")).orderBy(F.desc("n"), text).limit(most).select(F.concat(F.col(text), F.lit(" (x"), F.col("n").cast("string"), F.lit(")")).alias("message"), "n")
