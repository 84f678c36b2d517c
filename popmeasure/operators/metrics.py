"""Metrics between a policy's and a unit's distribution of an item, and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ["tvd", "jsd", "brier", "cross_entropy", "entropy_error", "abs_mean_error", "wasserstein"]


def _xlogy(p: Column, of: Column) -> Column:
    return F.when(p > 0, p * F.ln(of)).otherwise(0.0)


def jensen_shannon(base: str = "e", floor: float | None = None) -> Column:
    """Aggregate over options with p and q: zeros are skipped, or raised to `floor`; base e or 2."""
    p, q = F.col("p"), F.col("q")
    if floor is not None:
        p, q = F.greatest(p, F.lit(floor)), F.greatest(q, F.lit(floor))
    m = (p + q) / 2
    return 0.5 * F.sum(_xlogy(p, p / m) + _xlogy(q, q / m)) / (1.0 if base == "e" else F.ln(F.lit(2.0)))


def item_metrics(rows: DataFrame, cell: list[str], ordered: Column | None = None) -> DataFrame:
    """All metrics of each cell in one shuffle: rows has cell, value, p (unit) and q (policy).

    The running sums for the Wasserstein distance and the aggregate are grouped alike. Moments and the
    distance are null where `ordered` doesn't hold (null, not NaN, is what undefined means here).
    """
    over = W.partitionBy(*cell).orderBy("value")
    gap = F.lead("value").over(over) - F.col("value")
    run = lambda c: F.sum(c).over(over.rowsBetween(W.unboundedPreceding, 0))
    step = rows.withColumn("__w", F.coalesce(F.abs(run("p") - run("q")) * gap, F.lit(0.0)))
    clipped = F.greatest(F.least(F.col("q"), F.lit(1.0)), F.lit(1e-12))
    p, q, v = F.col("p"), F.col("q"), F.col("value")
    out = step.groupBy(*cell).agg(
        F.count("*").alias("n_options"),
        (0.5 * F.sum(F.abs(p - q))).alias("tvd"),
        jensen_shannon().alias("jsd"),
        F.sum((p - q) * (p - q)).alias("brier"),
        (-F.sum(p * F.ln(clipped))).alias("cross_entropy"),
        (-F.sum(_xlogy(p, p))).alias("entropy_p"),
        (-F.sum(_xlogy(q, q))).alias("entropy_q"),
        F.sum(p * v).alias("mean_p"),
        F.sum(q * v).alias("mean_q"),
        F.sum(p * v * v).alias("__pp"),
        F.sum(q * v * v).alias("__qq"),
        F.sum("__w").alias("wasserstein"),
        F.max_by("value", F.struct("p", -v)).alias("mode_p"),
        F.max_by("value", F.struct("q", -v)).alias("mode_q"),
    )
    spread = lambda s, m: F.sqrt(F.greatest(F.lit(0.0), F.col(s) - F.col(m) * F.col(m)))
    out = out.withColumns({"std_p": spread("__pp", "mean_p"), "std_q": spread("__qq", "mean_q")}).drop("__pp", "__qq")
    out = out.withColumns({"entropy_error": F.col("entropy_q") - F.col("entropy_p"), "mean_error": F.col("mean_q") - F.col("mean_p"), "abs_mean_error": F.abs(F.col("mean_q") - F.col("mean_p")), "std_error": F.col("std_q") - F.col("std_p"), "top_match": F.col("mode_p") == F.col("mode_q")})
    if ordered is None:
        return out
    return out.withColumns({c: F.when(ordered, F.col(c)) for c in ("mean_p", "mean_q", "std_p", "std_q", "mean_error", "abs_mean_error", "std_error", "wasserstein")})


def calibration_bins(rows: DataFrame, group: list[str], predicted: str = "q", observed: str = "p", bins: int = 10) -> DataFrame:
    """Equal bins, closed on the right, the lowest also on the left: group, bin, mean_predicted, mean_observed, n. Compared with literal edges.

    Sums are of whole numbers of 10^-12, so the same in any order.
    """
    at = sum(((F.col(predicted) > k / bins).cast("int") for k in range(1, bins)), F.lit(0))
    mean = lambda c: F.sum(F.round(F.col(c) * 1e12).cast("decimal(20,0)")).cast("double") / F.count("*") / 1e12
    return rows.withColumn("bin", at).groupBy(*group, "bin").agg(mean(predicted).alias("mean_predicted"), mean(observed).alias("mean_observed"), F.count("*").alias("n"))


def calibration_error(bins: DataFrame, group: list[str]) -> DataFrame:
    """Expected calibration error over the bins that have options."""
    return bins.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("mean_observed"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
