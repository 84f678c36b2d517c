"""Order among all rows without a task that sees them all: running totals over range partitions, and quantiles by histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import dropped, written


def alike(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys where null equals null; the left's keys stay. Without keys right is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    met = left.join(named, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys], how)
    return met.drop(*(f"__right_{k}" for k in keys))


def running_totals(rows: DataFrame, by: list[str], amount: Column, within: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with before (the sum of amount over the rows of the group that come earlier) and total (the group's). by tells any two rows of a group apart.

    Rows are dealt to range partitions by splits that Spark samples, and written, so that the splits stay. A partition's rows are then
    added up in their order, after the sums of the partitions before it: one number for each, all that is ever gathered of a group.
    """
    within = within or []
    ranged = rows.withColumn("__amount", amount).repartitionByRange(*([parts] if parts else []), *within, *by).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sums = ranged.groupBy(*within, "__part").agg(F.sum("__amount").alias("__sum"))
    sums = sums.groupBy(*within).agg(F.collect_list(F.struct("__part", "__sum")).alias("__sums"))
    met = alike(ranged, sums, within)
    adding = lambda keep: F.aggregate("__sums", F.lit(0).cast("long"), lambda t, s: t + F.when(keep(s["__part"]), s["__sum"]).otherwise(0))
    over = W.partitionBy(*within, "__part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    here = F.coalesce(F.sum("__amount").over(over), F.lit(0))
    out = met.withColumn("before", here + adding(lambda p: p < F.col("__part"))).withColumn("total", adding(lambda p: F.lit(True)))
    return out.drop("__amount", "__part", "__sums")


def quantiles(rows: DataFrame, group: list[str], value: str, probs: list[float], bins: int = 256, few: int = 4096) -> DataFrame:
    """group, n, q: the exact quantiles (linear between neighbours) of the finite values, in the order of probs.

    What is sought is the values at certain places of each group's order. All places lie between the group's least and greatest
    value at first; each round counts the values between in `bins` parts and goes on with the one that has the place, until it
    holds one value, or no more than `few` of them, which are then sorted. So a round reads the values once, shuffles counts
    (combined before), and no task ever gets a group's values, distinct or not. Rounds grow with the logarithm of the spread.
    """
    x = F.col(value).cast("double")
    data, own = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*group, x.alias("__x")), []
    if not hasattr(rows, "written_to"):
        data = written(data, "values")
        own = [data]
    facts = data.groupBy(*group).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("h")) for k, p in enumerate(probs)))
    facts = written(facts.withColumn("wanted", wanted), "value-facts")
    at = facts.select(*group, "n", "low", "high", F.explode(F.transform("wanted", lambda w: F.array(F.floor(w["h"]), F.ceil(w["h"])))).alias("ends"))
    places = at.select(*group, "n", "low", "high", F.explode("ends").alias("place")).distinct()
    # What is sought: the value at place, one of `inside` values from low to high, with `below` smaller ones.
    sought = written(places.select(*group, "place", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "sought")
    open_ = (F.col("low") < F.col("high")) & (F.col("inside") > few)
    while not sought.where(open_).isEmpty():
        between = alike(data, sought.where(open_), group).where("__x between low and high")
        # halves, so that the spread of the largest doubles is finite
        part = F.least(F.lit(bins - 1), F.floor((F.col("__x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins))
        counts = between.groupBy(*group, "place", "below", part.alias("bin")).agg(F.count("*").alias("c"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        over = W.partitionBy(*group, "place").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("c").over(over), F.lit(0)))
        found = counts.where((F.col("below") <= F.col("place")) & (F.col("place") < F.col("below") + F.col("c"))).select(*group, "place", "low", "high", "below", F.col("c").alias("inside"))
        before, sought = sought, written(found.unionByName(sought.where(~open_)), "sought")
        dropped(before)
    last = alike(data, sought.where("low < high"), group).where("__x between low and high").groupBy(*group, "place", "below").agg(F.sort_array(F.collect_list("__x")).alias("xs"))
    values = last.select(*group, "place", F.get("xs", (F.col("place") - F.col("below")).cast("int")).alias("v")).unionByName(sought.where("low = high").select(*group, "place", F.col("low").alias("v")))
    values = values.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at"))
    met = alike(facts.select(*group, "n", "wanted"), values, group)
    of = lambda h, end: F.element_at("at", end(h))
    exact = F.transform("wanted", lambda w: of(w["h"], F.floor) + (of(w["h"], F.ceil) - of(w["h"], F.floor)) * (w["h"] - F.floor(w["h"])))
    out = written(met.select(*group, "n", exact.alias("q")), "quantiles")
    dropped(*own, facts, sought)
    return out
