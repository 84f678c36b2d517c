"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _with_least(links: DataFrame, compression: str) -> tuple[DataFrame, DataFrame]:
    """links u, v with m, the smallest of u and all its v, and the table of these. The minima are written first: then both sides of the join are plain shuffles, and Spark splits a node that has very many links."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least", compression)
    return links.join(least, F.col("u") == F.col("w")).select("u", "v", "m"), least


def _settled(links: DataFrame) -> bool:
    """Whether links (u > v) are stars: each u has one v, and no v is a u."""
    if not links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return links.join(links.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()


def components(links: DataFrame, rounds: int = 60, compression: str = "zstd") -> DataFrame:
    """links: long columns a, b. Returns node, root (the smallest node of its component) for nodes with links.

    Each round keeps at most as many links as before, so nothing grows; a round's only shuffles are a
    grouped minimum, which is combined before the shuffle, and an equality join, which Spark can split
    where one node has many links. Rounds grow with the logarithm of the longest path.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", compression)
    for _ in range(rounds):
        if _settled(now):
            break
        both, least = _with_least(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), compression)
        large = written(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large", compression)
        dropped(now, least)
        joined, least = _with_least(large, compression)
        small = joined.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
        now = written(small.where("u <> v").distinct(), "links", compression)
        dropped(large, least)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
