"""Registered queries: a DataFrame plan and, where SQL can express it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Digits that doubles are compared to.
DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS digits without a negative zero, whole numbers as bigint."""
    kinds = {"double": lambda c: F.round(c, DIGITS) + F.lit(0.0), "float": lambda c: F.round(c.cast("double"), DIGITS) + F.lit(0.0)} | {k: (lambda c: c.cast("bigint")) for k in ("tinyint", "smallint", "int")}
    return df.select(*(kinds[kind](F.col(c)).alias(c) if kind in kinds else F.col(c) for c, kind in df.dtypes))


def register(name: str, plan: Callable[[SparkSession, str], DataFrame], body: str | None = None, views: str = "", doubles: str = "", ints: str = "") -> None:
    """body: SQL over the driver's tables and the named views of fixtures; doubles and ints: its columns to round, or to make bigint."""
    PLANS[name] = lambda spark, sf_dir: tidy(plan(spark, sf_dir))
    if body:
        new = [f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
        whole = f"SELECT * REPLACE ({', '.join(new)}) FROM ({body}) AS result" if new else body
        ORACLES[name] = fixtures.sql(whole, *views.split())
