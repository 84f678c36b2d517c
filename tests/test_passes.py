"""Order lines are read and shuffled once, and aggregates over them are updated in place."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from popmeasure.operators import quality as K
from popmeasure.operators import statistics as T
from popmeasure.plans import comparisons, measures, preferences  # noqa: F401
from popmeasure.plans import fixtures as X
from popmeasure.plans.registry import PLANS


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w1_bank_precedence", "a15_a16_metric_summary", "a16_summary_with_interval", "w4_pair_standing", "d9_classical_scaling", "d10_principal_axes", "d11_plane_ranks", "r10_rank_permutation"])
def test_results_come_from_sums_that_were_written(spark, name):
    assert not [f for f in PLANS[name](spark, DATA).inputFiles() if "lineitem" in f]


def test_lines_meet_orders_that_have_their_customers(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(X.lines(spark, DATA).select("unit", "source", "l_quantity"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 6 and sum("(o_custkey" in line for line in shuffled) == 1
    # The join with customers stands below the one with lines.
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert "l_orderkey" in joins[0] and "o_custkey" in joins[-1]


def test_value_counts_need_no_sort(spark):
    assert "SortAggregate" not in plan_of(PLANS["a38_value_counts"](spark, DATA))


def test_only_rows_with_the_least_lead_are_compared(spark):
    rows = [("p", "u", "i", "1", False, 5, 1), ("p", "u", "i", "9", True, 5, 0), ("p", "u", "i", "1", False, 7, 0), ("p", "u", "j", "1", True, None, 3), ("p", "u", "j", "9", False, 1, 0), ("p", None, "i", "1", True, 2, 2)]
    answers = spark.createDataFrame(rows, "policy string, unit string, item string, answer string, truncated boolean, a int, b int")
    spec = spark.createDataFrame([("i", ["1"]), ("j", ["1"])], "item string, codes array<string>")
    got = K.answer_validity(answers, spec, ["a", "b"])
    assert sorted(map(tuple, got.collect()), key=str) == [("p", "u", 2, 1, 0.5, 2), ("p", None, 1, 1, 1.0, 1)]
    assert "Join" in plan_of(got).split("min_by")[-1]  # below the comparison of rows


def test_draws_are_told_from_the_digest_without_numbers(spark):
    rows = spark.range(50).select(F.lit("g").alias("g"), "id", (F.col("id") * 1.5).alias("x"))
    plan = plan_of(T.poisson_mean(rows, ["g"], "x", "id", 20))
    assert "conv(" not in plan and "Exchange hashpartitioning(id" in plan
