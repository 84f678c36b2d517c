"""Contracts: rules about a table, each checked in the same pass and reported as a row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import written
from .order import alike


def expect(df: DataFrame, rules: dict[str, Column], stop: bool = False) -> DataFrame:
    """check, passed, observed: for each rule how many rows break it (a null counts as broken), from one aggregate over df."""
    broken = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    rows = broken.unpivot([], list(rules), "check", "observed").withColumn("passed", F.col("observed") == 0)
    if stop:
        rows = rows.where(F.when(F.col("passed"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("broken: "), "check")).cast("boolean")))
    return rows.select("check", "passed", "observed")


def checked_write(df: DataFrame, path: str, rules: dict[str, Column], stop: bool = True) -> DataFrame:
    """Writes df as Parquet and checks the rules in the same pass: check, passed, observed, as of expect().

    Rows are counted as they are written, to a folder beside the path, which becomes the path only when all is well: with stop, a broken
    rule is an error that names it, and nothing is at the path.
    """
    spark, seen = df.sparkSession, Observation()
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"rule{k}") for k, rule in enumerate(rules.values())]
    pending = f"{path}.pending-{uuid.uuid4().hex}"
    df.observe(seen, *counts).write.parquet(pending)
    found = [(name, seen.get[f"rule{k}"] == 0, seen.get[f"rule{k}"]) for k, name in enumerate(rules)]
    broken = [name for name, passed, _ in found if not passed]
    if stop and broken:
        raise ValueError(f"broken: {', '.join(broken)}")
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (pending, path))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"{path} can't be put in place")
    return spark.createDataFrame(found, "check string, passed boolean, observed long")


def unique_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys, and how many of them are repeated."""
    return df.groupBy(*key).count().agg(F.count("*").alias("keys"), F.count_if(F.col("count") > 1).alias("repeated"))


def many_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left joined with right, whose keys must be unique and must cover left: each is checked as rows pass, by value and not by a second job."""
    once = right.groupBy(*key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in right.columns if c not in key))
    sure = F.when(F.col("__n") == 1, F.lit(True)).when(F.col("__n").isNull(), F.raise_error(F.lit("the join would lose rows")).cast("boolean")).otherwise(F.raise_error(F.lit("a key is repeated")).cast("boolean"))
    return left.join(once, key, "left").where(sure).drop("__n")


def probabilities_sum(df: DataFrame, cell: list[str], prob: str = "prob", within: float = 1e-8) -> DataFrame:
    """One row: cells, and how many whose probabilities don't sum to 1."""
    return df.groupBy(*cell).agg(F.sum(prob).alias("s")).agg(F.count("*").alias("cells"), F.count_if(F.abs(F.col("s") - 1) > within).alias("broken"))


def same_as(df: DataFrame, stored: DataFrame, key: list[str], value: str, within: float = 5e-5) -> DataFrame:
    """One row: keys of either, how many only one has, how many differ by more than `within`."""
    both = df.select(*key, F.col(value).alias("a")).join(stored.select(*key, F.col(value).alias("b")), key, "full")
    return both.agg(F.count("*").alias("keys"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("only_one"), F.count_if(F.abs(F.col("a") - F.col("b")) > within).alias("different"))


def profile(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Rows and, for each column, its share of values that are there: one pass."""
    group = group or []
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.count("*").alias("n"), *(F.avg(F.col(c).isNotNull().cast("double")).alias(f"share_{c}") for c in rest))


def record_fields(record: Column, fields: list[str]) -> Column:
    """Of a JSON object: which of the fields it lacks and which it has beside them."""
    have = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    want = F.array(*(F.lit(f) for f in fields))
    return F.struct(F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("extra"))


def normalised_answers(raw: DataFrame, text: str, schema: str) -> DataFrame:
    """raw with parsed (by schema) and reason: empty, no object, not JSON, or null where all is well. Bad rows stay, to be set aside."""
    from ..functions.columns import repaired_json

    body = repaired_json(F.col(text))
    out = raw.withColumn("__body", body).withColumn("parsed", F.from_json("__body", schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    reason = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "empty").when(F.coalesce(F.col("__body"), F.lit("")) == "", "no object").when(F.col("parsed.__bad").isNotNull(), "not JSON")
    return out.withColumn("reason", reason).drop("__body")


def answer_validity(answers: DataFrame, spec: DataFrame, order: list[str]) -> DataFrame:
    """policy, unit, n_questions, valid, valid_rate, truncated: of each policy's answers for a unit, one an item (the first by order).

    answers: policy, unit, item, answer, truncated. spec: item and its codes (an array); an answer that is null or no code isn't valid.
    The least of the first column of order is found by itself, as a number that is updated in place; whole rows are compared, and
    sorted for it, only where they have it.
    """
    cell, lead = ["policy", "unit", "item"], order[0]
    # Null comes first in an order.
    least = answers.groupBy(*cell).agg(F.when(~F.bool_or(F.col(lead).isNull()), F.min(lead)).alias(lead))
    answers = alike(answers, written(least, "least"), [*cell, lead])
    first = answers.groupBy("policy", "unit", "item").agg(F.min_by(F.struct("answer", "truncated"), F.struct(*order)).alias("a"))
    valid = F.coalesce(F.array_contains("codes", F.col("a.answer")), F.lit(False))
    rows = first.join(spec.select("item", "codes"), "item", "left").withColumn("ok", valid)
    return rows.groupBy("policy", "unit").agg(F.count("*").alias("n_questions"), F.count_if("ok").alias("valid"), F.avg(F.col("ok").cast("double")).alias("valid_rate"), F.count_if("a.truncated").alias("truncated"))


def missing_cells(rows: DataFrame, cell: list[str], wanted: DataFrame) -> DataFrame:
    """The cells of wanted (its columns `cell`) that rows lack."""
    return wanted.select(*cell).distinct().join(rows.select(*cell).distinct(), cell, "left_anti")


def complete_only(result: DataFrame, lacking: DataFrame) -> DataFrame:
    """result, or no row of it while anything is lacking."""
    return result.crossJoin(F.broadcast(lacking.agg(F.count("*").alias("__lacking")))).where("__lacking = 0").drop("__lacking")


def stage_report(receipts: DataFrame, stages: list[str]) -> DataFrame:
    """Per run: the newest receipt of each stage; stages that lack one or failed, whether hashes differ, and whether all is well."""
    newest = receipts.groupBy("run_id", "stage").agg(F.max_by(F.struct("status", "protocol_hash"), F.struct("mtime", "status", "protocol_hash")).alias("r"))
    out = newest.groupBy("run_id").agg(F.sort_array(F.collect_set("stage")).alias("have"), F.count_distinct("r.protocol_hash").alias("hashes"), F.count_if(F.col("r.status") != "ok").alias("failed"))
    missing = F.array_sort(F.array_except(F.array(*(F.lit(s) for s in stages)), F.col("have")))
    return out.withColumn("missing", missing).withColumn("ok", (F.size("missing") == 0) & (F.col("hashes") == 1) & (F.col("failed") == 0)).drop("have")
