"""Streams over several runs: late rows, state that ends, replays, two writers."""

import datetime
import json
import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from popmeasure.operators import quality as K
from popmeasure.sources import files
from popmeasure.sources.shared import scratch
from popmeasure.streaming import jobs

DAY, EVENT = 86400, "user_id string, ts timestamp, event_id long, bad boolean"


def at(day, hour=12):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=day)


def in_runs(spark, runs, schema, job, seen=None):
    inbox, path, state = (scratch(spark, x) for x in ("inbox", "out", "state"))
    out = None
    for rows in runs:
        made = spark.createDataFrame(rows, schema)
        made.write.mode("append").parquet(inbox)
        out = jobs.run_once(job(jobs.arriving(spark, inbox, made.schema)), path, state, seen=seen)
    return out


def rows_held(seen):
    """State rows after each batch."""
    return [sum(o["numRowsTotal"] for o in json.loads(p)["stateOperators"]) for p in seen]


def gate(stream):
    return jobs.last_outcomes(stream, "user_id", "ts", "event_id", F.col("bad"), DAY, 3 * DAY, "1 day", 3, 0.5)


def test_gates_close_by_the_last_outcomes(spark):
    first = [("u", at(0), 1, True), ("u", at(0, 13), 2, True), ("u", at(1), 3, False), ("v", at(1), 4, True)]
    late = [("u", at(0, 14), 9, True), ("u", at(5), 5, True), ("w", at(5, 15), 6, True)]  # event 9 is behind the watermark by then
    end = [("x", at(20), 7, False), ("x", at(21), 8, False), ("x", at(22), 10, False)]
    seen = []
    got = in_runs(spark, [first, [("v", at(3), 11, False)], late, end], EVENT, gate, seen)
    held = {(r["user_id"], r["start"].day): (r["seen"], round(r["share"], 3), r["closed"]) for r in got.collect()}
    assert got.count() == len(held)
    assert held == {
        ("u", 1): (2, 1.0, False),
        ("u", 2): (3, 0.667, True),
        ("v", 2): (1, 1.0, False),
        ("v", 4): (2, 0.5, False),
        ("u", 6): (1, 1.0, False),  # what was three days before doesn't count
        ("w", 6): (1, 1.0, False),
        ("x", 21): (1, 0.0, False),
    }
    # The state of keys that are silent ends: only x and its timers stay.
    assert max(rows_held(seen)) > rows_held(seen)[-1] and rows_held(seen)[-1] <= 4


def test_gates_are_aggregates_without_a_call_for_each_key(spark):
    path = scratch(spark, "none")
    rows = spark.createDataFrame([("u", at(0), 1, True)], EVENT)
    rows.write.parquet(path)
    plan = gate(jobs.arriving(spark, path, rows.schema))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Python" not in plan and "Pandas" not in plan


def test_rates_come_once_and_late_rows_go(spark):
    runs = [[("u", at(0), 1, True), ("u", at(0), 2, False), ("u", at(4), 3, True)], [("u", at(0), 4, True), ("u", at(4, 20), 5, True)], [("u", at(9), 6, True)]]
    seen = []
    got = in_runs(spark, runs, EVENT, lambda s: jobs.failure_rates(s, F.col("bad"), late="2 days"), seen)
    assert sorted((r["start"].day, r["n"], r["failures"]) for r in got.collect()) == [(1, 2, 1), (5, 2, 2)]
    assert max(rows_held(seen)) >= 2 and rows_held(seen)[-1] == 1


def test_a_batch_that_runs_again_doubles_nothing(spark):
    inbox, path, state = (scratch(spark, x) for x in ("inbox", "out", "state"))
    job = lambda: jobs.run_once(jobs.first_of_keys(jobs.arriving(spark, inbox, rows.schema), ["k"]), path, state)
    rows = spark.createDataFrame([(k % 7,) for k in range(30)], "k int")
    rows.write.mode("append").parquet(inbox)
    job()
    rows.select((F.col("k") + 4).alias("k")).write.mode("append").parquet(inbox)
    once = sorted(r["k"] for r in job().collect())
    assert once == list(range(11))
    # As after a failure between writing and committing: the last batch's commit is not there.
    commits = f"{urlparse(state).path}/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    os.remove(f"{commits}/{last}")
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    assert sorted(r["k"] for r in job().collect()) == once


def test_two_writers_and_a_cost_that_history_doesn_t_raise(spark):
    path, seen = scratch(spark, "cache"), []
    schema = "k int, v string"
    for run in range(3):
        rows = [(100 * run + k, "x") for k in range(100)]
        for part in (rows[:60], rows[40:]):  # two writers, who share keys
            spark.createDataFrame(part, schema).write.mode("append").parquet(f"{path}/inbox")
        stream = jobs.first_of_keys(jobs.arriving(spark, f"{path}/inbox", spark.createDataFrame([], schema).schema), ["k"])
        out = jobs.run_once(stream, f"{path}/rows", f"{path}/state", seen=seen)
        assert sorted(r["k"] for r in out.collect()) == list(range(100 * (run + 1)))
    reports = [json.loads(p) for p in seen if json.loads(p)["numInputRows"]]
    assert [r["numInputRows"] for r in reports] == [120] * 3 and [r["stateOperators"][0]["numRowsUpdated"] for r in reports] == [100] * 3


def test_append_new_returns_the_cache(spark):
    path = scratch(spark, "cache")
    make = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "k int, v string")
    files.append_new(make(1, 2, 2), path, ["k"])
    assert sorted(r["v"] for r in files.append_new(make(2, 3), path, ["k"]).collect()) == ["v1", "v2", "v3"]


def test_families(spark):
    path = scratch(spark, "families")
    spark.createDataFrame([(1, "a")], "k int, x string").write.parquet(f"{path}/one.parquet")
    spark.createDataFrame([(2, 5.0)], "k int, y double").write.parquet(f"{path}/one-more.parquet")
    spark.createDataFrame([(3, 7)], "k int, z int").write.parquet(f"{path}/two.parquet")
    with pytest.warns(UserWarning, match="skipped: gone"):
        out = files.families(spark, {"one": f"{path}/one*.parquet", "gone": f"{path}/gone*.parquet", "two": f"{path}/two.parquet"})
    assert out.missing == ["gone"] and set(out.columns) == {"k", "x", "y", "z", "bank", "file"}
    assert sorted((r["bank"], r["k"], r["x"], r["y"], r["z"]) for r in out.collect()) == [("one", 1, "a", None, None), ("one", 2, None, 5.0, None), ("two", 3, None, None, 7)]
    assert files.families(spark, {"two": f"{path}/two.parquet"}, ["k"]).columns == ["k", "bank", "file"]
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="none of the families"):
        files.families(spark, {"gone": f"{path}/gone"})


def test_map_of_maps_over_several_lines_and_files(spark):
    path = scratch(spark, "maps")
    spark.createDataFrame([('{"u": {"risk": 1.5,\n "trust": -2},\n "v": {}}',)], "t string").coalesce(1).write.text(path)
    spark.createDataFrame([('{"w": {"risk": null}}',)], "t string").coalesce(1).write.mode("append").text(path)
    assert sorted((tuple(r) for r in files.map_of_maps(spark, path).collect()), key=str) == [("u", "risk", 1.5), ("u", "trust", -2.0), ("w", "risk", None)]
    spark.createDataFrame([("[1, 2]",)], "t string").coalesce(1).write.mode("append").text(path)
    with pytest.raises(Exception, match="no map of maps"):
        files.map_of_maps(spark, path).collect()


def test_a_checked_write_reads_once_and_publishes_only_what_holds(spark):
    path, rules = scratch(spark, "checked"), {"known": F.col("x").isNotNull(), "small": F.col("x") < 10}
    source = scratch(spark, "source")
    spark.createDataFrame([(1,), (None,), (3,)], "x int").write.parquet(source)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.read.parquet(source).mapInArrow(counted, "x int")
    with pytest.raises(ValueError, match="broken: known"):
        K.checked_write(rows, path, rules)
    assert read.value == 3 and not files.there(spark, path)
    got = K.checked_write(rows, path, rules, stop=False)
    assert read.value == 6 and spark.read.parquet(path).count() == 3
    assert [tuple(r) for r in got.collect()] == [("known", False, 1), ("small", False, 1)]
    assert K.checked_write(rows.where("x is not null"), f"{path}-2", rules).where("passed").count() == 2
