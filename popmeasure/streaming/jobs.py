"""Structured Streaming jobs on event streams.

State is kept by RocksDB on the executors' disks and checkpointed as changes, so a batch costs what it brings, not what there
is. Each run takes what has arrived since the last one and stops; the checkpoint carries state and watermark on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """The session's settings of state stores, for as long as a stream starts and runs."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arriving(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet files of a folder as a stream: each file once, also those that are put there later, by whichever writer."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def failure_rates(stream: DataFrame, failed: Column, time: str = "ts", width: str = "1 day", late: str = "2 days", most: float = 0.75) -> DataFrame:
    """Failures in each time window, and whether their share is above `most`. For append mode: a window comes once, when the watermark
    has passed its end; then its state is dropped, and rows for it that come later are."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    return counts.select(F.col("w.start").alias("start"), "n", "failures", (F.col("failures") / F.col("n")).alias("share"), (F.col("failures") / F.col("n") > most).alias("closed"))


def last_outcomes(stream: DataFrame, key: str, time: str, order: str, failed: Column, width: int, keep: int, late: str, last: int = 20, most: float = 0.75) -> DataFrame:
    """key, start, seen, share, closed: for each key and time window with rows, the share of failures among its last outcomes as of the window's end.

    Of the outcomes of the last `keep` seconds before the end the `last` newest count (ties in time by order, a whole number);
    the gate is closed where all of them are there and more than `most` failed. For append mode: a window comes once, when the
    watermark (`late` behind the newest row) has passed its end; rows that come later than that are dropped. width and keep in seconds.

    Three aggregates follow each other: rows wait until the watermark passes them (so what is late is told by rows, not by windows),
    a window hands on its last outcomes, and these meet those of the windows before, in windows of `keep` that end where each does.
    State is by key and time, with outcomes of open windows and `last` of each closed one, and ends when the watermark has passed it.
    """
    parts, span = -(-keep // width), f"{width} seconds"
    rows = stream.select(F.col(key).cast("string").alias(key), F.col(time).alias("__time"), F.struct(F.unix_micros(time).alias("at"), F.col(order).cast("long").alias("id"), F.coalesce(failed, F.lit(False)).alias("failed")).alias("o"))
    newest = lambda c: F.slice(F.sort_array(c, asc=False), 1, last)
    heard = rows.withWatermark("__time", late).groupBy(key, "__time").agg(F.collect_list("o").alias("o"))
    windows = heard.groupBy(key, F.window("__time", span).alias("w")).agg(newest(F.flatten(F.collect_list("o"))).alias("o"))
    windows = windows.select(key, F.window_time("w").alias("__time"), F.unix_micros("w.end").alias("end"), "o")
    gates = windows.groupBy(key, F.window("__time", f"{parts * width} seconds", span).alias("w")).agg(F.max("end").alias("end"), F.flatten(F.collect_list("o")).alias("o"))
    young = newest(F.filter("o", lambda x: x["at"] >= F.col("end") - keep * 1_000_000))
    own = gates.where(F.unix_micros("w.end") == F.col("end")).select(key, F.timestamp_micros(F.col("end") - width * 1_000_000).alias("start"), young.alias("o")).where(F.size("o") > 0)
    share = F.size(F.filter("o", lambda x: x["failed"])) / F.size("o")
    return own.select(key, "start", F.size("o").cast("long").alias("seen"), share.alias("share"), ((F.size("o") >= last) & (share > most)).alias("closed"))


def first_of_keys(stream: DataFrame, key: list[str]) -> DataFrame:
    """Of each key one row, of the batch that has it first; for append mode. Keys are state on disk: a batch looks up its own keys, however many there are, and reads nothing of what was written before."""
    return stream.dropDuplicates(key)


def option_counts(stream: DataFrame, group: list[str], weight: str) -> DataFrame:
    """Running counts and weights of each option, for update mode. on_grid() joins them to a static grid batch by batch."""
    return stream.groupBy(*group).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))


def on_grid(grid: DataFrame, keys: list[str]) -> Callable[[DataFrame, int], DataFrame]:
    """For run_once(): each batch's counts over all options of a static grid; options without answers in it have 0."""

    def prepare(df: DataFrame, batch: int) -> DataFrame:
        return grid.join(df, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weight", F.lit(0.0)).alias("weight"))

    return prepare


def with_batch(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", prepare: Callable[[DataFrame, int], DataFrame] | None = None, seen: list | None = None) -> DataFrame:
    """Runs the stream over what is there now and stops. Returns what was written, in all runs: the stream's columns (or prepare's) and batch.

    Each batch has a folder named by its number and replaces it as a whole, so a batch that is run again after a failure doubles
    nothing. Nothing passes through the driver. `seen` takes the progress reports of this run.
    """

    def sink(df: DataFrame, batch: int) -> None:
        rows = prepare(df, batch) if prepare else df
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    spark = stream.sparkSession
    with state_on_disk(spark):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.foreachBatch(sink).start()
        query.awaitTermination()
        if seen is not None:
            seen += [p.json for p in query.recentProgress]
    return spark.read.schema(with_batch(stream)).option("basePath", path).parquet(f"{path}/batch=*")
