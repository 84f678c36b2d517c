"""What the text operators share: reading documents, and tables written to the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of a document whose id is null: before all others.
NULL_ID = -(2**63)
#: Rows that Spark and a Python worker hand to each other at a time, where a session runs many such steps.
BATCH = 1_000


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the place the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Lets the session hand rows to Python BATCH at a time at most (Spark's default is 10,000): texts of a whole task would lie outside the heap, and again in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own in local mode, where there is just one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """df, written once to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made and no result needs any more."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; one number reaches the driver."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def next_prime(n: int) -> int:
    while not is_prime(n):
        n += 1
    return n
