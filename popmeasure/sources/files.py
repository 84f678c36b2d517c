"""Readers and writers: columns and partitions are pruned by Spark, provenance comes from file paths."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def columnar(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only these columns of a Parquet table; a column that there isn't is an error that names it."""
    df = spark.read.parquet(path)
    require(df, columns)
    return df.select(*columns)


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, present, n: which of the wanted columns a table has, and how many of its values are there. One pass over those it has."""
    have = [c for c in columns if c in df.columns]
    counts = df.agg(*(F.count(c).alias(c) for c in have), F.lit(0).alias("__none"))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), (F.col(c) if c in have else F.lit(None).cast("long")).alias("n")) for c in columns))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def union_of_columns(*lists: list[str]) -> list[str]:
    """The lists' names, each once, in the order in which they first come."""
    return list(dict.fromkeys(c for names in lists for c in names))


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, and lines that are no JSON come with their text in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").json(path, mode="PERMISSIVE")


def map_of_maps(spark: SparkSession, path: str) -> DataFrame:
    """unit, dimension, z of JSON files like {"unit": {"dimension": z}}, each read as a whole, over however many lines. A file that isn't such an object is an error that names it."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = F.from_json("value", "map<string,map<string,double>>")
    sound = F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("no map of maps: "), "file")).cast("map<string,map<string,double>>"))
    return text.select(F.explode(sound).alias("unit", "m")).select("unit", F.explode("m").alias("dimension", "z"))


def there(spark: SparkSession, path: str) -> bool:
    """Whether the path, or anything that its pattern matches, is there; in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def families(spark: SparkSession, paths: dict[str, str], keep: list[str] | None = None, tag: str = "bank") -> DataFrame:
    """The Parquet files of several families (tag: path or pattern) with the family and file that each row is from.

    Columns may differ from file to file: each family has all that its files' footers have, and the union those of all families,
    or only `keep`; null where a file lacks one. Families that aren't there are skipped with a warning; their tags are in the
    result's `missing`. None at all is an error.
    """
    missing = [t for t, p in paths.items() if not there(spark, p)]
    if missing:
        warnings.warn(f"missing families, skipped: {', '.join(missing)}", stacklevel=2)
    if len(missing) == len(paths):
        raise ValueError(f"none of the families is there: {', '.join(missing)}")
    out = None
    for name, path in paths.items():
        if name not in missing:
            rows = spark.read.option("mergeSchema", True).parquet(path)
            rows = rows.select(*(c for c in rows.columns if keep is None or c in keep), F.lit(name).alias(tag), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    out.missing = missing
    return out


def waves(frames: list[DataFrame], keep: list[str] | None = None) -> DataFrame:
    """Union of waves whose columns differ: names in lower case, the first of repeated names, nulls where a wave lacks one.

    Only `keep`, or all columns in the order in which they first come.
    """
    out = None
    keep = keep or union_of_columns(*([c.lower() for c in df.columns] for df in frames))
    for df in frames:
        names = [c.lower() for c in df.columns]
        seen = [f"__{k}" if c in names[:k] else c for k, c in enumerate(names)]
        part = df.toDF(*seen).select(*(c for c in keep if c in seen))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*(c for c in keep if c in out.columns))


def ordered_columns(df: DataFrame, front: list[str]) -> DataFrame:
    """The contract's columns first, the others after."""
    return df.select(*front, *(c for c in df.columns if c not in front))


def write_by_unit(df: DataFrame, path: str, unit: str = "unit", files_per_unit: int = 1) -> None:
    """One folder a unit. With more files, a unit's rows are spread by hash so that a large one isn't a single task."""
    salt = F.pmod(F.xxhash64(*(c for c in df.columns if c != unit)), F.lit(files_per_unit))
    df.repartition(unit, salt).write.mode("overwrite").partitionBy(unit).parquet(path)


def write_both(df: DataFrame, path: str, by: list[str]) -> None:
    """CSV and JSON lines, in a folder for each value of `by`."""
    df.write.mode("overwrite").partitionBy(*by).csv(f"{path}/csv", header=True)
    df.write.mode("overwrite").partitionBy(*by).json(f"{path}/json")


def manifest(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per group: rows and each column's share of values that are there. One pass."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(F.col(c).isNotNull().cast("double")).alias(f"share_{c}") for c in columns))


def append_new(new: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Appends rows whose key the cache at path lacks, once each; returns the rows of the cache.

    Rows go to the cache's inbox, where any number of writers may put theirs, and a streaming job takes what is new there. Which keys
    there are is its state, so an append looks up its own keys and reads nothing of what was written before; a row that comes
    twice, from a writer that tried again or from two of them, counts once.
    """
    from ..streaming import jobs

    new.write.mode("append").parquet(f"{path}/inbox")
    rows = jobs.arriving(new.sparkSession, f"{path}/inbox", new.schema)
    return jobs.run_once(jobs.first_of_keys(rows, key), f"{path}/rows", f"{path}/state").drop("batch")
