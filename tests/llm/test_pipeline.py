"""The stages of the pipeline, one after another."""

import corpus_pipeline
import pyarrow as pa
import pytest

from popmeasure.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
    assert "ids" in docs.columns and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and all(len(r["ids"]) > 0 for r in rows.limit(20).collect())


@pytest.mark.parametrize("stage", ["quality_rules", "near_copies", "secret_scan", "tokens"])
def test_python_gets_few_rows_at_a_time(spark, stage):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).collect()
    rows = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
    spark.conf.set(name, before)
    assert sum(r["n"] for r in rows) == 5000 and max(r["n"] for r in rows) <= common.BATCH
