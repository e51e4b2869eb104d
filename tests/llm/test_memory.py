"""What executors hold beside the JVM: one pool of Python workers, which give back what their tasks have freed."""

import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewake.llm import mixing
from framewake.llm.common import local_frame, mapped

DATA = "/root/testdata/sf0.001"


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_tasks_give_back_what_they_free():
    class Frame:
        def mapInArrow(self, task, schema):
            return task

    left = []

    def run(batches):
        # Blocks too small to be mapped, the last of which outlives the task and keeps those below it from going by themselves.
        blocks = [np.ones(12_000) for _ in range(2000)]
        left.append(blocks[-1])
        yield held_mb()

    before = held_mb()
    (most,) = mapped(Frame(), run, "")(iter(()))
    assert most > before + 150 and held_mb() < before + 50


def test_rows_of_the_driver(spark):
    schema = "s string, b int, n array<int>, c double"
    rows = [("x", 1, [1, 2], 0.5), (None, 2, [], None), ("ü", 3, None, 2.0)]
    got = local_frame(spark, rows, schema)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows)) and got.schema == spark.createDataFrame(rows, schema).schema
    assert local_frame(spark, [], schema).count() == 0 and local_frame(spark, [], schema).columns == got.columns


def test_mixing_starts_no_python_workers(spark):
    """A list handed to createDataFrame is an RDD that Python workers read, apart from those of mapInArrow."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for df in (mixing.mix(docs), mixing.assign(docs.select("doc_id", "text", F.lit("one").alias("source")))):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString() and df.count() > 0
