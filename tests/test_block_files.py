"""Blocks of many rows lie few to a file, so that a reader, which unpacks thousands of values of a file at once, holds few."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from touchline.operators import logistic, tree_passes, trees
from touchline.operators.logistic import Logistic
from touchline.operators.trees import Boosted


def rows_in_files(frame):
    return [pq.ParquetFile(f.removeprefix("file:")).metadata.num_rows for f in frame.inputFiles()]


def table(spark):
    return spark.range(0, 2_000, 1, 2).select(
        F.col("id").alias("match_id"), F.array(F.lit(1).cast("long")).alias("folds"), F.rand(1).alias("a"), (F.col("id") % 3).cast("double").alias("label"))


def test_packed_rows_lie_few_to_a_file(spark, monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK_ROWS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    written, settle = [], logistic.settle
    monkeypatch.setattr(logistic, "settle", lambda *a: written.append(settle(*a)) or written[-1])
    try:
        assert logistic.fit_many(table(spark), {"plain": Logistic()}, [1], ["a"])[1, "plain"].rows == 2_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = rows_in_files(written[0])
    assert sum(counts) == 200 and max(counts) <= logistic.FILE_BLOCKS


def test_binned_rows_lie_few_to_a_file(spark, monkeypatch):
    monkeypatch.setattr(trees, "IN_TASK_ROWS", 0)
    monkeypatch.setattr(tree_passes, "STRETCH_ROWS", 20)
    written, settle = [], tree_passes.settle
    monkeypatch.setattr(tree_passes, "settle", lambda *a: written.append(rows_in_files(got := settle(*a))) or got)
    fits = trees.fit_many(table(spark), {"boosted": Boosted(rounds=1, depth=1)}, [1], ["a"])
    assert set(fits) == {(1, "boosted")} and all(sum(c) == 100 and max(c) <= tree_passes.FILE_BLOCKS for c in written[-2:])
