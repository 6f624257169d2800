"""Total order over a large table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import settle


def global_row_number(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Number all rows 1, 2, ... in ``order`` without bringing them into one task.

    Rows are range-partitioned and sorted in place; a row's number is its place in its partition plus
    the sizes of the partitions before it. The order must be total.
    """
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part")) - F.col("_n")  # one row per partition
    offsets = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(
        name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_place", "_before")
