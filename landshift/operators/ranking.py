"""Positions in a total order without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.session import cut_lineage


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based position of every row in the given order.

    A range-partitioned sort fixes the order and rows are stored once with their place in their partition; only one
    count per partition is ordered centrally.
    """
    # The id is the partition in its upper bits and the place in the sorted partition in the lower 33.
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    task, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    counts = placed.groupBy(task.alias("_p")).agg(F.count("*").alias("_n"))
    before = cut_lineage(counts.select("_p", F.coalesce(
        F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    return placed.join(before, task == F.col("_p")).withColumn(
        name, inside + 1 + F.col("_before")
    ).drop("_p", "_at", "_before")
