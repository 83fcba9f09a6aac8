"""Global positions without a single task: rows are numbered in ranges, whose sizes are summed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `position`, from 0, in the order of columns whose first is a string.

    Rows are put in ranges by the first characters of the first column, numbered in each range, and each
    range starts after the sizes of those before it.
    """
    head = F.substring(F.col(order[0]), 1, 2)
    sizes = df.groupBy(head.alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_head").rowsBetween(W.unboundedPreceding, -1)  # a row for each beginning
    starts = sizes.select("_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = df.withColumn("_head", head).join(starts, "_head")
    place = F.row_number().over(W.partitionBy("_head").orderBy(*order)) - 1
    return rows.withColumn("position", F.col("_start") + place).drop("_head", "_start")
