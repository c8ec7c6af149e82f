"""Places of rows in a total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored


def numbered(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """df with each row's place, from 0, in an order (nulls first) that should have no ties.

    Rows are parted by ranges of the order and sorted within their part; the parts' sizes, one row a task, are summed up. The rows are
    stored in between, so later reads see one numbering even if the order has ties.
    """
    at = F.col("_at")
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = rows.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row a task of the sort
    out = rows.withColumn("_part", F.shiftright(at, 33)).join(sizes, "_part")
    return out.withColumn(name, F.col("_before") + at.bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")
