"""Positions of rows in one order over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltide.session import Scratch


def with_positions(df: DataFrame, *order: str, out: str = "position") -> DataFrame:
    """Each row's number from zero in the given order, which must be total.

    Rows are sorted in ranges and numbered in each; a range's first number is
    the count of all before it, and only those counts, one a range, are
    gathered. The ranges are written first, so that both reads see the same."""
    scratch = Scratch(df.sparkSession)
    at, within = F.spark_partition_id(), F.monotonically_increasing_id()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = scratch.table(ranged.select("*", at.alias("__range"), within.bitwiseAND((1 << 33) - 1).alias("__nth")), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")
    return numbered.select(*df.columns, (F.col("__before") + F.col("__nth")).alias(out))
