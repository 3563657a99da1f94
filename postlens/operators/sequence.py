"""Consecutive row numbers in a global order without a single-task window.

``row_number() over (order by k)`` with no partition moves every row into one task.  Here:
range-partition on ``k`` and sort inside partitions; ``monotonically_increasing_id`` then encodes
(partition, position); the per-partition counts (one row per partition, a bounded table) give
each partition its offset, which is broadcast back.  The numbered frame is checkpointed to the
shared checkpoint folder first so both passes see the same range boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.session import shared_dir


def with_row_index(df: DataFrame, order_col: str, out: str = "idx", start: int = 0) -> DataFrame:
    spark = df.sparkSession
    shared_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, F.col(order_col)).sortWithinPartitions(order_col)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", 33))
              .withColumn("_pos", F.col("_mid") - F.shiftleft("_pid", 33))
              .checkpoint(eager=True))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    numbered = ranged.join(F.broadcast(offsets), "_pid")
    return numbered.withColumn(out, F.col("_off") + F.col("_pos") + start).drop(
        "_mid", "_pid", "_pos", "_off")
