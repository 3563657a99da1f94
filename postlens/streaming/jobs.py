"""Structured Streaming jobs (ST1-ST3) over file drops.

Each job reads a directory (or glob) of landed Parquet files with a fixed schema, checkpoints in
the shared checkpoint folder (restarts resume exactly-once from the offsets log after a lost
executor or driver), and writes to a sink there.  ``run_available_now`` processes everything that
has landed and stops, which is also how the batch-equivalence tests drive them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """ST2: file-drop source.  Without ``max_files`` a micro-batch takes all that has landed, so a
    backlog is read before any watermark moves, in whatever order its files lie."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available_now(df: DataFrame, name: str, output_mode: str = "append",
                      foreach_batch=None, at: tuple[str, str] | None = None) -> str:
    """Run a streaming frame to completion with ``availableNow``; returns the sink path.  ``at`` names
    sink and checkpoint, to go on where an earlier run stopped."""
    spark = df.sparkSession
    out, ckpt = at or (scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt"))
    w = df.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(lambda b, bid: foreach_batch(b, bid, out)).start()
    else:
        q = w.format("parquet").start(out)
    q.awaitTermination()
    return out


def dedup_within_watermark(df: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """ST1: drop a key seen again within ``delay`` of its first arrival (state kept per key only
    until the watermark passes)."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, ts: str, label: str, window: str = "1 day",
                    delay: str = "36500 days") -> DataFrame:
    """ST3: counts per (window, label).  Rows later than ``delay`` behind the newest are dropped, so
    the delay must cover the disorder of all files that will ever land.  The state is one row per
    window and label; for days the default of a century is 36,500 rows a label, and no row is late.
    Pass a shorter delay only where files land in time order.
    """
    return (df.withWatermark(ts, delay)
            .groupBy(F.window(ts, window).alias("w"), label).agg(F.count(F.lit(1)).alias("n")))


def append_batches(b: DataFrame, batch_id: int, out: str) -> None:
    """foreachBatch sink for update mode: every batch appended with its id; readers keep the
    latest version of each key (idempotent on replay: a re-run batch rewrites its own id)."""
    (b.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .parquet(f"{out}/batch_id={batch_id}"))
