"""Daily counts whose late rows are kept, and whose state is freed (ST3, ST1).

A windowed aggregate drops rows that come after their window has closed, so its delay has to cover any
disorder and its state is never freed.  Here the delay can be short:

* a day and label is one key with one counter and a timer at the day's end;
* when the watermark passes the timer, the count goes out as ``closed`` and the state is removed;
* a row of a day that has closed goes out as ``late``, on its own, into the side table.

The counts of a day are the closed count plus its late rows; what is still open lies in the state and
is read back with the state data source.  State is bounded by the days within the delay times labels.

The watermark column itself is dropped before the stateful step (its rows carry a copy), because the
step's own late-row filter would discard late rows unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postlens.session import scratch_path, ship

OUT = "day string, label int, kind string, n long, row_id long"
NO_LABEL = -1                          # keys hold no nulls
DAY_MS = 86_400_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DayCounter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def _rows(self, key, kind: str, n: list[int], ids: list[int]) -> pd.DataFrame:
        day, label = key
        return pd.DataFrame({"day": [day] * len(n), "label": pd.Series([label] * len(n), dtype="int32"), "kind": [kind] * len(n),
                             "n": pd.Series(n, dtype="int64"), "row_id": pd.Series(ids, dtype="int64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the watermark is the newest time seen less the delay
        end = pd.Timestamp(key[0], tz="UTC").value // 1_000_000 + DAY_MS
        if end <= timerValues.getCurrentWatermarkInMs():
            for part in rows:
                yield self._rows(key, "late", [1] * len(part), part["row_id"].tolist())
            return
        n = sum(len(part) for part in rows)
        if self.count.exists():
            n += self.count.get()[0]
        else:
            self.handle.registerTimer(end)
        self.count.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        self.count.clear()
        yield self._rows(key, "closed", [n], [-1])

    def close(self) -> None:
        pass


def day_counts(events: DataFrame, ts: str, label: str, row_id: str, delay: str) -> DataFrame:
    """Stream of (day, label, kind, n, row_id): closed counts, and every late row with its id."""
    spark = events.sparkSession
    ship(spark)
    x = (events.withWatermark(ts, delay)
         .select(F.date_format(ts, "yyyy-MM-dd").alias("day"), F.coalesce(F.col(label).cast("int"), F.lit(NO_LABEL)).alias("label"),
                 F.col(row_id).cast("long").alias("row_id")))
    return x.groupBy("day", "label").transformWithStateInPandas(
        statefulProcessor=DayCounter(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run_day_counts(events: DataFrame, ts: str, label: str, row_id: str, delay_days: int = 7) -> tuple[str, str]:
    """Run over all that has landed; (folder of the results, by kind; folder of the checkpoint)."""
    spark = events.sparkSession
    out, ckpt = scratch_path(spark, "days-out"), scratch_path(spark, "days-ckpt")
    old = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)           # the only store that keeps timers
    try:
        q = (day_counts(events, ts, label, row_id, f"{delay_days} days").writeStream
             .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True)
             .format("parquet").partitionBy("kind").start(out))
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, old)
    return out, ckpt


def open_days(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(day, label, n) still in the state of a stopped run, read with the state data source."""
    s = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "count").load()
    return s.select(F.col("key.day").alias("day"), F.col("key.label").alias("label"), F.col("value.n").alias("n"))


def all_counts(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """(day, label, n_closed, n_late, n_open, n) of a run."""
    schema = "day string, label int, n long, row_id long, kind string"
    r = spark.read.schema(schema).parquet(out).select("day", "label", "kind", "n")
    every = r.unionByName(open_days(spark, checkpoint).withColumn("kind", F.lit("open")))
    return every.groupBy("day", "label").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in ("closed", "late", "open")],
        F.sum("n").alias("n"))
