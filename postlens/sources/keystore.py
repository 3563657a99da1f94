"""Keys of everything collected so far, bucketed, so a day's posts meet them without moving them.

The store is a bucketed, sorted external table in a folder: each append writes sorted files of the same
buckets.  A day's distinct keys are dealt into the store's buckets and joined there; the store stays
where it is, the plan shows no exchange on its side.  Only the keys that it holds come back and are taken
from the day's rows by a join of its own, so a key that many rows share is split there.  Files carry their
bucket in their names, so a new session that declares the table over the same folder reads it alike.

Files are written with Parquet Bloom filters of the keys (1 MB a file at most), so lookups of a few keys
(``lookup``) skip row groups that can't hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import scratch_path

BUCKETS = 16


class KeyStore:
    """Keys (``key string``, ``seen string``: when) in ``path``; ``buckets`` is fixed for its life."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (key STRING, seen STRING) USING parquet
            OPTIONS ('parquet.bloom.filter.enabled#key' 'true', 'parquet.bloom.filter.max.bytes' '1048576')
            CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'""")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, keys: DataFrame) -> None:
        """Append (key, seen); one file for each bucket that gets some."""
        rows = keys.select(F.col("key").cast("string").alias("key"), F.col("seen").cast("string").alias("seen"))
        rows.repartition(self.buckets, "key").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def seen(self, rows: DataFrame, key: str) -> DataFrame:
        """The distinct keys of ``rows`` (``_key``) that the store holds."""
        day = rows.select(F.col(key).cast("string").alias("_key")).where("_key is not null").distinct()
        # an inner join, as a semi join would be pushed below the distinct
        both = day.repartition(self.buckets, "_key").join(self.read().select("key").hint("merge"), F.col("_key") == F.col("key"))
        return both.select("_key").distinct()

    def unseen(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key the store doesn't hold; null keys are never seen."""
        path = scratch_path(self.spark, "seen")
        self.seen(rows, key).write.parquet(path)
        known = self.spark.read.schema("_key string").parquet(path)
        return rows.join(known, F.col(key) == F.col("_key"), "left_anti")

    def lookup(self, keys: list[str]) -> DataFrame:
        """The entries of a few keys; buckets and row groups that can't hold them are skipped."""
        return self.read().where(F.col("key").isin(list(keys)))

    def drop(self) -> None:
        """Forget the table; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
