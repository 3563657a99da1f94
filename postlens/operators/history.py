"""Quality measures kept as mergeable daily sketches.

Each day's posts become one row per platform and day: plain counts, a HyperLogLog sketch of distinct
addresses and KLL sketches of lengths and confidences.  The rows of any span are merged without reading a
post again.  Rows lie in a folder for each month, the unit that is written: months written again replace
themselves and no other (dynamic partition overwrite), so a repeated run changes nothing.

Bounds: a HyperLogLog of 2**``LG_K`` registers errs by about 1.6 % (one standard error), KLL with k =
``KLL_K`` by about 1.3 % of rank; both are exact for small groups (up to some hundred values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import text as T

LG_K, KLL_K = 12, 200
QUANTILES = {"median": 0.5, "p90": 0.9}


def daily_sketches(posts: DataFrame, day: str = "base_date") -> DataFrame:
    """A row for each platform and day of ``posts`` (platform, url, content, confidence, ``day``)."""
    size = F.length("content").cast("long")
    return (posts.groupBy("platform", F.col(day).cast("date").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content").isNull() | T.is_blank(F.col("content"))).alias("n_blank"),
                 F.count_if(F.col("url").rlike("^https?://[^/]+")).alias("n_url"),
                 F.hll_sketch_agg(F.coalesce("url", F.lit("")), F.lit(LG_K)).alias("urls"),
                 F.kll_sketch_agg_bigint(F.coalesce(size, F.lit(0)), F.lit(KLL_K)).alias("sizes"),
                 F.kll_sketch_agg_double(F.coalesce("confidence", F.lit(0.0)), F.lit(KLL_K)).alias("confidences")))


def write_months(rows: DataFrame, path: str) -> None:
    """``rows`` hold whole months."""
    (rows.withColumn("month", F.date_format("day", "yyyy-MM")).hint("rebalance", F.col("month"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def merge_span(spark: SparkSession, path: str, schema, first: str, last: str, by: list) -> DataFrame:
    """The measures of ``by`` from the sketches of the days first..last; only their months are read."""
    rows = spark.read.schema(schema).parquet(path).where(
        F.col("month").between(first[:7], last[:7]) & F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    m = rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_blank").alias("n_blank"), F.sum("n_url").alias("n_url"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"), F.hll_union_agg("urls").alias("_u"), F.kll_merge_agg_bigint("sizes").alias("_s"),
        F.kll_merge_agg_double("confidences").alias("_c"))
    keys = m.columns[:len(by)]
    return m.select(*keys, "n", "n_blank", F.round(F.col("n_url") * 100.0 / F.col("n"), 6).alias("url_valid_pct"), "first_day", "last_day",
                    F.hll_sketch_estimate("_u").alias("n_urls"),
                    *[F.kll_sketch_get_quantile_bigint("_s", F.lit(q)).alias(f"size_{k}") for k, q in QUANTILES.items()],
                    *[F.round(F.kll_sketch_get_quantile_double("_c", F.lit(q)), 6).alias(f"confidence_{k}") for k, q in QUANTILES.items()])
