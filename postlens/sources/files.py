"""File sources and sinks (S1-S13): typed JSON / CSV / Parquet, file catalogues from file metadata.

Reads always pass an explicit schema (no inference pass over the data); writes are partitioned by
platform so later reads prune directories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST_FIELDS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("date_text", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("sentiment", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])

ANALYSIS_CSV = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("platform", T.StringType()), T.StructField("published_date", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("sentiment", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])

# CSV null marker, so that empty strings and nulls survive a round trip as themselves
NULL_MARK = "\\N"

# dataset name: <platform>_<count>_<keywords>_<yyyyMMdd_HHmmss>
DATASET_NAME_RE = "^(.+?)_(\\d+)_(.+)_(\\d{8}_\\d{6})$"


def write_json(df: DataFrame, path: str, partition_by: str | None = "platform") -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Every JSON file under ``path`` with a fixed schema (a JSON array per file when
    ``multi_line``); partition directories become columns."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header; an empty frame keeps its schema."""
    (df.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", '""').option("nullValue", NULL_MARK).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("emptyValue", "").option("nullValue", NULL_MARK).csv(path))


def append_history(df: DataFrame, path: str, run: str) -> None:
    """Add the entries of analysis runs; entries of the same run (column ``run``) are replaced, so a
    repeated run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def file_table(spark: SparkSession, path: str, fmt: str = "json", schema=None) -> DataFrame:
    """Rows with their file's path, name and modification time (hidden ``_metadata`` column)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_name").alias("file_name"),
                     F.col("_metadata.file_modification_time").alias("file_mtime"))


def read_newest(spark: SparkSession, path: str, fmt: str, schema: str, names: DataFrame, partition: str,
                group, order, options: dict | None = None) -> DataFrame:
    """The rows of the newest dataset of each ``group``; later ``order`` is newer, the name
    breaks ties.  Only the newest directories are read.

    ``names`` has one column with dataset names (the ``partition`` directories); ``group`` and ``order``
    are made from it.  The driver gets one name per group, a platform.
    """
    newest = names.distinct().groupBy(group.alias("_g")).agg(F.max_by(partition, F.struct(order, F.col(partition))).alias("_n"))
    picked = [r["_n"] for r in newest.collect()]
    rows = spark.read.format(fmt).schema(f"{schema}, {partition} string").options(**(options or {})).load(path)
    return rows.where(F.col(partition).isin(picked))


def dataset_of(file_path) -> F.Column:
    """dataset directory name of a written file (``.../<dataset>=<name>/part-...``)."""
    return F.regexp_extract(file_path, "dataset=([^/]+)/[^/]*$", 1)


def parse_dataset_name(name) -> list[F.Column]:
    """X11 contract: platform, count, keywords, stamp parsed by one anchored regex."""
    return [F.regexp_extract(name, DATASET_NAME_RE, i) for i in (1, 2, 3, 4)]
