"""Catalogue of landed files and of the analyses made of them.

Files are listed by their metadata alone: Spark's binary-file source with the content column pruned
opens no file.  Analyses are recorded in a history table, partitioned by run; a run that is repeated
under its id replaces its own rows (dynamic partition overwrite) and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

RUN = "input_file string, result_file string, models array<string>, item_count long, n_negative long, n_neutral long, n_positive long, run_id string"


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_path, file_name, size, mtime of every file at or below ``path``; no content is read."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
         .select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))
    return f.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))


def folders(files: DataFrame, name: str) -> DataFrame:
    """Datasets that land as folders ``name=<dataset>``: dataset, n_files, size, newest file's time."""
    dataset = F.regexp_extract("file_path", f"/{name}=([^/]+)/[^/]*$", 1)
    return (files.where(F.col("size") > 0).groupBy(dataset.alias("dataset"))
            .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.max("mtime").alias("mtime")).where("dataset <> ''"))


def record_runs(runs: DataFrame, path: str) -> None:
    """Add analysis runs (schema ``RUN``); runs with an id that is there already replace its rows."""
    (runs.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The history; a table that isn't there yet is empty."""
    try:
        return spark.read.schema(RUN).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN)


def with_analyses(datasets: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """``datasets`` with their newest recorded run whose result file exists (``results``: listed files)
    and holds items: last_run, n_runs, item_count, is_analyzed."""
    there = results.where("size > 0").select(F.regexp_extract("file_path", "/([^/]+)/[^/]*$", 1).alias("result_file")).distinct()
    sound = runs.where("item_count > 0").join(there, "result_file", "left_semi")
    last = sound.groupBy(F.col("input_file").alias("dataset")).agg(
        F.max("run_id").alias("last_run"), F.count(F.lit(1)).alias("n_runs"), F.max_by("item_count", "run_id").alias("item_count"),
        F.max_by("models", "run_id").alias("models"))
    return datasets.join(last, "dataset", "left").select(
        *datasets.columns, "last_run", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "item_count", F.array_join("models", ",").alias("models"),
        F.col("last_run").isNotNull().alias("is_analyzed"))
