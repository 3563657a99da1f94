"""Small pieces that several operators share: Arrow jobs, written tables, links to components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import scratch_path, shared_dir, ship


def arrow_job(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps don't depend on lineage,
    and a lost executor costs no more than its running tasks."""
    spark = df.sparkSession
    shared_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(u long, v long) links -> (node, comp): comp is the smallest node of its component.

    Large-star and small-star rounds: each turns the links of a node towards its smallest
    neighbour, so that components become stars in about log(n) rounds.  Every round is a
    pre-aggregated minimum and a join, written to the shared folder; a hot node's rows are split by
    the skew join because both sides come from their own exchange.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "links")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct())


def held_out(doc_id) -> F.Column:
    """Rows that no classifier learns from: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


SAMPLE_BYTES = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """((label, text) of at most ``per_class`` rows of each label, counts of each label).

    The rows are those with the smallest hash of doc_id; held-out rows and rows without a label or
    a doc_id are left out, several labels of a document count as their largest.  At most
    2 * per_class ids are broadcast, and as many texts come back: the smallest of a repeated id, and
    only texts of at most SAMPLE_BYTES teach.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max(column).cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.select("doc_id", "label", "text"), counts
