"""Queries over what is kept between runs: key store (J3, S12), catalogue and run history (S5, S6, S10,
S11, J6), daily quality sketches (V9, A13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postlens import config as C
from postlens.operators import history as H
from postlens.plans import analysis
from postlens.plans import sqlfrag as Q
from postlens.plans.registry import register
from postlens.session import scratch_path
from postlens.sources import catalog as CT
from postlens.sources import files as FS
from postlens.sources import keystore as KS
from postlens.sources import tables as TB

ORACLE: dict[str, str] = {}
POSTS = Q.with_ctes(Q.posts_cte())


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ------------------------------------------------------------------ key store

BATCHES = ["2021-06-30", "2022-06-30", "2023-06-30"]         # posts are collected in runs that end on these days


@register("keystore_new_posts")
def q_keystore_new_posts(spark, sf):
    """Three collection runs against a bucketed store of addresses; the posts of each run whose
    address no earlier run has seen.  The first run's addresses come back in the second run."""
    p = TB.posts(spark, sf).select("doc_id", "url", "base_date")
    path = scratch_path(spark, "keys")
    store = KS.KeyStore(spark, f"postlens_keys_{uuid.uuid4().hex[:12]}", path)
    out, since = None, "1900-01-01"
    for k, day in enumerate(BATCHES):
        own = p.where((F.col("base_date") > F.lit(since).cast("date")) & (F.col("base_date") <= F.lit(day).cast("date")))
        run = own if k != 1 else own.union(p.where(F.col("base_date") <= F.lit(BATCHES[0]).cast("date")))
        done = scratch_path(spark, "new-posts")
        store.unseen(run, "url").select("doc_id", "url", F.lit(k + 1).alias("run")).write.parquet(done)
        new = spark.read.schema("doc_id long, url string, run int").parquet(done)
        store.add(new.select(F.col("url").alias("key"), F.lit(day).alias("seen")).distinct())
        out, since = new if out is None else out.union(new), day
    return out


oracle("keystore_new_posts", POSTS + "SELECT doc_id, url, CAST(CASE " + " ".join(
    f"WHEN base_date <= DATE '{d}' THEN {k}" for k, d in enumerate(BATCHES, 1)) + f" END AS INTEGER) AS run FROM posts WHERE base_date <= DATE '{BATCHES[-1]}'")


# ------------------------------------------------------------------ catalogue

RUN_DAYS = ["2024-06-01", "2024-06-02"]
ANALYSED = ["de", "en"]                                       # languages whose datasets are analysed; the first twice
LOST = "fr"                                                   # analysed, but its result is gone


@register("analysed_catalog")
def q_analysed_catalog(spark, sf):
    """Datasets land as folders, some are analysed and their runs recorded with the results'
    names (S10, S11); the catalogue lists folders by metadata and joins the newest run whose result is
    there.  The last run is recorded twice, which changes nothing."""
    p = TB.posts(spark, sf)
    counts = F.broadcast(p.groupBy("platform", "lang").agg(F.count(F.lit(1)).alias("n")))      # platforms x languages rows
    named = (p.select("doc_id", "platform", "lang", "content", "title", "date_text", "url").join(counts, ["platform", "lang"])
             .withColumn("dataset", F.concat_ws("_", "platform", F.col("n").cast("string"), "lang", F.lit("20240601_000000"))))
    landed, results, runs = (scratch_path(spark, x) for x in ("landed", "results", "runs"))
    named.select("doc_id", "title", "dataset").hint("rebalance", F.col("dataset")).write.partitionBy("dataset").json(landed)

    a = analysis.analyze_dataset(named.where(F.col("lang").isin(*ANALYSED, LOST))).select("doc_id", "sentiment").join(
        named.select("doc_id", "dataset", "lang"), "doc_id")
    scored = scratch_path(spark, "scored")
    a.write.parquet(scored)
    a = spark.read.schema(a.schema).parquet(scored)
    (a.where(F.col("lang") != LOST).select("doc_id", "sentiment", F.concat(F.lit("result_"), "dataset").alias("result"))
     .hint("rebalance", F.col("result")).write.partitionBy("result").csv(results))
    per = a.groupBy("dataset", "lang").agg(F.count(F.lit(1)).alias("item_count"), *[
        F.count_if(F.col("sentiment") == k).alias(f"n_{v}") for k, v in C.LABEL_NAMES.items()])
    days = F.when(F.col("lang") == ANALYSED[0], F.array(*[F.lit(d) for d in RUN_DAYS])).otherwise(F.array(F.lit(RUN_DAYS[0])))
    records = per.select(F.col("dataset").alias("input_file"), F.concat(F.lit("result="), F.lit("result_"), "dataset").alias("result_file"),
                         F.array(*[F.lit(m) for m in C.MODEL_SETS["light"]]).alias("models"), "item_count",
                         *[f"n_{v}" for v in C.LABEL_NAMES.values()], F.explode(days).alias("run_id"))
    CT.record_runs(records, runs)
    CT.record_runs(records.where(F.col("run_id") == RUN_DAYS[1]), runs)

    found = CT.folders(CT.list_files(spark, landed, "*.json"), "dataset")
    plat, cnt, kw, stamp = FS.parse_dataset_name(F.col("dataset"))
    sets = found.select("dataset", plat.alias("platform"), cnt.cast("long").alias("count"), kw.alias("keywords"), stamp.alias("stamp"))
    return CT.with_analyses(sets, CT.read_runs(spark, runs), CT.list_files(spark, results, "*.csv"))


_DONE = f"lang IN ({', '.join(Q.q(x) for x in ANALYSED)}) AND m > 0"
oracle("analysed_catalog", Q.with_ctes(Q.posts_cte(), Q.analyzed_cte()) + f"""SELECT *, last_run IS NOT NULL AS is_analyzed FROM (
SELECT platform || '_' || n || '_' || lang || '_20240601_000000' AS dataset, platform, n AS count, lang AS keywords, '20240601_000000' AS stamp,
  CASE WHEN {_DONE} THEN CASE WHEN lang = '{ANALYSED[0]}' THEN '{RUN_DAYS[1]}' ELSE '{RUN_DAYS[0]}' END END AS last_run,
  CASE WHEN {_DONE} THEN CASE WHEN lang = '{ANALYSED[0]}' THEN 2 ELSE 1 END ELSE 0 END AS n_runs,
  CASE WHEN {_DONE} THEN m END AS item_count, CASE WHEN {_DONE} THEN {Q.q(','.join(C.MODEL_SETS['light']))} END AS models
FROM (SELECT p.platform, p.lang, count(*) AS n, count(a.doc_id) AS m FROM posts p LEFT JOIN analyzed a ON p.doc_id = a.doc_id GROUP BY ALL))""")


# ------------------------------------------------------------------ quality history

SPAN = ("2020-03-01", "2023-10-15")


@register("quality_history")
def q_quality_history(spark, sf):
    """Daily sketches of the posts are stored by month, and merged for a span that cuts two
    months; the posts themselves are read once, to make the sketches."""
    rows = H.daily_sketches(TB.posts(spark, sf))
    path = scratch_path(spark, "quality")
    H.write_months(rows, path)
    schema = spark.read.parquet(path).schema
    return H.merge_span(spark, path, schema, *SPAN, by=["platform", F.year("day").alias("year")])


# groups of some hundred values are kept exactly by both sketches; larger ones differ within the bounds in
# operators/history.py
oracle("quality_history", POSTS + f"""SELECT platform, CAST(year(base_date) AS INTEGER) AS year, count(*) AS n,
  count(*) FILTER (WHERE content IS NULL OR trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '') AS n_blank,
  round(count(*) FILTER (WHERE regexp_matches(url, '^https?://[^/]+')) * 100.0 / count(*), 6) AS url_valid_pct,
  min(base_date) AS first_day, max(base_date) AS last_day, count(DISTINCT coalesce(url, '')) AS n_urls,
  quantile_disc(coalesce(length(content), 0), 0.5) AS size_median, quantile_disc(coalesce(length(content), 0), 0.9) AS size_p90,
  round(quantile_disc(coalesce(confidence, 0.0), 0.5), 6) AS confidence_median, round(quantile_disc(coalesce(confidence, 0.0), 0.9), 6) AS confidence_p90
FROM posts WHERE base_date BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}' GROUP BY ALL""")
