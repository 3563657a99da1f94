"""Streaming jobs driven with availableNow equal their batch answers."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_stream_dedup_equals_batch_distinct(spark):
    got = {r["key"] for r in E.queries()["stream_dedup"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r["k"] for r in docs.select(F.sha2("text", 256).alias("k")).distinct().collect()}
    assert got == want


def test_stream_daily_counts_equal_batch(spark):
    got = {(r["day"], r["label"]): r["n"] for r in E.queries()["stream_daily_counts"](spark, SF_SMALL).collect()}
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert sum(got.values()) == ev.count()


def test_stream_ingest_counts(spark):
    got = E.queries()["stream_ingest"](spark, SF_SMALL)
    assert got.agg(F.sum("n_posts")).first()[0] == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_daily_counts_of_files_out_of_time_order(spark, tmp_path):
    """Five files that land newest first: no row is late."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").toPandas().sort_values("ts", ascending=False)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    n = -(-len(ev) // 5)
    for k in range(5):
        part = ev.iloc[k * n:(k + 1) * n].copy()
        part["ts"] = part["ts"].astype("datetime64[us]")
        part.to_parquet(folder / f"part-{k}.parquet", index=False)
    got = E.queries()["stream_daily_counts"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in got) == len(ev)


def test_late_rows_stay_with_one_file_per_batch(spark, tmp_path):
    """The default delay covers any disorder, also when every file is a micro-batch of its own."""
    from postlens.streaming import jobs
    rows = spark.range(50).selectExpr("timestamp_seconds(1704067200 - id * 864000) AS ts", "cast(id % 3 AS int) AS label")
    rows.repartition(5, "ts").write.parquet(str(tmp_path / "in"))
    s = jobs.file_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)
    agg = jobs.windowed_counts(s, "ts", "label").select(F.col("w.start").alias("start"), "label", "n")
    out = jobs.run_available_now(agg, "late", output_mode="update", foreach_batch=jobs.append_batches)
    last = spark.read.parquet(out).groupBy("start", "label").agg(F.max_by("n", "batch_id").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == 50


def test_dedup_forgets_after_the_watermark(spark, tmp_path):
    """A key seen again after the delay has passed counts as new; before, it is dropped."""
    from postlens.streaming import jobs
    for k, (key, t) in enumerate([("a", 0), ("a", 10), ("z", 100000), ("y", 200000), ("a", 200001)]):
        one = spark.createDataFrame([(key, 1704067200 + t)], "key string, s long").selectExpr("key", "timestamp_seconds(s) AS ts")
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time
        time.sleep(0.02)
    s = jobs.file_stream(spark, str(tmp_path / "in"), "key string, ts timestamp", max_files=1)
    out = jobs.run_available_now(jobs.dedup_within_watermark(s, "key", "ts", "1 hour"), "forget")
    got = sorted(r["key"] for r in spark.read.parquet(out).collect())
    assert got == ["a", "a", "y", "z"]


def test_late_rows_go_to_the_side_and_state_is_freed(spark, tmp_path):
    """On-time, late and open rows together are the batch's; state holds only days within the delay."""
    import time
    from postlens.streaming import jobs, late
    ev = spark.range(3000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + pmod(xxhash64(id), 90 * 86400)) AS ts",
                                      "CAST(CASE WHEN id % 4 < 3 THEN id % 4 END AS int) AS label")
    for k in range(5):
        ev.where(F.pmod(F.xxhash64("event_id", F.lit("drop")), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    s = jobs.file_stream(spark, str(tmp_path / "in"), ev.schema, max_files=1)
    out, ckpt = late.run_day_counts(s, "ts", "label", "event_id", delay_days=7)
    want = {(r.day, r.label): r["count"] for r in ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.coalesce("label", F.lit(-1)).alias("label")).count().collect()}
    rows = late.all_counts(spark, out, ckpt).collect()
    assert {(r.day, r.label): r.n for r in rows} == want
    assert sum(r.n_late for r in rows) > 100 and sum(r.n_closed for r in rows) > 100
    last = max(d for d, _ in want)
    open_ = late.open_days(spark, ckpt).collect()
    assert 0 < len(open_) <= 4 * 9 and min(r.day for r in open_) >= (__import__("datetime").date.fromisoformat(last) - __import__("datetime").timedelta(days=8)).isoformat()
    ids = [r.row_id for r in spark.read.parquet(f"{out}/kind=late").collect()]
    assert len(ids) == len(set(ids)) == sum(r.n_late for r in rows)


def test_sides_join_in_any_landing_order(spark, tmp_path):
    from postlens.plans import queries_streams as QS
    sides = QS.video_sides(spark, SF_SMALL)
    hits, details, comments = (sides[n][0] for n in ("hits", "details", "comments"))
    batch = hits.join(details, hits.video == details.d_video, "left").join(comments, hits.video == comments.c_video, "left")
    key = lambda r: (r.video, r.title, r.views, r.turn or -1, r.author or "")
    want = sorted(map(key, batch.collect()), key=str)
    for n, order in enumerate((["hits", "details", "comments"], ["comments", "hits", "details"])):
        got = QS.join_as_they_land(spark, sides, order, str(tmp_path / str(n)))
        assert sorted(map(key, got.collect()), key=str) == want
