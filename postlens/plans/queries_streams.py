"""Streams whose files land out of order (ST1, ST3) and apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.plans import sqlfrag as Q
from postlens.plans.registry import register
from postlens.session import scratch_path
from postlens.sources import tables as TB
from postlens.streaming import jobs as ST
from postlens.streaming import joins as SJ
from postlens.streaming import late as SL

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


DROPS = 5


@register("stream_late_rows")
def q_stream_late_rows(spark, sf):
    """ST3 with a delay of a week over events that land in no order, a file a batch: closed counts, late
    rows and open days together are all events of a day and label."""
    e = TB.event_series(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "label")
    path = scratch_path(spark, "drops")
    for k in range(DROPS):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(DROPS)) == k).coalesce(1).write.mode("append").parquet(path)
    s = ST.file_stream(spark, path, e.schema, max_files=1)
    out, ckpt = SL.run_day_counts(s, "ts", "label", "event_id", delay_days=7)
    return SL.all_counts(spark, out, ckpt).select("day", "label", "n")


oracle("stream_late_rows", f"""SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(CASE WHEN event_type IN ('purchase','signup') THEN 2
  WHEN event_type IN ('view','click') THEN 1 WHEN event_type = 'error' THEN 0 ELSE {SL.NO_LABEL} END AS INTEGER) AS label, count(*) AS n
FROM events GROUP BY ALL""")


def video_sides(spark, sf):
    """Hits, details (not of every video) and comments of videos, each with the time it is seen."""
    p = TB.posts(spark, sf).where(F.col("platform") == "youtube")
    hits = p.select(F.col("doc_id").alias("video"), "title", F.col("base_date").cast("timestamp").alias("hit_at"))
    detail_at = F.col("base_date").cast("timestamp") + F.expr("interval 1 hour")
    details = p.where(F.col("doc_id") % 4 != 0).select(F.col("doc_id").alias("d_video"), (F.col("doc_id") * 3).alias("views"), detail_at.alias("detail_at"))
    k = F.col("video_key")
    seen_at = TB._base_date(k).cast("timestamp") + F.expr("interval 2 hours")
    comments = TB.comments(spark, sf).select(k.alias("c_video"), "turn", "author", seen_at.alias("comment_at"))
    return {"hits": (hits, "video", "hit_at"), "details": (details, "d_video", "detail_at"), "comments": (comments, "c_video", "comment_at")}


def joined_streams(streams, delay: str = "4000 days", within: str = "1 day"):
    """hits, with details and comments or nulls, as one stream of rows."""
    a = SJ.outer_join(streams["hits"], streams["details"], "video", "hit_at", "detail_at", "d_video", delay, within)
    a = a.select("video", "title", "hit_at", "views")
    c = streams["comments"].withWatermark("comment_at", delay)
    near = F.expr(f"c_video = video AND comment_at >= hit_at - interval {within} AND comment_at <= hit_at + interval {within}")
    return a.join(c, near, "left_outer").select("video", "title", "views", "turn", "author")


CLOSING = 2


def join_as_they_land(spark, sides, order, path: str, max_files: int | None = None, run_each: bool = True):
    """Each side's rows land in ``order``, the stream running after each (or once after all); then the
    closing rows."""
    for name, (rows, _, _) in sides.items():
        rows.where("false").write.parquet(f"{path}/{name}")
    streams = {n: ST.file_stream(spark, f"{path}/{n}", rows.schema, max_files) for n, (rows, _, _) in sides.items()}
    at = (f"{path}/out", f"{path}/checkpoint")
    for name in order:
        sides[name][0].write.mode("append").parquet(f"{path}/{name}")
        if run_each or name == order[-1]:
            ST.run_available_now(joined_streams(streams), "videos", at=at)
    for step in range(CLOSING):
        for name, (rows, key, ts) in sides.items():
            SJ.closing_rows(rows, key, ts, f"{10000 + 5000 * step} days").write.mode("append").parquet(f"{path}/{name}")
        ST.run_available_now(joined_streams(streams), "videos", at=at)
    return spark.read.schema("video long, title string, views long, turn long, author string").parquet(at[0]).where(F.col("video") != SJ.CLOSING_KEY)


@register("stream_video_comments")
def q_stream_video_comments(spark, sf):
    """J4/J5 as streams: comments, details and hits land apart and are joined as they come; videos without
    details or comments are in the result too."""
    sides = video_sides(spark, sf)
    rows = join_as_they_land(spark, sides, ["comments", "details", "hits"], scratch_path(spark, "sides"), run_each=False)
    return rows.groupBy("video").agg(F.max("title").alias("title"), F.max("views").alias("views"), F.count("turn").alias("n_comments"),
                                     F.min("turn").alias("first_turn"), F.min_by("author", "turn").alias("first_author"))


oracle("stream_video_comments", Q.with_ctes(Q.posts_cte(), Q.comments_cte()) + """SELECT p.doc_id AS video, any_value(p.title) AS title,
  any_value(CASE WHEN p.doc_id % 4 <> 0 THEN p.doc_id * 3 END) AS views, count(c.turn) AS n_comments, min(c.turn) AS first_turn,
  min_by(c.author, c.turn) AS first_author
FROM posts p LEFT JOIN comments c ON c.video_key = p.doc_id WHERE p.platform = 'youtube' GROUP BY p.doc_id""")
