"""Queries over raw records of differing shapes (P2, P10, P12-P14, U1) and dates of any layout (D5-D7,
X13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import dategrammar as G
from postlens.operators import records as R
from postlens.plans import sqlfrag as Q
from postlens.plans.registry import register
from postlens.session import scratch_path
from postlens.sources import tables as TB

ORACLE: dict[str, str] = {}
POSTS = Q.with_ctes(Q.posts_cte())


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ------------------------------------------------------------------ records

def _answer(p):
    """(doc_id, kind, raw): the posts as their sources answer, each in its own shape; some are broken."""
    k, day = F.col("doc_id"), F.date_format("base_date", "yyyy-MM-dd")
    plat = F.col("platform")
    video = F.to_json(F.struct(F.concat(F.lit("v"), k.cast("string")).alias("id"), F.struct(
        F.col("title"), F.col("content").alias("description"), F.concat(day, F.lit("T08:00:00Z")).alias("publishedAt"),
        F.col("source").alias("channelTitle")).alias("snippet"), F.struct((k * 3).cast("string").alias("viewCount")).alias("statistics")))
    search = F.to_json(F.struct(F.lit(1).alias("total"), F.array(F.struct(
        F.col("title"), F.col("content").alias("description"), F.col("url").alias("link"), F.col("source").alias("bloggername"),
        day.alias("postdate"))).alias("items")))
    tags = F.create_map(F.lit("article:published_time"), F.concat(day, F.lit("T08:09:10+09:00")))
    web = F.to_json(F.struct(F.col("title"), F.col("content").alias("snippet"), F.col("url").alias("link"),
                             F.struct(F.array(tags).alias("metatags")).alias("pagemap")))
    board = F.to_json(F.struct(F.col("title").alias("subject"), F.col("content").alias("memo"), F.col("url").alias("link"), day.alias("date"),
                               (k % 7).alias("comment_count")))
    notice = F.to_json(F.struct(F.col("title"), F.col("content"), F.col("url"), day.alias("date"),
                                F.array(F.struct(F.concat(F.lit("f"), k.cast("string")).alias("name"))).alias("files")))
    raw = (F.when(plat == "youtube", video).when(plat.startswith("naver"), search).when(plat == "google", web)
           .when(plat == "dcinside", board).otherwise(notice))
    kind = F.when(plat.startswith("naver"), "naver").otherwise(plat)
    return p.select("doc_id", kind.alias("kind"), F.when(k % 40 == 17, F.lit('{"broken": ')).otherwise(raw).alias("raw"))


FIELDS = {
    "title": ["snippet.title", "items.0.title", "title", "subject"],
    "content": ["snippet.description", "items.0.description", "snippet", "content", "memo"],
    "url": ["items.0.link", "link", "url"],
    "published": ["snippet.publishedAt", "items.0.postdate", "pagemap.metatags.0.article:published_time", "date"],
    "author": ["snippet.channelTitle", "items.0.bloggername"],
    "n_views": ["statistics.viewCount"],
    "attachment": ["files.0.name"],
    "absent": ["no.such.field"],
}


def _landed(spark, sf):
    """One landed table of all shapes, read back."""
    path = scratch_path(spark, "raw-records")
    _answer(TB.posts(spark, sf)).write.parquet(path)
    return R.parsed(spark.read.schema("doc_id long, kind string, raw string").parquet(path))


@register("variant_records")
def q_variant_records(spark, sf):
    """Five shapes of records flattened by one table of dotted paths."""
    x = R.flatten(_landed(spark, sf), FIELDS, keep=["doc_id", "kind"])
    url = F.coalesce("url", F.when(F.col("kind") == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v=v"), F.col("doc_id").cast("string"))))
    return x.select("doc_id", "kind", "title", "content", url.alias("url"), F.coalesce(G.ymd_text(F.substring("published", 1, 10)), F.lit("")).alias("published"),
                    "author", F.col("n_views").try_cast("long").alias("n_views"), "attachment", F.coalesce("absent", F.lit("")).alias("absent"))


_plain = "CASE WHEN doc_id % 40 <> 17 THEN nullif({}, '') END"
oracle("variant_records", POSTS + f"""SELECT doc_id, kind, {_plain.format('title')} AS title,
  {_plain.format('content')} AS content,
  CASE WHEN kind = 'youtube' THEN 'https://www.youtube.com/watch?v=v' || doc_id ELSE {_plain.format('url')} END AS url,
  CASE WHEN doc_id % 40 <> 17 THEN strftime(base_date, '%Y%m%d') ELSE '' END AS published,
  CASE WHEN kind IN ('youtube', 'naver') THEN {_plain.format('source')} END AS author,
  CASE WHEN kind = 'youtube' AND doc_id % 40 <> 17 THEN doc_id * 3 END AS n_views,
  CASE WHEN kind = 'buan_gov' AND doc_id % 40 <> 17 THEN 'f' || doc_id END AS attachment, '' AS absent
FROM (SELECT *, CASE WHEN starts_with(platform, 'naver') THEN 'naver' ELSE platform END AS kind FROM posts)""")

SHAPES = {
    "youtube": "OBJECT<id: STRING, snippet: OBJECT<channelTitle: STRING, description: STRING, publishedAt: STRING, title: STRING>, statistics: OBJECT<viewCount: STRING>>",
    "naver": "OBJECT<items: ARRAY<OBJECT<bloggername: STRING, description: STRING, link: STRING, postdate: STRING, title: STRING>>, total: BIGINT>",
    "google": "OBJECT<link: STRING, pagemap: OBJECT<metatags: ARRAY<OBJECT<`article:published_time`: STRING>>>, snippet: STRING, title: STRING>",
    "dcinside": "OBJECT<comment_count: BIGINT, date: STRING, link: STRING, memo: STRING, subject: STRING>",
    "buan_gov": "OBJECT<content: STRING, date: STRING, files: ARRAY<OBJECT<name: STRING>>, title: STRING, url: STRING>",
}


@register("variant_shapes")
def q_variant_shapes(spark, sf):
    """The shapes that the landed records have, found by an aggregate."""
    return R.shapes(_landed(spark, sf), "kind")


oracle("variant_shapes", POSTS + "SELECT kind, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHAPES.items()) + """ END AS shape,
  count(*) AS n_records, count(*) FILTER (WHERE doc_id % 40 = 17) AS n_malformed
FROM (SELECT *, CASE WHEN starts_with(platform, 'naver') THEN 'naver' ELSE platform END AS kind FROM posts) GROUP BY kind""")


# ------------------------------------------------------------------ dates

def _written(p):
    """The posts' days in a dozen layouts; the last two are no dates."""
    def f(layout):
        return F.date_format("base_date", layout)

    day = F.dayofmonth("base_date").cast("string")
    month = f("MMM")
    layouts = [f("yyyyMMdd"), f("yyyy.MM.dd"), f("yyyy년 M월 d일"), F.concat(f("EEE"), F.lit(", "), day, F.lit(" "), month, f(" yyyy"), F.lit(" 10:00:00 +0900")),
               F.concat(f("MMMM"), F.lit(" "), day, f(", yyyy")), F.concat(f("dd"), F.lit("-"), month, f("-yyyy")), f("MM/dd/yyyy"),
               F.concat(f("yyyy-MM-dd"), F.lit("T23:59:58.123Z")), F.concat(f("yyyy/M/d"), F.lit(" 11:30 PM")),
               F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("base_date")).cast("string"), F.lit("-W"),
                        F.lpad(F.weekofyear("base_date").cast("string"), 2, "0"), F.lit("-"), (F.weekday("base_date") + 1).cast("string")),
               F.concat(f("yyyy-MM-dd"), F.lit(" 24:30:00")), F.concat(f("yyyy"), F.lit("-02-30"))]
    k = F.col("doc_id") % len(layouts)
    text = F.lit(None).cast("string")
    for n, layout in enumerate(layouts):
        text = F.when(k == n, layout).otherwise(text)
    return p.select("doc_id", text.alias("date_text"))


LAYOUTS, GOOD = 12, 10


@register("general_dates")
def q_general_dates(spark, sf):
    """Dates of any layout by one tokenising pass; D6's text, null where there is no date."""
    x = _written(TB.posts(spark, sf)).withColumn("p", G.parse("date_text"))
    return x.select("doc_id", F.date_format("p.date", "yyyyMMdd").alias("published_date"), F.col("p.seconds").alias("seconds"), F.col("p.offset").alias("offset"))


oracle("general_dates", POSTS + f"""SELECT doc_id, CASE WHEN doc_id % {LAYOUTS} < {GOOD} THEN strftime(base_date, '%Y%m%d') END AS published_date,
  CASE doc_id % {LAYOUTS} WHEN 3 THEN 36000 WHEN 7 THEN 86398 WHEN 8 THEN 84600 END AS seconds,
  CASE doc_id % {LAYOUTS} WHEN 3 THEN 540 WHEN 7 THEN 0 END AS "offset" FROM posts""")
