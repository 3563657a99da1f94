"""Queries over fetched answers and addresses: P12, P13, P18, V6."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import dates as D
from postlens.functions import shape as S
from postlens.functions import text as T
from postlens.operators import stats
from postlens.plans import sqlfrag as Q
from postlens.plans.queries_scalar import _entities_sql
from postlens.plans.registry import register
from postlens.sources import tables as TB

ORACLE: dict[str, str] = {}
POSTS = Q.with_ctes(Q.posts_cte())


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


SEARCH_ANSWER = ("items array<struct<title:string,description:string,link:string,bloggername:string,author:string,"
                 "postdate:string,pubDate:string>>")


def _search_answers(spark, sf):
    """One search answer (JSON) per naver post, with the page's text where it could be fetched."""
    p = TB.posts(spark, sf).where(F.startswith("platform", F.lit("naver")))
    k = F.col("doc_id")
    item = F.struct(F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"),
                    F.concat(F.lit("&quot;"), "content", F.lit("&quot;")).alias("description"),
                    F.col("url").alias("link"), F.when(k % 2 == 0, F.col("source")).alias("bloggername"),
                    F.col("lang").alias("author"), F.when(k % 3 != 0, F.col("date_text")).alias("postdate"),
                    F.when(k % 3 == 0, F.col("date_text")).alias("pubDate"))
    return p.select("doc_id", "platform", "keyword", F.to_json(F.struct(F.array(item).alias("items"))).alias("raw"),
                    F.when(k % 4 == 0, F.col("content")).when(k % 4 == 1, F.lit("")).alias("full_content"))


def flatten_search(answers):
    """The items of search answers; content falls back to ``title description`` where the page
    gave none; the name to the author, the date to pubDate."""
    i = answers.select("doc_id", "platform", "keyword", "full_content",
                       F.explode(F.from_json("raw", SEARCH_ANSWER)["items"]).alias("i"))
    x = i.select("doc_id", "platform", "keyword", "full_content", F.col("i.link").alias("url"),
                 T.clean_html_entities(F.coalesce("i.title", F.lit(""))).alias("title"),
                 T.clean_html_entities(F.coalesce("i.description", F.lit(""))).alias("description"),
                 F.coalesce("i.bloggername", "i.author", F.lit("")).alias("blog_name"),
                 D.parse_date_relative(F.coalesce("i.postdate", "i.pubDate", F.lit(""))).alias("published_date"))
    full = F.nullif("full_content", F.lit(""))
    return x.select("doc_id", "platform", "keyword", "url", "title",
                    F.coalesce(full, F.concat("title", F.lit(" "), "description")).alias("content"), "blog_name", "published_date")


@register("search_items")
def q_search_items(spark, sf):
    return flatten_search(_search_answers(spark, sf))


oracle("search_items", POSTS + f"""SELECT doc_id, platform, keyword, url, t AS title,
  CASE WHEN doc_id % 4 = 0 AND content <> '' THEN content ELSE t || ' ' || d END AS content,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS blog_name, {Q.parse_date_relative('date_text')} AS published_date
FROM (SELECT *, {_entities_sql("('<b>' || title || '</b>')")} AS t, {_entities_sql("('&quot;' || content || '&quot;')")} AS d
      FROM posts WHERE starts_with(platform, 'naver'))""")


WEB_ANSWER = "items array<struct<title:string,snippet:string,link:string,pagemap:struct<metatags:array<map<string,string>>>>>"
PUBLISHED = "article:published_time"


def _web_answers(spark, sf):
    """One web-search answer (JSON) per google post; its tags hold no time, one, two, or a broken one."""
    p = TB.posts(spark, sf).where(F.col("platform") == "google")
    day = F.date_format("base_date", "yyyy-MM-dd")
    other = F.create_map(F.lit("viewport"), F.lit("width=device-width"))

    def tag(v):
        return F.create_map(F.lit(PUBLISHED), v, F.lit("og:type"), F.lit("article"))

    late = tag(F.lit("2023-02-03T00:00:00Z"))
    tags = (F.when(F.col("doc_id") % 5 == 0, F.array(other))
            .when(F.col("doc_id") % 5 == 1, F.array(other, tag(F.concat(day, F.lit("T08:09:10+09:00")))))
            .when(F.col("doc_id") % 5 == 2, F.array(tag(day), late))
            .when(F.col("doc_id") % 5 == 3, F.array(tag(F.lit("2024-02-31")), late)))
    item = F.struct("title", F.col("content").alias("snippet"), F.col("url").alias("link"),
                    F.struct(tags.alias("metatags")).alias("pagemap"))
    return p.select("doc_id", F.to_json(F.struct(F.array(item).alias("items"))).alias("raw"))


def flatten_web(answers, as_of=C.AS_OF):
    """The items of web-search answers; the date is the day of the first tag with a time, else
    (none, or not a date) the day of the run."""
    i = answers.select("doc_id", F.explode(F.from_json("raw", WEB_ANSWER)["items"]).alias("i"))
    time = S.first_metatag("i.pagemap.metatags", PUBLISHED)
    day = F.when(F.substring(time, 1, 10).rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(F.substring(time, 1, 10), "yyyy-M-d"))
    return i.select("doc_id", T.clean_html_entities("i.title").alias("title"), T.clean_html_entities("i.snippet").alias("content"),
                    F.col("i.link").alias("url"), F.date_format(F.coalesce(day, D.lit_date(as_of)), "yyyyMMdd").alias("published_date"))


@register("first_metatag")
def q_first_metatag(spark, sf):
    return flatten_web(_web_answers(spark, sf))


oracle("first_metatag", POSTS + f"""SELECT doc_id, {_entities_sql('title')} AS title, {_entities_sql('content')} AS content, url,
  CASE WHEN doc_id % 5 IN (1, 2) THEN strftime(base_date, '%Y%m%d') ELSE {Q.ymd(Q.as_of())} END AS published_date
FROM posts WHERE platform = 'google'""")


@register("post_url_parts")
def q_post_url_parts(spark, sf):
    """Board id and number of a board post's address; blog id, number and own page of a blog's."""
    p = TB.posts(spark, sf)
    k = F.col("doc_id").cast("string")
    url = (F.when(F.col("platform") == "dcinside", F.concat(F.lit("https://gall.example.com/board/view/?id="), "source", F.lit("&no="), k, F.lit("#c")))
           .when(F.col("platform") == "naver_blog_api", F.concat(F.lit("https://blog.naver.com/"), "source", F.lit("/post?page=2&logNo="), k))
           .otherwise(F.col("url")))
    x = p.select("doc_id", url.alias("url"))
    return x.select("doc_id", S.url_query_param("url", "id").alias("gallery_id"), S.url_query_param("url", "no").alias("post_no"),
                    F.regexp_extract("url", S.BLOG_ID_RE, 1).alias("blog_id"), F.regexp_extract("url", S.LOG_NO_RE, 1).alias("log_no"),
                    S.blog_view_url("url").alias("view_url"))


oracle("post_url_parts", POSTS + """SELECT doc_id, CASE WHEN b THEN source ELSE '' END AS gallery_id, CASE WHEN b THEN k ELSE '' END AS post_no,
  CASE WHEN n THEN source ELSE '' END AS blog_id, CASE WHEN n THEN k ELSE '' END AS log_no,
  CASE WHEN n THEN 'https://blog.naver.com/PostView.naver?blogId=' || source || '&logNo=' || k ELSE '' END AS view_url
FROM (SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS k, platform = 'dcinside' AS b, platform = 'naver_blog_api' AS n FROM posts)""")


@register("report_columns")
def q_report_columns(spark, sf):
    """V6: a report over posts that were never scored: the missing label column reads 'unknown'."""
    p = stats.report_input(TB.posts(spark, sf).select("doc_id", "platform", "content"))
    return p.groupBy("platform", "sentiment").agg(F.count(F.lit(1)).alias("n_posts"), F.count("content").alias("n_contents"))


oracle("report_columns", POSTS + """SELECT platform, 'unknown' AS sentiment, count(*) AS n_posts, count(content) AS n_contents
FROM posts GROUP BY platform""")
