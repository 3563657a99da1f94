"""Queries over landed array files (S1, S2, S8) and keyword tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import keywords as K
from postlens.plans import sqlfrag as Q
from postlens.plans.queries_scalar import normalize
from postlens.plans.registry import register
from postlens.session import scratch_path
from postlens.sources import arrays as A
from postlens.sources import tables as TB

ORACLE: dict[str, str] = {}
POSTS = Q.with_ctes(Q.posts_cte())


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ------------------------------------------------------------------ arrays

LANDED = ("doc_id long, title string, content string, crawled_at string, sentiment int, platform string, keyword string, "
          "lat double, lon double")
SINCE, UNTIL = "2021-01-01 00:00:00", "2023-12-31 23:59:59"


@register("landed_arrays")
def q_landed_arrays(spark, sf):
    """Collected posts land as array files, one or more a platform; all are read, filtered by
    platform, keyword and time, and unified.  They are not scored yet, so their sentiment is null."""
    p = TB.posts(spark, sf)
    stamp = F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss")
    out = p.select("doc_id", "title", "content", stamp.alias("crawled_at"), F.lit(None).cast("int").alias("sentiment"), "platform", "keyword",
                   F.concat("platform", F.lit("_posts_20240601_000000")).alias("_name"))
    path = scratch_path(spark, "landed")
    A.write_arrays(out, path, "_name")
    r = A.read_arrays(spark, path, LANDED)
    kept = r.where((F.col("platform") != "google") & F.coalesce("keyword", F.lit("")).contains("e")
                   & F.col("crawled_at").between(SINCE, UNTIL))
    return kept.select("doc_id", "title", "content", F.col("crawled_at").alias("date"), "sentiment", "platform", "keyword", "lat", "lon",
                       F.col("file_platform"), F.col(A.CORRUPT).isNotNull().alias("corrupt"))


oracle("landed_arrays", POSTS + f"""SELECT doc_id, title, content, strftime(crawled_at, '%Y-%m-%d %H:%M:%S') AS date, CAST(NULL AS INTEGER) AS sentiment, platform, keyword,
  CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, split_part(platform, '_', 1) AS file_platform, false AS corrupt
FROM posts WHERE platform <> 'google' AND contains(coalesce(keyword, ''), 'e')
  AND strftime(crawled_at, '%Y-%m-%d %H:%M:%S') BETWEEN '{SINCE}' AND '{UNTIL}'""")

RAW = ("doc_id long, url string, title string, content string, subject string, memo string, published_date string, "
       "pubDate string, date string")


@register("landed_normalized")
def q_landed_normalized(spark, sf):
    """Raw records of a platform land in files named after it; the records don't say where they
    are from, so the platform is the file's name up to the first underscore."""
    r = TB.raw_posts(spark, sf)
    path = scratch_path(spark, "landed-raw")
    A.write_arrays(r.select("doc_id", "url", "title", "content", "subject", "memo", "published_date", "pubDate", "date",
                            F.concat("platform", F.lit("_20240601_000000")).alias("_name")), path, "_name")
    back = A.read_arrays(spark, path, RAW)
    return normalize(back.where(F.col(A.CORRUPT).isNull()).withColumn("platform", F.col("file_platform")))


_short = "split_part(platform, '_', 1)"
oracle("landed_normalized", POSTS + f"""SELECT doc_id, {_short} AS platform, title, content,
  CASE WHEN platform = 'youtube' AND NOT regexp_matches(url, '^https?://') THEN 'https://www.youtube.com/watch?v=' || url ELSE url END AS url,
  {Q.ymd(Q.parse_date_null('date_text', _short))} AS published_date FROM posts""")


# ------------------------------------------------------------------ keyword tables

LONG_WORD = "\\p{L}{8,}"


def title_words(p):
    """A keyword table that grows with the posts: the first long word of every title."""
    return p.select(F.nullif(F.regexp_extract("title", LONG_WORD, 0), F.lit("")).alias("keyword")).where("keyword is not null")


_TABLE = f"""kw AS (SELECT DISTINCT lower(regexp_extract(title, '{LONG_WORD}')) AS w FROM posts WHERE regexp_extract(title, '{LONG_WORD}') <> ''),
hits AS (SELECT doc_id, content, w, strpos(lower(content), w) AS first,
  (length(lower(content)) - length(replace(lower(content), w, ''))) // length(w) AS n FROM posts, kw WHERE contains(lower(content), w))"""


@register("keyword_table_hits")
def q_keyword_table_hits(spark, sf):
    """How many posts hold each keyword of a table, how often, and the first of them."""
    p = TB.posts(spark, sf).select("doc_id", "title", "content")
    h = K.keyword_hits(p, "doc_id", "content", title_words(p))
    return h.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("n").alias("n_hits"), F.min("doc_id").alias("first_post"))


oracle("keyword_table_hits", Q.with_ctes(Q.posts_cte(), _TABLE) + """SELECT w AS keyword, count(*) AS n_posts, CAST(sum(n) AS BIGINT) AS n_hits,
  min(doc_id) AS first_post FROM hits GROUP BY w""")


@register("keyword_table_posts")
def q_keyword_table_posts(spark, sf):
    """F13 + P15 with a keyword table: keywords of each post that has some, the earliest, and the text
    around it."""
    p = TB.posts(spark, sf).select("doc_id", "title", "content")
    m = K.with_matches(p.select("doc_id", F.lower("content").alias("content")), "content", title_words(p)).where(F.size("matches") > 0)
    first = F.element_at("matches", 1)
    return m.select("doc_id", F.size("matches").alias("n_keywords"), first["keyword"].alias("keyword"), first["first"].alias("position"),
                    K.snippet(F.col("content"), first["first"], first["keyword"]).alias("snippet"))


_r = K.C.SNIPPET_RADIUS
oracle("keyword_table_posts", Q.with_ctes(Q.posts_cte(), _TABLE) + f"""SELECT doc_id, CAST(n_keywords AS INTEGER) AS n_keywords, w AS keyword,
  CAST(first AS INTEGER) AS position, CASE WHEN first > {_r} + 1 THEN '...' ELSE '' END
  || substr(t, greatest(first - {_r}, 1), first + length(w) + {_r} - greatest(first - {_r}, 1))
  || CASE WHEN first + length(w) + {_r} <= length(t) THEN '...' ELSE '' END AS snippet
FROM (SELECT doc_id, lower(content) AS t, w, first, count(*) OVER (PARTITION BY doc_id) AS n_keywords,
  row_number() OVER (PARTITION BY doc_id ORDER BY first, w) AS rn FROM hits) WHERE rn = 1""")


def item_rules(items):
    """A rule for each benchmark item: its first word is the region, the second must occur, and one of
    the third and fourth where it has them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))
    kinds = [("AND", 0), ("AND", 1), ("OR", 2), ("OR", 3)]
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.get("w", F.lit(k)).alias("text"), F.lit(c).alias("condition")) for c, k in kinds])
    return items.select("item_id", words.alias("w")).select(F.col("item_id").alias("rule_id"), F.explode(rows).alias("r")).select("rule_id", "r.*")


@register("keyword_rules")
def q_keyword_rules(spark, sf):
    """F2 for a table of rules: posts that meet each rule."""
    p = TB.posts(spark, sf).select("doc_id", "content")
    h = K.rule_hits(p, "doc_id", "content", item_rules(TB.table(spark, sf, "benchmark")))
    return h.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_posts"), F.min("doc_id").alias("first_post"))


oracle("keyword_rules", Q.with_ctes(
    Q.posts_cte(), "r AS (SELECT item_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM benchmark)",
    "t AS (SELECT doc_id, lower(content) AS c FROM posts)") + """SELECT item_id AS rule_id, count(*) AS n_posts, min(doc_id) AS first_post FROM r, t
WHERE len(w) > 0 AND contains(c, w[1]) AND (len(w) < 2 OR contains(c, w[2]))
  AND (len(w) < 3 OR contains(c, w[3]) OR (len(w) > 3 AND contains(c, w[4]))) GROUP BY item_id""")
