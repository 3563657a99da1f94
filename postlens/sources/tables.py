"""Table access and adapters from the driver's tables to the canonical shapes.

Every adapter is a plain projection / join over the given Parquet tables, so its work grows with
them; the same rules are written as DuckDB SQL in ``postlens.plans.oracle`` (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import config as C
from postlens.operators.rowops import spread

# adapter rules (our fixture contract, FIXTURES.md part B)
ADAPTER_PLATFORMS = ["naver_blog_api", "naver_news_api", "naver_cafearticle_api", "youtube",
                     "google", "dcinside", "buan_gov"]
DATE_EPOCH = "2020-01-01"
DATE_SPAN_DAYS = 1800
EVENT_LABELS = {"purchase": 2, "signup": 2, "view": 1, "click": 1, "error": 0}
SEEN_BEFORE = "2022-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _base_date(doc_id):
    return F.when(doc_id % 50 == 49, F.lit("1999-12-31").cast("date")).otherwise(
        F.date_add(F.lit(DATE_EPOCH).cast("date"), (doc_id * 7 % DATE_SPAN_DAYS).cast("int")))


def _date_text(doc_id, d):
    ymd = F.date_format(d, "yyyy-MM-dd")
    y, m, dd = F.substring(ymd, 1, 4), F.substring(ymd, 6, 2), F.substring(ymd, 9, 2)
    k = doc_id % 8
    return (F.when(k == 0, F.concat(y, m, dd))
            .when(k == 1, ymd)
            .when(k == 2, F.replace(ymd, F.lit("-"), F.lit(".")))
            .when(k == 3, F.replace(ymd, F.lit("-"), F.lit("/")))
            .when(k == 4, F.concat(y, F.lit("년"), m, F.lit("월"), dd, F.lit("일")))
            .when(k == 5, F.concat(ymd, F.lit(" 12:34:56")))
            .when(k == 6, F.lit(""))
            .otherwise(F.lit("not a date")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical posts: ``documents`` left join ``labels``.

    Columns: doc_id, ingest_seq, platform, title, content, url, date_text, base_date, crawled_at,
    keyword, keywords, lang, source, sentiment, confidence.
    """
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    # one row per doc_id: the optimizer drops the outer join wherever no label is read
    lab = (table(spark, sf_dir, "labels").groupBy("doc_id")
           .agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")))
    j = d.join(lab, "doc_id", "left")
    doc_id = F.col("doc_id")
    platform = F.element_at(F.array(*[F.lit(p) for p in ADAPTER_PLATFORMS]),
                            (doc_id % 7 + 1).cast("int"))
    first_line = F.substring_index(F.col("text"), "\n", 1)
    noisy = F.concat(F.lit("<b>Note</b> see https://www.example.org/post/"), doc_id.cast("string"),
                     F.lit(" or mail user"), doc_id.cast("string"),
                     F.lit("@mail.example.com "), F.col("text"))
    base = _base_date(doc_id)
    return j.select(
        doc_id,
        doc_id.alias("ingest_seq"),
        platform.alias("platform"),
        first_line.alias("title"),
        F.when(doc_id % 10 == 0, noisy).otherwise(F.col("text")).alias("content"),
        F.when(doc_id % 7 == 3,
               F.concat(F.lit("https://www.youtube.com/watch?v=v"), doc_id.cast("string")))
        .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"),
                            doc_id.cast("string"))).alias("url"),
        _date_text(doc_id, base).alias("date_text"),
        base.alias("base_date"),
        F.timestamp_add("HOUR", (doc_id % 24).cast("int"), base.cast("timestamp_ntz")).alias("crawled_at"),
        F.col("lang").alias("keyword"),
        F.col("text").alias("keywords"),
        F.col("lang"),
        F.col("source"),
        F.when(F.col("toxic") == 1, F.lit(0)).when(F.col("quality") == 1, F.lit(2))
        .when(F.col("quality").isNotNull(), F.lit(1)).cast("int").alias("sentiment"),
        ((doc_id * 37 % 101) / 100.0).alias("confidence"),
    )


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as the collectors land them: per-platform field names (P1 input).

    dcinside keeps title/content in ``subject``/``memo``, naver news keeps its date in ``pubDate``,
    buan keeps it in ``date``; other rows use the canonical names.
    """
    p = posts(spark, sf_dir)
    plat = F.col("platform")
    is_dc = plat == "dcinside"
    return p.select(
        "doc_id", "ingest_seq", "platform", "url",
        F.when(~is_dc, F.col("title")).alias("title"),
        F.when(~is_dc, F.col("content")).alias("content"),
        F.when(is_dc, F.col("title")).alias("subject"),
        F.when(is_dc, F.col("content")).alias("memo"),
        F.when(~plat.isin("naver_news_api", "buan_gov"), F.col("date_text")).alias("published_date"),
        F.when(plat == "naver_news_api", F.col("date_text")).alias("pubDate"),
        F.when(plat == "buan_gov", F.col("date_text")).alias("date"),
    )


THREADS = 7


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments: the conversations of a block of THREADS ids are the threads under the block's video
    (the id that leaves 3); ``turn`` is the position under the video: thread, then turn."""
    c = table(spark, sf_dir, "conversations")
    thread = F.col("conv_id") % THREADS
    return c.select(
        (F.col("conv_id") - thread + 3).alias("video_key"), (thread * 1000000 + F.col("turn")).alias("turn"),
        F.col("role").alias("author"), F.col("text"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a labelled time series: ts, user_id, event_type, label, value, props."""
    e = table(spark, sf_dir, "events")
    lab = F.when(F.col("event_type").isin("purchase", "signup"), 2) \
        .when(F.col("event_type").isin("view", "click"), 1) \
        .when(F.col("event_type") == "error", 0)
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props",
                    lab.cast("int").alias("label"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three embedding elements as classifier logits."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.slice(F.col("embedding"), 1, 3).cast("array<double>").alias("logits"),
                    "label")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def seen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an earlier collection run: posts crawled before ``SEEN_BEFORE``."""
    p = posts(spark, sf_dir)
    return p.where(F.col("base_date") < F.lit(SEEN_BEFORE).cast("date")).select("doc_id", "url")
