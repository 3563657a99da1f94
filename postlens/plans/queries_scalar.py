"""Queries over row-local operators: text (T*), dates (D*), shaping (P*), predicates (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import dates as D
from postlens.functions import predicates as P
from postlens.functions import shape as S
from postlens.functions import text as T
from postlens.operators import records, sequence
from postlens.operators.rowops import barrier, spread
from postlens.plans import sqlfrag as Q
from postlens.plans.registry import register
from postlens.sources import tables as TB

ORACLE: dict[str, str] = {}
POSTS = Q.with_ctes(Q.posts_cte())


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ------------------------------------------------------------------ text

@register("clean_text")
def q_clean_text(spark, sf):
    return TB.posts(spark, sf).select("doc_id", T.basic_clean("content").alias("clean"))


oracle("clean_text", POSTS + f"SELECT doc_id, {Q.basic_clean('content')} AS clean FROM posts")


@register("chunk_text")
def q_chunk_text(spark, sf):
    x = T.with_preprocessed(TB.posts(spark, sf).select("doc_id", "content"), "content", "chunk", mode="first_chunk")
    return x.select("doc_id", "chunk", F.length("chunk").alias("chunk_len"))


oracle("chunk_text", POSTS + f"""SELECT doc_id, chunk, length(chunk) AS chunk_len
FROM (SELECT doc_id, {Q.preprocess('content')} AS chunk FROM posts)""")


@register("clean_text_capped")
def q_clean_capped(spark, sf):
    return TB.posts(spark, sf).select("doc_id", T.clean_capped("content").alias("clean"))


oracle("clean_text_capped", POSTS + f"SELECT doc_id, left({Q.basic_clean('content')}, {C.SCORER_TEXT_CAP}) AS clean FROM posts")


@register("clean_title")
def q_clean_title(spark, sf):
    return TB.posts(spark, sf).select("doc_id", T.clean_title("title").alias("title"))


def _clean_title_sql(e):
    t = Q.rx_replace(e, C.EMOJI_CLASS, "")
    t = Q.rx_replace(t, T.TAG_RE, "")
    t = Q.rx_replace(t, "&nbsp;|\\x{00A0}", " ")
    t = Q.rx_replace(t, "\\x{200B}", "")
    return Q.strip_blank(Q.collapse_blank(t))


oracle("clean_title", POSTS + f"SELECT doc_id, {_clean_title_sql('title')} AS title FROM posts")


def _entities_sql(e):
    t = Q.rx_replace(e, T.TAG_RE, "")
    for ent, rep in C.HTML_ENTITIES:
        t = f"replace({t}, {Q.q(ent)}, {Q.q(rep)})"
    return Q.strip_blank(Q.collapse_blank(t))


@register("clean_html_entities")
def q_clean_entities(spark, sf):
    return spread(TB.pages(spark, sf), "page_id").select(
        "page_id", T.clean_html_entities("html").alias("text"))


oracle("clean_html_entities", f"SELECT page_id, {_entities_sql('html')} AS text FROM pages")


@register("safe_keyword")
def q_safe_keyword(spark, sf):
    return TB.posts(spark, sf).select("doc_id", T.safe_keyword("keywords").alias("safe_keyword"))


oracle("safe_keyword", POSTS + "SELECT doc_id, replace(" +
       Q.rx_replace("keywords", f"[^\\p{{L}}\\p{{N}}_{T.BLANK_CHARS}]", "") + ", ' ', '_') AS safe_keyword FROM posts")


@register("fixed_chunks")
def q_fixed_chunks(spark, sf):
    p = TB.posts(spark, sf).select("doc_id", T.fixed_pieces("content").alias("pieces"))
    return p.select("doc_id", F.posexplode("pieces").alias("piece_no", "piece"))


oracle("fixed_chunks", POSTS + f"""SELECT doc_id, CAST(i AS INTEGER) AS piece_no,
  substr(content, i * {C.FIXED_CHUNK_SIZE} + 1, {C.FIXED_CHUNK_SIZE}) AS piece
FROM posts, range(0, CAST(ceil(length(content) / {C.FIXED_CHUNK_SIZE}.0) AS BIGINT)) t(i)
WHERE length(content) > 0""")


@register("keyword_variations")
def q_keyword_variations(spark, sf):
    """T10/T11/U2 per post: keyword objects from the title's words (words 1-2 AND, the region word
    first; all others OR) -> distinct query variants.  Row-local, no shuffle; W11's quota cut is off."""
    words = F.filter(F.split(F.col("title"), " "), lambda w: w != "")
    p = TB.posts(spark, sf).select("doc_id", words.alias("w"))
    var = T.query_variations(F.element_at("w", 1), F.slice("w", F.lit(2), F.lit(1)),
                             F.slice("w", F.lit(3), F.greatest(F.size("w"), F.lit(1))))
    return p.where(F.size("w") > 0).select("doc_id", F.explode(var).alias("variation"))


oracle("keyword_variations", POSTS + """SELECT DISTINCT doc_id, variation FROM (
  SELECT doc_id, unnest(CASE WHEN len(ands) > 0 THEN
      CASE WHEN len(ors) = 0 THEN [base]
           ELSE list_concat(list_transform(ors, lambda o: base || ' ' || o),
                            CASE WHEN len(ors) > 1 THEN [base || ' ' || array_to_string(ors, ' ')] ELSE [] END) END
    ELSE list_concat([region], list_transform(ors, lambda o: region || ' ' || o)) END) AS variation
  FROM (SELECT doc_id, w[1] AS region, w[2:2] AS ands, w[3:] AS ors,
               w[1] || ' ' || array_to_string(w[2:2], ' ') AS base
        FROM (SELECT doc_id, list_filter(string_split(title, ' '), lambda x: x <> '') AS w FROM posts)
        WHERE len(w) > 0))""")


# ------------------------------------------------------------------ dates

def _date_query(fn_spark, fn_sql, name, out="parsed", fmt_date=False, with_platform=False):
    @register(name)
    def q(spark, sf):
        p = TB.posts(spark, sf)
        col = fn_spark(F.col("date_text"), F.col("platform")) if with_platform else fn_spark(F.col("date_text"))
        if fmt_date:
            col = D.ymd(col)
        return p.select("doc_id", "date_text", col.alias(out))

    e = fn_sql("date_text", "platform") if with_platform else fn_sql("date_text")
    if fmt_date:
        e = Q.ymd(e)
    oracle(name, POSTS + f"SELECT doc_id, date_text, {e} AS {out} FROM posts")
    return q


_date_query(D.parse_date_null, Q.parse_date_null, "parse_date_null", fmt_date=True, with_platform=True)
_date_query(D.parse_date_today, Q.parse_date_today, "parse_date_today")
_date_query(D.parse_date_relative, Q.parse_date_relative, "parse_date_relative")
_date_query(D.parse_date_split, Q.parse_date_split, "parse_date_split")


@register("iso_to_ymd")
def q_iso_to_ymd(spark, sf):
    e = TB.event_series(spark, sf)
    return e.select("event_id", D.iso_to_ymd(F.col("ts").cast("string")).alias("ymd"))


oracle("iso_to_ymd", f"""SELECT event_id, CASE WHEN regexp_matches(CAST(ts AS VARCHAR), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')
  THEN replace(left(CAST(ts AS VARCHAR), 10), '-', '') ELSE {Q.ymd(Q.as_of())} END AS ymd FROM events""")


@register("compact_timestamp")
def q_compact_timestamp(spark, sf):
    """Eight digits to a timestamp, anything else to midnight of the run's day."""
    p = TB.posts(spark, sf).select("doc_id", D.ymd_to_timestamp("date_text").alias("t"))
    return p.select("doc_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("at"))


oracle("compact_timestamp", POSTS + f"""SELECT doc_id, strftime(CASE WHEN regexp_full_match(date_text, '[0-9]{{8}}')
  THEN CAST(base_date AS TIMESTAMP) ELSE CAST({Q.as_of()} AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS at FROM posts""")


@register("extract_date")
def q_extract_date(spark, sf):
    p = TB.posts(spark, sf)
    return p.select("doc_id", D.extract_date(F.concat_ws(" ", "title", "date_text")).alias("found"))


oracle("extract_date", POSTS + """SELECT doc_id,
  regexp_extract(concat_ws(' ', title, date_text), '(\\d{4}[-./]\\d{1,2}[-./]\\d{1,2})', 1) AS found FROM posts""")


@register("clamp_future")
def q_clamp_future(spark, sf):
    p = TB.posts(spark, sf)
    return p.select("doc_id", F.date_format(D.clamp_future("base_date"), "yyyy-MM-dd").alias("date"))


oracle("clamp_future", POSTS + f"SELECT doc_id, strftime(least(base_date, {Q.as_of()}), '%Y-%m-%d') AS date FROM posts")


@register("date_window")
def q_date_window(spark, sf):
    """parsed date, not after as_of, year >= 2000."""
    return TB.posts(spark, sf).select("doc_id", D.in_window(D.parse_date_trend("date_text")).alias("d")) \
        .select("doc_id", F.date_format("d", "yyyy-MM-dd").alias("date"))


oracle("date_window", POSTS + f"""SELECT doc_id, strftime(d, '%Y-%m-%d') AS date
FROM (SELECT doc_id, {Q.parse_date_trend('date_text')} AS d FROM posts)
WHERE d BETWEEN DATE '2000-01-01' AND {Q.as_of()}""")

AGE_DAYS = 365


@register("age_filter")
def q_age_filter(spark, sf):
    """keep posts at most AGE_DAYS old at as_of (off when the setting is null)."""
    p = TB.posts(spark, sf)
    return p.where(F.datediff(D.lit_date(C.AS_OF), "base_date") <= AGE_DAYS).select("doc_id")


oracle("age_filter", POSTS + f"SELECT doc_id FROM posts WHERE ({Q.as_of()} - base_date) <= {AGE_DAYS}")


# ------------------------------------------------------------------ shaping

def normalize(r):
    """Platform field mapping with canonical fallback, youtube URL rule, D1 dates."""
    plat = F.col("platform")
    title = F.coalesce(F.when(plat == "dcinside", F.col("subject")), F.col("title"))
    content = F.coalesce(F.when(plat == "dcinside", F.col("memo")), F.col("content"))
    date = F.coalesce(F.when(plat.startswith("naver"), F.col("pubDate")),
                      F.when(plat.startswith("buan"), F.col("date")), F.col("published_date"))
    url = F.when(plat == "youtube", S.youtube_prefix("url")).otherwise(F.col("url"))
    x = r.select("doc_id", "platform", title.alias("title"), content.alias("content"),
                 url.alias("url"), date.alias("date_raw"))
    return x.select("doc_id", "platform", "title", "content", "url",
                    D.ymd(D.parse_date_null(F.col("date_raw"), F.col("platform"))).alias("published_date"))


@register("normalize_posts")
def q_normalize_posts(spark, sf):
    """P1 over raw records that name their platform."""
    return normalize(TB.raw_posts(spark, sf))


oracle("normalize_posts", POSTS + f"""SELECT doc_id, platform, title, content,
  CASE WHEN platform = 'youtube' AND NOT regexp_matches(url, '^https?://') THEN 'https://www.youtube.com/watch?v=' || url ELSE url END AS url,
  {Q.ymd(Q.parse_date_null('date_text', 'platform'))} AS published_date FROM posts""")


@register("nested_field")
def q_nested_field(spark, sf):
    e = TB.event_series(spark, sf)
    raw = F.concat(F.lit('{"item": {"props": '), F.coalesce("props", F.lit("null")), F.lit("}}"))
    x = barrier(records.parsed(e.select("event_id", raw.alias("raw"))).drop("raw"))          # parsed once
    deep = records.text("record", "item.props.k")
    return x.select("event_id", deep.alias("k"), deep.alias("deep"), records.text("record", "item.none.k").alias("absent"))


oracle("nested_field", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k,
  coalesce(json_extract_string(props, '$.k'), '') AS deep, '' AS absent FROM events""")


@register("filter_posts")
def q_filter_posts(spark, sf):
    """F1 + P3: platform =, keyword substring, crawled_at between; unified 8 fields."""
    p = TB.posts(spark, sf)
    f = p.where((F.col("platform") == "google") & F.col("keyword").contains("e")
                & F.col("crawled_at").between(F.lit("2021-01-01 00:00:00").cast("timestamp_ntz"),
                                              F.lit("2023-12-31 23:59:59").cast("timestamp_ntz")))
    return f.select("doc_id", "title", "content",
                    F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss").alias("date"),
                    "sentiment", "platform", "keyword",
                    F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))


oracle("filter_posts", POSTS + """SELECT doc_id, title, content, strftime(crawled_at, '%Y-%m-%d %H:%M:%S') AS date,
  sentiment, platform, keyword, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon
FROM posts WHERE platform = 'google' AND contains(keyword, 'e')
  AND crawled_at BETWEEN TIMESTAMP '2021-01-01 00:00:00' AND TIMESTAMP '2023-12-31 23:59:59'""")


@register("platform_rollup")
def q_platform_rollup(spark, sf):
    p = TB.posts(spark, sf)
    return (p.select("platform", S.platform_parent("platform").alias("parent"))
            .groupBy("platform", "parent").agg(F.count(F.lit(1)).alias("n_posts")))


def _parent_sql(e):
    """the roll-up spelled out, not read from the library's lists"""
    return (f"CASE WHEN lower({e}) IN ('naver', 'naver_blog', 'naver_blog_api', 'naver_cafe', 'naver_cafearticle', "
            f"'naver_cafearticle_api', 'naver_news', 'naver_community') OR starts_with(lower({e}), 'naver_') THEN 'naver' "
            f"WHEN lower({e}) IN ('youtube', 'youtube_api') THEN 'youtube' "
            f"WHEN lower({e}) IN ('google', 'google_search', 'google_news') THEN 'google' "
            f"WHEN lower({e}) IN ('buan_gov', 'buan_gov_news', 'buan_gov_notice') THEN 'buan_gov' "
            f"WHEN lower({e}) IN ('community', 'local_community', 'tour_community') THEN 'community' END")


oracle("platform_rollup", POSTS + f"""SELECT platform, {_parent_sql('platform')} AS parent, count(*) AS n_posts
FROM posts GROUP BY ALL""")


@register("url_normalize")
def q_url_normalize(spark, sf):
    pg = TB.pages(spark, sf)
    return pg.select("page_id", S.normalize_url("url").alias("url"), S.url_site_class("url").alias("site_class"))


oracle("url_normalize", """SELECT page_id, regexp_replace(url, '//m\\.', '//', 'g') AS url,
  CASE WHEN contains(url, 'news.naver.com') THEN 'naver_news' WHEN contains(url, 'blog.naver.com') THEN 'naver_blog'
       WHEN contains(url, 'cafe.naver.com') THEN 'naver_cafe' ELSE 'general' END AS site_class FROM pages""")


@register("url_parts")
def q_url_parts(spark, sf):
    pg = TB.pages(spark, sf)
    return pg.select("page_id", S.url_host("url").alias("host"),
                     S.url_query_param("url", "page").alias("page"),
                     S.url_query_param("url", "ref").alias("ref"))


oracle("url_parts", """SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host,
  regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages""")


@register("video_id")
def q_video_id(spark, sf):
    return TB.posts(spark, sf).select("doc_id", S.video_id("url").alias("video_id"))


oracle("video_id", POSTS + f"SELECT doc_id, {Q.video_id('url')} AS video_id FROM posts")


@register("doc_id")
def q_doc_id(spark, sf):
    return TB.posts(spark, sf).select("doc_id", S.doc_key("url", "title").alias("doc_key"))


oracle("doc_id", POSTS + "SELECT doc_id, sha256(coalesce(url, '') || coalesce(title, '')) AS doc_key FROM posts")


@register("label_decode")
def q_label_decode(spark, sf):
    p = TB.posts(spark, sf)
    return p.select("doc_id", S.label_name("sentiment").alias("sentiment_name"),
                    S.label_color("sentiment").alias("sentiment_color"),
                    S.label_code(S.label_name("sentiment")).alias("sentiment_code"))


oracle("label_decode", POSTS + f"""SELECT doc_id, {Q.label_name('sentiment')} AS sentiment_name,
  CASE {Q.label_name('sentiment')} WHEN 'positive' THEN 'green' WHEN 'neutral' THEN 'gray' WHEN 'negative' THEN 'red' END AS sentiment_color,
  CASE {Q.label_name('sentiment')} WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 ELSE 1 END AS sentiment_code
FROM posts""")


@register("kwic_snippet")
def q_kwic(spark, sf):
    p = TB.posts(spark, sf).where(P.region_flag("content"))
    return p.select("doc_id", S.kwic("content").alias("snippet"))


_region_sql = " OR ".join(f"contains(content, {Q.q(k)})" for k in C.REGION_KEYWORDS)
oracle("kwic_snippet", POSTS + f"SELECT doc_id, {Q.kwic('content')} AS snippet FROM posts WHERE {_region_sql}")


@register("surrogate_id")
def q_surrogate_id(spark, sf):
    """Rows without an id get ``yt_%08d`` numbered in ingest order (distributed numbering)."""
    yt = TB.posts(spark, sf).where(F.col("platform") == "youtube").select("doc_id", "ingest_seq")
    numbered = sequence.with_row_index(yt, "ingest_seq", "idx")
    return numbered.select("doc_id", F.format_string("yt_%08d", F.col("idx")).alias("surrogate_id"))


oracle("surrogate_id", POSTS + """SELECT doc_id, 'yt_' || lpad(CAST(row_number() OVER (ORDER BY ingest_seq) - 1 AS VARCHAR), 8, '0') AS surrogate_id
FROM posts WHERE platform = 'youtube'""")


# ------------------------------------------------------------------ predicates

@register("keyword_match_strict")
def q_strict(spark, sf):
    return TB.posts(spark, sf).select("doc_id", P.keyword_match_strict("content").alias("matched"))


def _strict_sql(e):
    region, ands, ors = P.split_keywords(C.KEYWORD_SPEC)
    cond = " AND ".join([Q.contains_ci(e, region)] + [Q.contains_ci(e, k) for k in ands])
    if ors:
        cond += " AND " + Q.contains_any(e, ors)
    return f"coalesce(CASE WHEN {e} IS NOT NULL AND {e} <> '' THEN ({cond}) END, false)"


oracle("keyword_match_strict", POSTS + f"SELECT doc_id, {_strict_sql('content')} AS matched FROM posts")


@register("keyword_match_loose")
def q_loose(spark, sf):
    return TB.posts(spark, sf).select("doc_id", P.keyword_match_loose("content").alias("matched"))


def _loose_sql(e):
    ands = [k for k, c in C.KEYWORD_SPEC if c == "AND" and k]
    ors = [k for k, c in C.KEYWORD_SPEC if c == "OR" and k]
    cond = "true"
    if ands:
        cond = Q.contains_any(e, ands)
        if ors:
            cond += " AND " + Q.contains_any(e, ors)
    return f"coalesce(CASE WHEN {e} IS NOT NULL AND {e} <> '' THEN ({cond}) END, false)"


oracle("keyword_match_loose", POSTS + f"SELECT doc_id, {_loose_sql('content')} AS matched FROM posts")

ALL_ANY_WORDS = ["the", "and", "of"]


@register("keyword_all_any")
def q_all_any(spark, sf):
    p = TB.posts(spark, sf)
    return p.select("doc_id", P.contains_all("title", ALL_ANY_WORDS).alias("has_all"),
                    P.contains_any("title", ALL_ANY_WORDS).alias("has_any"))


oracle("keyword_all_any", POSTS + "SELECT doc_id, " +
       "(" + " AND ".join(Q.contains_ci("title", w) for w in ALL_ANY_WORDS) + ") AS has_all, " +
       Q.contains_any("title", ALL_ANY_WORDS) + " AS has_any FROM posts")


@register("postprocess_filter")
def q_postprocess(spark, sf):
    p = TB.posts(spark, sf)
    return p.where(P.postprocess_keep("title", "content")).select("doc_id")


def _full(e1="title", e2="content"):
    return f"concat_ws(' ', coalesce({e1}, ''), coalesce({e2}, ''))"


oracle("postprocess_filter", POSTS + f"""SELECT doc_id FROM posts
WHERE {Q.contains_any(_full(), C.REQUIRED_KEYWORDS)} AND NOT {Q.contains_any(_full(), C.EXCLUDED_KEYWORDS)}""")


@register("sentiment_eligibility")
def q_eligibility(spark, sf):
    x = T.with_preprocessed(TB.posts(spark, sf).select("doc_id", "content"), "content", "text")
    e = P.sentiment_eligibility("text")
    return x.select("doc_id", e["valid"].alias("valid"), e["reason"].alias("reason"),
                    T.token_estimate("text").alias("est_tokens"))


oracle("sentiment_eligibility", POSTS + f"""SELECT doc_id, {Q.eligibility_reason('text')} = 'ok' AS valid,
  {Q.eligibility_reason('text')} AS reason, CAST(length(text) // 4 AS INTEGER) AS est_tokens
FROM (SELECT doc_id, {Q.basic_clean('content')} AS text FROM posts)""")


@register("content_valid")
def q_content_valid(spark, sf):
    x = T.with_preprocessed(TB.posts(spark, sf).select("doc_id", "content"), "content", "p")
    return x.select("doc_id", P.content_valid("p").alias("valid"))


oracle("content_valid", POSTS + f"""SELECT doc_id, coalesce(length(p) >= {C.MIN_TEXT_LENGTH} AND {Q.word_count('p')} >= {C.MIN_CONTENT_WORDS}
  AND NOT {Q.contains_any('p', C.EXCLUDE_KEYWORDS)}, false) AS valid
FROM (SELECT doc_id, {Q.basic_clean('content')} AS p FROM posts)""")

SCRIPT_CLASS = "[a-zA-Z]"


@register("script_char_filter")
def q_script_chars(spark, sf):
    """F8 with the character class as a parameter (the test pages hold no Hangul)."""
    pg = spread(TB.pages(spark, sf), "page_id")
    return pg.select("page_id", P.script_char_count("html", SCRIPT_CLASS).alias("n_script_chars"),
                     P.script_char_ok("html", char_class=SCRIPT_CLASS).alias("ok"))


oracle("script_char_filter", f"""SELECT page_id, n AS n_script_chars, n >= 50 AS ok
FROM (SELECT page_id, length(html) - length(regexp_replace(html, '{SCRIPT_CLASS}', '', 'g')) AS n FROM pages)""")


@register("confidence_filter")
def q_conf_filter(spark, sf):
    return TB.posts(spark, sf).where(F.col("confidence") >= C.MIN_CONFIDENCE).select("doc_id", "confidence")


oracle("confidence_filter", POSTS + f"SELECT doc_id, confidence FROM posts WHERE confidence >= {C.MIN_CONFIDENCE}")


@register("region_flag")
def q_region_flag(spark, sf):
    return TB.posts(spark, sf).select("doc_id", P.region_flag("content").alias("has_region"))


oracle("region_flag", POSTS + f"SELECT doc_id, coalesce({_region_sql}, false) AS has_region FROM posts")


@register("content_fallback")
def q_content_fallback(spark, sf):
    p = TB.posts(spark, sf)
    c = F.coalesce(F.nullif(T.strip_blank("content"), F.lit("")), F.col("title"))
    return p.select("doc_id", c.alias("content")).where(F.col("content").isNotNull())


oracle("content_fallback", POSTS + f"""SELECT doc_id, content FROM (
  SELECT doc_id, coalesce(nullif({Q.strip_blank('content')}, ''), title) AS content FROM posts) WHERE content IS NOT NULL""")


@register("keyword_string")
def q_keyword_string(spark, sf):
    """Comma-joined original keywords and the quoted command-line keyword string."""
    p = TB.posts(spark, sf)
    words = F.array(F.col("keyword"), F.col("keywords"))
    return p.select("doc_id", F.array_join(words, ",").alias("original_keywords"),
                    T.keywords_string(words).alias("keywords_string"))


oracle("keyword_string", POSTS + f"""SELECT doc_id, array_to_string([keyword, keywords], ',') AS original_keywords,
  array_to_string(list_transform(list_filter(list_transform([keyword, keywords], lambda k: {Q.strip_blank('k')}), lambda k: k <> ''),
    lambda k: CASE WHEN contains(k, ' ') THEN '"' || k || '"' ELSE k END), ' ') AS keywords_string FROM posts""")


@register("flatten_video")
def q_flatten_video(spark, sf):
    """P10 (+D8, P7): video API answers (nested JSON built from the youtube posts) parsed with a
    fixed schema and flattened; missing statistics default to 0, a missing publish time to as_of."""
    yt = TB.posts(spark, sf).where(F.col("platform") == "youtube")
    n = F.col("doc_id")
    answer = F.to_json(F.struct(
        F.concat(F.lit("v"), n.cast("string")).alias("id"),
        F.struct(F.col("title").alias("title"), F.col("content").alias("description"),
                 F.when(n % 5 != 0, F.concat(F.date_format("base_date", "yyyy-MM-dd"), F.lit("T08:00:00Z")))
                 .alias("publishedAt"), F.col("source").alias("channelTitle")).alias("snippet"),
        F.struct(F.when(n % 4 != 0, (n * 3).cast("string")).alias("viewCount"),
                 F.when(n % 6 != 0, (n % 97).cast("string")).alias("likeCount"),
                 (n % 13).cast("string").alias("commentCount")).alias("statistics"),
        F.struct(F.concat(F.lit("PT"), (n % 60).cast("string"), F.lit("M")).alias("duration")).alias("contentDetails")))
    raw = yt.select(answer.alias("raw"))
    schema = ("id string, snippet struct<title:string,description:string,publishedAt:string,channelTitle:string>, "
              "statistics struct<viewCount:string,likeCount:string,commentCount:string>, "
              "contentDetails struct<duration:string>")
    v = raw.select(F.from_json("raw", schema).alias("v")).select("v.*")

    def stat(name):
        return F.coalesce(F.coalesce(F.col(f"statistics.{name}"), F.lit("0")).try_cast("long"), F.lit(0))

    return v.select(
        F.sha2(F.concat(F.lit("youtube_"), F.col("id")), 256).alias("doc_key"),
        F.col("snippet.title").alias("title"), F.col("snippet.description").alias("content"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id")).alias("url"),
        D.iso_to_ymd(F.col("snippet.publishedAt")).alias("published_date"),
        F.col("snippet.channelTitle").alias("channel_title"),
        stat("viewCount").alias("view_count"), stat("likeCount").alias("like_count"),
        stat("commentCount").alias("comment_count"), F.col("contentDetails.duration").alias("duration"))


oracle("flatten_video", POSTS + f"""SELECT sha256('youtube_v' || doc_id) AS doc_key, title, content,
  'https://www.youtube.com/watch?v=v' || doc_id AS url,
  CASE WHEN doc_id % 5 <> 0 THEN strftime(base_date, '%Y%m%d') ELSE {Q.ymd(Q.as_of())} END AS published_date,
  source AS channel_title, CASE WHEN doc_id % 4 <> 0 THEN doc_id * 3 ELSE 0 END AS view_count,
  CASE WHEN doc_id % 6 <> 0 THEN doc_id % 97 ELSE 0 END AS like_count, doc_id % 13 AS comment_count,
  'PT' || (doc_id % 60) || 'M' AS duration FROM posts WHERE platform = 'youtube'""")
