"""Queries over relational operators: dedup (W1-W4), sets (U*), joins (J*), aggregates (A*),
ranking (W5-W10) and validation (V*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import dategrammar as G
from postlens.functions import dates as D
from postlens.functions import predicates as P
from postlens.functions import shape as S
from postlens.functions import text as T
from postlens.operators import dedup, scoring, stats
from postlens.operators.rowops import barrier
from postlens.plans import analysis
from postlens.plans import sqlfrag as Q
from postlens.plans.queries_scalar import _parent_sql
from postlens.plans.registry import register
from postlens.sources import tables as TB

ORACLE: dict[str, str] = {}
POSTS = Q.with_ctes(Q.posts_cte())
ANALYZED = Q.with_ctes(Q.posts_cte(), Q.analyzed_cte())


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


def _analyzed(spark, sf):
    return analysis.analyze_dataset(TB.posts(spark, sf))


# ------------------------------------------------------------------ dedup

@register("dedup_exact")
def q_dedup_exact(spark, sf):
    """Whole rows, the first of each (title, content, date)."""
    p = TB.posts(spark, sf).select("doc_id", "ingest_seq", "platform", "title", "content", "url", "date_text")
    return dedup.first_rows(p, ["title", "content", "date_text"]).drop("ingest_seq")


def _rank_sql(cols, keys, order="ingest_seq", src="posts"):
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
            f"FROM {src}) WHERE rn = 1")


oracle("dedup_exact", POSTS + _rank_sql("doc_id, platform, title, content, url, date_text", "title, content, date_text"))


@register("dedup_content")
def q_dedup_content(spark, sf):
    """W1 on the text alone: exact copies collapse to their first occurrence."""
    p = TB.posts(spark, sf).select("doc_id", "ingest_seq", "content")
    return dedup.first_rows(p, ["content"]).drop("ingest_seq")


oracle("dedup_content", POSTS + _rank_sql("doc_id, content", "content"))


@register("dedup_doc_id")
def q_dedup_doc_id(spark, sf):
    p = TB.posts(spark, sf).select("doc_id", "ingest_seq", "platform", "title", "url", S.doc_key("url", "title").alias("doc_key"))
    return dedup.keep_first(p, ["doc_key"]).drop("ingest_seq")


oracle("dedup_doc_id", POSTS + _rank_sql("doc_key, doc_id, platform, title, url", "doc_key",
                                         src="(SELECT *, sha256(coalesce(url, '') || coalesce(title, '')) AS doc_key FROM posts)"))


@register("dedup_keyword_url")
def q_dedup_keyword_url(spark, sf):
    p = TB.posts(spark, sf).select("doc_id", "ingest_seq", "keyword", "url", "platform", "title", "date_text")
    return dedup.keep_first(p, ["keyword", "url"]).drop("ingest_seq")


oracle("dedup_keyword_url", POSTS + _rank_sql("keyword, url, doc_id, platform, title, date_text", "keyword, url"))


@register("dedup_last_wins")
def q_dedup_last_wins(spark, sf):
    """W4 keyed by the text: the last record wins, ``first_seq`` keeps the first position."""
    p = TB.posts(spark, sf).select("doc_id", "ingest_seq", "platform", "url", "date_text", F.sha2("content", 256).alias("key"))
    return dedup.keep_last(p, ["key"]).drop("ingest_seq")


oracle("dedup_last_wins", POSTS + """SELECT k.key, p.doc_id, p.platform, p.url, p.date_text, k.first_seq FROM (
  SELECT sha256(content) AS key, max(ingest_seq) AS last_seq, min(ingest_seq) AS first_seq FROM posts GROUP BY ALL) k
JOIN posts p ON p.ingest_seq = k.last_seq""")


@register("incremental_new_posts")
def q_incremental(spark, sf):
    return dedup.new_only(TB.posts(spark, sf).select("doc_id", "url"), TB.seen_keys(spark, sf))


oracle("incremental_new_posts", POSTS + f"""SELECT doc_id, url FROM posts
WHERE doc_id NOT IN (SELECT doc_id FROM posts WHERE base_date < DATE '{TB.SEEN_BEFORE}')""")


# ------------------------------------------------------------------ sets

@register("union_platforms")
def q_union_platforms(spark, sf):
    """Per-platform results with different columns, union by name."""
    p = TB.posts(spark, sf)
    yt = p.where(F.col("platform") == "youtube").select(
        "doc_id", "platform", F.col("source").alias("channel_title"),
        (F.col("doc_id") * 3).alias("view_count"))
    gov = p.where(F.col("platform") == "buan_gov").select("doc_id", "platform", F.col("lang").alias("board"))
    rest = p.where(~F.col("platform").isin("youtube", "buan_gov")).select(
        "doc_id", "platform", F.col("source").alias("blog_name"))
    return yt.unionByName(gov, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


oracle("union_platforms", POSTS + """SELECT doc_id, platform, source AS channel_title, doc_id * 3 AS view_count FROM posts WHERE platform = 'youtube'
UNION ALL BY NAME SELECT doc_id, platform, lang AS board FROM posts WHERE platform = 'buan_gov'
UNION ALL BY NAME SELECT doc_id, platform, source AS blog_name FROM posts WHERE platform NOT IN ('youtube', 'buan_gov')""")

REQUESTED_MODELS = C.MODEL_SETS["heavy"] + ["koalpaca"]
AVAILABLE_FROM = 0.5


@register("missing_models")
def q_missing_models(spark, sf):
    """For each source, the requested models minus those that gave one of its posts a vote of at
    least AVAILABLE_FROM; both sides come from the documents."""
    d = TB.table(spark, sf, "documents").select("source")
    req = d.distinct().select("source", F.explode(F.array(*[F.lit(m) for m in REQUESTED_MODELS])).alias("model"))
    v = analysis.model_votes(TB.posts(spark, sf), keep=("doc_id", "source"))
    have = v.where(F.col("confidence") >= AVAILABLE_FROM).select("source", "model").distinct()
    return req.join(have, ["source", "model"], "left_anti")


oracle("missing_models", Q.with_ctes(Q.posts_cte(), Q.votes_cte()) + f"""SELECT source, model FROM (
  SELECT DISTINCT source, unnest({Q.arr(REQUESTED_MODELS)}) AS model FROM documents)
EXCEPT SELECT d.source, v.model FROM votes v JOIN documents d USING (doc_id) WHERE v.confidence >= {AVAILABLE_FROM}""")


@register("distinct_platforms")
def q_distinct_platforms(spark, sf):
    return TB.posts(spark, sf).select("platform").distinct()


oracle("distinct_platforms", POSTS + "SELECT DISTINCT platform FROM posts")


# ------------------------------------------------------------------ joins

@register("score_join")
def q_score_join(spark, sf):
    """Scores equi-joined back to their posts on doc_id (no positional zip)."""
    scored = _analyzed(spark, sf).select("doc_id", F.col("sentiment").alias("predicted"))
    p = TB.posts(spark, sf).select("doc_id", "platform", F.col("sentiment").alias("labelled"))
    j = p.join(scored, "doc_id")
    return j.select("doc_id", "platform", "labelled", "predicted",
                    (F.col("labelled") == F.col("predicted")).alias("agree"))


oracle("score_join", ANALYZED + """SELECT p.doc_id, p.platform, p.sentiment AS labelled, a.sentiment AS predicted,
  p.sentiment = a.sentiment AS agree FROM posts p JOIN analyzed a ON p.doc_id = a.doc_id""")

REQUESTED_SET = ["kcelectra-base-v2022", "kobert"]


def _dataset_path(p):
    return F.concat(F.col("platform"), F.lit("_"), F.col("lang"), F.lit(".json"))


@register("analyzed_semi")
def q_analyzed_semi(spark, sf):
    """Datasets already analysed with the same set of models (semi join on path + set)."""
    p = TB.posts(spark, sf)
    datasets = p.select(_dataset_path(p).alias("file_path")).distinct()
    seen = p.where(F.col("base_date") < F.lit(TB.SEEN_BEFORE).cast("date"))
    models = F.when(F.col("lang").isin("en", "de"), F.array(*[F.lit(m) for m in C.MODEL_SETS["light"]])) \
        .otherwise(F.array(*[F.lit(m) for m in C.MODEL_SETS["balanced"]]))
    history = seen.select(_dataset_path(seen).alias("file_path"), models.alias("models"))
    same = F.array_sort(F.array_distinct("models")) == F.array_sort(F.array(*[F.lit(m) for m in REQUESTED_SET]))
    done = history.where(same).select("file_path").distinct()      # partial aggregate before the join
    return datasets.join(done, "file_path", "left_semi")


oracle("analyzed_semi", POSTS + f"""SELECT DISTINCT platform || '_' || lang || '.json' AS file_path FROM posts
WHERE platform || '_' || lang || '.json' IN (
  SELECT platform || '_' || lang || '.json' FROM posts WHERE base_date < DATE '{TB.SEEN_BEFORE}'
    AND list_sort(list_distinct(CASE WHEN lang IN ('en', 'de') THEN {Q.arr(C.MODEL_SETS['light'])} ELSE {Q.arr(C.MODEL_SETS['balanced'])} END))
        = list_sort({Q.arr(REQUESTED_SET)}))""")

MAX_COMMENTS = 20


@register("videos_with_comments")
def q_videos_with_comments(spark, sf):
    """Video rows joined with their comment count and first MAX_COMMENTS authors in order.

    The per-video list is built from ``row_number() <= MAX_COMMENTS`` (partial window group limit
    before the shuffle), so a video with millions of comments never lands whole in one task.
    """
    vids = TB.posts(spark, sf).where(F.col("platform") == "youtube").select("doc_id", "title")
    c = TB.comments(spark, sf)
    counts = c.groupBy("video_key").agg(F.count(F.lit(1)).alias("n_comments"))
    firsts = stats.top_per_group(c, "video_key", [F.col("turn")], MAX_COMMENTS)
    lists = firsts.groupBy("video_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "author"))),
                                 lambda s: s["author"]), "|").alias("first_authors"))
    agg = counts.join(lists, "video_key")
    j = vids.join(agg, vids.doc_id == agg.video_key, "left")
    return j.select("doc_id", "title", F.coalesce("n_comments", F.lit(0)).alias("n_comments"),
                    "first_authors")


oracle("videos_with_comments", Q.with_ctes(Q.posts_cte(), Q.comments_cte()) + f"""SELECT v.doc_id, v.title, coalesce(a.n_comments, 0) AS n_comments, a.first_authors
FROM (SELECT doc_id, title FROM posts WHERE platform = 'youtube') v LEFT JOIN (
  SELECT video_key, count(*) AS n_comments,
         string_agg(author, '|' ORDER BY turn) FILTER (WHERE rn <= {MAX_COMMENTS}) AS first_authors
  FROM (SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY turn) AS rn FROM comments) GROUP BY video_key
) a ON v.doc_id = a.video_key""")


@register("comment_cap")
def q_comment_cap(spark, sf):
    c = TB.comments(spark, sf)
    return stats.top_per_group(c, "video_key", [F.col("turn")], MAX_COMMENTS).select("video_key", "turn", "author")


oracle("comment_cap", Q.with_ctes(Q.comments_cte()) + f"""SELECT video_key, turn, author FROM (
  SELECT *, row_number() OVER (PARTITION BY video_key ORDER BY turn) AS rn FROM comments) WHERE rn <= {MAX_COMMENTS}""")


@register("flatten_comments")
def q_flatten_comments(spark, sf):
    """Thread answers (one JSON page per comment) parsed with a fixed schema and flattened; no
    list of a video's comments is ever built."""
    c = TB.comments(spark, sf)
    snippet = F.struct(F.struct(F.col("author").alias("authorDisplayName"), F.col("text").alias("textDisplay"),
                                F.col("turn").cast("string").alias("position")).alias("snippet"))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(snippet.alias("topLevelComment")).alias("snippet"))).alias("items")))
    raw = c.select("video_key", answer.alias("raw"))
    schema = ("items array<struct<snippet:struct<topLevelComment:struct<snippet:"
              "struct<authorDisplayName:string,textDisplay:string,position:string>>>>>")
    item = raw.select("video_key", F.explode(F.from_json("raw", schema)["items"]).alias("i"))
    s = F.col("i.snippet.topLevelComment.snippet")
    return item.select("video_key", s["position"].cast("long").alias("turn"), s["authorDisplayName"].alias("author"), s["textDisplay"].alias("text"))


oracle("flatten_comments", Q.with_ctes(Q.comments_cte()) + "SELECT video_key, turn, author, text FROM comments")


@register("post_details")
def q_post_details(spark, sf):
    """List rows joined to detail rows on url; detail fields override list fields."""
    p = TB.posts(spark, sf)
    listing = p.select("doc_id", "url", "title")
    detail = p.where(F.col("platform").isin("buan_gov", "dcinside")).select(
        "url", T.clean_title("title").alias("d_title"), D.parse_date_split("date_text").alias("d_date"))
    j = listing.join(detail, "url")
    return j.select("doc_id", F.coalesce("d_title", "title").alias("title"), F.col("d_date").alias("date"))


def _clean_title_sql(e):
    t = Q.rx_replace(e, C.EMOJI_CLASS, "")
    t = Q.rx_replace(t, T.TAG_RE, "")
    t = Q.rx_replace(t, "&nbsp;|\\x{00A0}", " ")
    t = Q.rx_replace(t, "\\x{200B}", "")
    return Q.strip_blank(Q.collapse_blank(t))


oracle("post_details", POSTS + f"""SELECT l.doc_id, coalesce(d.d_title, l.title) AS title, d.d_date AS date
FROM posts l JOIN (SELECT url, {_clean_title_sql('title')} AS d_title, {Q.parse_date_split('date_text')} AS d_date
                   FROM posts WHERE platform IN ('buan_gov', 'dcinside')) d ON l.url = d.url""")

RESULTS_PER_PAGE = 10
PAGES_PER_RUN = 1000


@register("collection_grid")
def q_collection_grid(spark, sf):
    """J7 re-aimed: the (keyword x target x page) work grid, derived by grouping the collected posts
    (pages of RESULTS_PER_PAGE needed per keyword and platform) instead of a cross join."""
    g = TB.posts(spark, sf).groupBy("keyword", "platform").agg(F.count(F.lit(1)).alias("n"))
    last = F.ceil(F.col("n") / RESULTS_PER_PAGE).cast("int")
    # two levels, so that no row ever holds more than PAGES_PER_RUN pages and big groups spread
    runs = g.select("keyword", "platform", last.alias("last"),
                    F.explode(F.sequence(F.lit(0), F.floor((last - 1) / PAGES_PER_RUN).cast("int"))).alias("run"))
    first = F.col("run") * PAGES_PER_RUN + 1
    return runs.select("keyword", "platform", F.explode(F.sequence(
        first, F.least(F.col("last"), first + PAGES_PER_RUN - 1))).alias("page"))


oracle("collection_grid", POSTS + f"""SELECT keyword, platform, CAST(page AS INTEGER) AS page FROM (
  SELECT keyword, platform, count(*) AS n FROM posts GROUP BY ALL), range(1, CAST(ceil(n / {RESULTS_PER_PAGE}.0) AS BIGINT) + 1) t(page)""")


@register("post_keyword_match")
def q_post_keyword_match(spark, sf):
    """Which configured keywords occur in which post; row-local explode (the keyword list is a
    literal of fixed size), no join."""
    kws = F.array(*[F.lit(k) for k in C.REGION_KEYWORDS])
    p = TB.posts(spark, sf)
    return p.select("doc_id", F.explode(F.filter(kws, lambda k: F.contains(F.col("content"), k))).alias("keyword"))


oracle("post_keyword_match", POSTS + f"""SELECT p.doc_id, k.kw AS keyword FROM posts p, (SELECT unnest({Q.arr(C.REGION_KEYWORDS)}) AS kw) k
WHERE contains(p.content, k.kw)""")


# ------------------------------------------------------------------ aggregates

@register("platform_stats")
def q_platform_stats(spark, sf):
    return TB.posts(spark, sf).groupBy("platform").agg(F.count(F.lit(1)).alias("n_posts"))


oracle("platform_stats", POSTS + "SELECT platform, count(*) AS n_posts FROM posts GROUP BY platform")


@register("keyword_stats")
def q_keyword_stats(spark, sf):
    words = F.split(T.strip_blank("keywords"), f"{T.BLANK}+")
    x = TB.posts(spark, sf).select(F.explode(words).alias("word")).where(F.col("word") != "")
    return x.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


oracle("keyword_stats", POSTS + f"""SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array({Q.strip_blank('keywords')}, '{T.BLANK}+')) AS word FROM posts) WHERE word <> '' GROUP BY word""")


@register("hourly_trend")
def q_hourly_trend(spark, sf):
    e = TB.event_series(spark, sf)
    return e.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


oracle("hourly_trend", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")


@register("sentiment_counts")
def q_sentiment_counts(spark, sf):
    """A4: four fixed buckets (ints or names; null or other -> unknown) in one pass."""
    b = S.label_bucket("sentiment")
    return TB.posts(spark, sf).agg(*[F.count_if(b == k).alias(k) for k in ("positive", "neutral", "negative", "unknown")])


oracle("sentiment_counts", POSTS + "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {Q.label_bucket('sentiment')} = '{k}') AS {k}"
    for k in ("positive", "neutral", "negative", "unknown")) + " FROM posts")


def _shares_sql(src):
    return (f"SELECT count(*) AS n_rows, " + ", ".join(
        f"round(count(*) FILTER (WHERE sentiment = {k}) * 100.0 / count(*), 6) AS pct_{n}" for k, n in C.LABEL_NAMES.items())
        + f" FROM {src}")


@register("sentiment_distribution")
def q_sentiment_distribution(spark, sf):
    return stats.label_shares(_analyzed(spark, sf))


oracle("sentiment_distribution", ANALYZED + _shares_sql("analyzed"))


@register("date_counts")
def q_date_counts(spark, sf):
    d = F.col("date_text")
    day = F.when(F.length(d) >= 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))) \
        .otherwise(F.lit("unknown"))
    return TB.posts(spark, sf).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


oracle("date_counts", POSTS + """SELECT CASE WHEN length(date_text) >= 8 THEN substr(date_text, 1, 4) || '-' || substr(date_text, 5, 2) || '-' || substr(date_text, 7, 2)
  ELSE 'unknown' END AS day, count(*) AS n FROM posts GROUP BY 1""")


def _pivot_sql(src, by):
    return (f"SELECT {by}, " + ", ".join(f"count(*) FILTER (WHERE sentiment = {k}) AS {n}" for k, n in C.LABEL_NAMES.items())
            + f" FROM {src} GROUP BY {by}")


@register("platform_sentiment_pivot")
def q_platform_pivot(spark, sf):
    return stats.pivot_labels(_analyzed(spark, sf), "platform")


oracle("platform_sentiment_pivot", ANALYZED + _pivot_sql("analyzed", "platform"))


@register("time_unit")
def q_time_unit(spark, sf):
    """T12 per platform: span of parsed dates -> period unit."""
    d = TB.posts(spark, sf).select("platform", D.parse_date_trend("date_text").alias("d"))
    g = d.groupBy("platform").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where(F.col("lo").isNotNull())
    span = F.datediff("hi", "lo")
    return g.select("platform", F.date_format("lo", "yyyy-MM-dd").alias("min_date"),
                    F.date_format("hi", "yyyy-MM-dd").alias("max_date"), span.alias("span_days"),
                    stats.period_unit(span).alias("unit"))


def _unit_sql(span):
    out = "CASE " + " ".join(f"WHEN {span} > {lim} THEN '{u}'" for lim, u in C.PERIOD_UNIT_STEPS) + " ELSE 'D' END"
    return out


oracle("time_unit", POSTS + f"""SELECT platform, strftime(lo, '%Y-%m-%d') AS min_date, strftime(hi, '%Y-%m-%d') AS max_date,
  CAST(hi - lo AS INTEGER) AS span_days, {_unit_sql('(hi - lo)')} AS unit FROM (
  SELECT platform, min(d) AS lo, max(d) AS hi FROM (SELECT platform, {Q.parse_date_trend('date_text')} AS d FROM posts)
  WHERE d IS NOT NULL GROUP BY platform)""")


@register("sentiment_trend")
def q_sentiment_trend(spark, sf):
    """Parse dates (D7, unparsed rows left out), unit from the global span (T12), bins labelled
    with the period end, label counts per bin.

    Rows are first reduced to label counts per day (partial + final aggregate).  The daily table
    holds at most one row per calendar day, so the span (min / max day) is a window over that
    small table; everything after the first aggregate touches only it.  One scan of the posts."""
    a = _analyzed(spark, sf).select("sentiment", D.parse_date_trend("published_date").alias("d"))
    daily = stats.label_counts(a.where(F.col("d").isNotNull()), by=["d"])
    everything = Window.partitionBy()
    daily = (daily.withColumn("lo", F.min("d").over(everything))
             .withColumn("hi", F.max("d").over(everything)))
    unit = stats.period_unit(F.datediff("hi", "lo"))
    binned = daily.select(F.date_format(stats.period_end(F.col("d"), unit, F.trunc("lo", "MM")),
                                        "yyyy-MM-dd").alias("period"), unit.alias("unit"),
                          *C.LABEL_NAMES.values())
    return binned.groupBy("period", "unit").agg(*[F.sum(n).alias(n) for n in C.LABEL_NAMES.values()])


def _period_end_sql(d, unit, m0):
    k = f"CAST(datediff('month', {m0}, date_trunc('month', {d})) AS INTEGER)"
    q3 = f"last_day({m0} + to_months(CAST(ceil({k} / 3.0) * 3 AS INTEGER)))"
    return (f"CASE {unit} WHEN 'D' THEN {d} WHEN 'W' THEN {d} + CAST((7 - dayofweek({d})) % 7 AS INTEGER) "
            f"WHEN 'M' THEN last_day({d}) WHEN '3M' THEN {q3} ELSE make_date(year({d}), 12, 31) END")


oracle("sentiment_trend", ANALYZED + f"""SELECT strftime(CAST(pe AS DATE), '%Y-%m-%d') AS period, unit,
  count(*) FILTER (WHERE sentiment = 0) AS negative, count(*) FILTER (WHERE sentiment = 1) AS neutral,
  count(*) FILTER (WHERE sentiment = 2) AS positive
FROM (SELECT sentiment, unit, {_period_end_sql('d', 'unit', 'm0')} AS pe FROM (
  SELECT x.sentiment, x.d, b.unit, b.m0 FROM (SELECT sentiment, {Q.parse_date_trend('published_date')} AS d FROM analyzed) x,
    (SELECT {_unit_sql('(max(d) - min(d))')} AS unit, CAST(date_trunc('month', min(d)) AS DATE) AS m0
     FROM (SELECT {Q.parse_date_trend('published_date')} AS d FROM analyzed) WHERE d IS NOT NULL) b
  WHERE x.d IS NOT NULL)) GROUP BY ALL""")


def _region_top(spark, sf):
    a = _analyzed(spark, sf).where(P.region_flag("content"))
    return a.orderBy(F.col("confidence").desc(), F.col("doc_id")).limit(C.TOP_CONFIDENCE_ROWS)


@register("region_sentiment")
def q_region_sentiment(spark, sf):
    """Label counts of all region posts (``_region_top`` has the most confident ones only)."""
    return stats.label_counts(_analyzed(spark, sf).where(P.region_flag("content")))


_region_sql = " OR ".join(f"contains(content, {Q.q(k)})" for k in C.REGION_KEYWORDS)
_REGION_TOP = f"(SELECT * FROM analyzed WHERE {_region_sql} ORDER BY confidence DESC, doc_id LIMIT {C.TOP_CONFIDENCE_ROWS})"
oracle("region_sentiment", ANALYZED + "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE sentiment = {k}) AS {n}" for k, n in C.LABEL_NAMES.items()) + f" FROM analyzed WHERE {_region_sql}")


@register("region_topk")
def q_region_topk(spark, sf):
    """Top 500 region posts by confidence, then top 5 per label, with keyword snippets."""
    top = _region_top(spark, sf)
    best = stats.top_per_group(top, "sentiment", [F.col("confidence").desc(), F.col("doc_id")], C.TOP_PER_LABEL)
    return best.select("doc_id", "sentiment", "confidence", S.kwic("content").alias("snippet"))


oracle("region_topk", ANALYZED + f"""SELECT doc_id, sentiment, confidence, {Q.kwic('content')} AS snippet FROM (
  SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY confidence DESC, doc_id) AS rn FROM {_REGION_TOP})
WHERE rn <= {C.TOP_PER_LABEL}""")


@register("comment_sentiments")
def q_comment_sentiments(spark, sf):
    """A10: label counts of each video's comments (all three labels counted), as the scorer labels them."""
    return stats.label_counts(analysis.comment_labels(TB.comments(spark, sf)), "label", by=["video_key"])


oracle("comment_sentiments", Q.with_ctes(Q.comments_cte(), Q.comment_labels_cte()) + "SELECT video_key, " + ", ".join(
    f"count(*) FILTER (WHERE label = {k}) AS {n}" for k, n in C.LABEL_NAMES.items()) + " FROM labelled GROUP BY video_key")


@register("comment_scores")
def q_comment_scores(spark, sf):
    """M8: every comment scored with the native scorer (blank text -> (1, 0.0))."""
    c = scoring.with_rule_score(TB.comments(spark, sf), "text", "s")
    return c.select("video_key", "turn", F.col("s.label").alias("sentiment"),
                    F.round("s.confidence", 6).alias("confidence"))


oracle("comment_scores", Q.with_ctes(Q.comments_cte()) + f"""SELECT video_key, turn, s.label AS sentiment, round(s.confidence, 6) AS confidence
FROM (SELECT video_key, turn, {Q.rule_score('text')} AS s FROM comments)""")


@register("post_scores")
def q_post_scores(spark, sf):
    """M8: a post's title and content scored together; blank ones have no score."""
    p = TB.posts(spark, sf).select("doc_id", F.concat_ws(" ", "title", "content").alias("text"))
    return scoring.score_or_null(p, "text", "s").select(
        "doc_id", F.col("s.label").alias("sentiment"), F.round("s.confidence", 6).alias("confidence"))


oracle("post_scores", POSTS + f"""SELECT doc_id, CASE WHEN has THEN s.label END AS sentiment, CASE WHEN has THEN round(s.confidence, 6) END AS confidence
FROM (SELECT doc_id, length({Q.strip_blank('t')}) > 0 AS has, {Q.rule_score('t')} AS s
      FROM (SELECT doc_id, concat_ws(' ', title, content) AS t FROM posts))""")


@register("overall_sentiment")
def q_overall_sentiment(spark, sf):
    """A video's label is replaced by its comments' majority label when it has more than 5
    labelled comments, a (truthy) label of its own, and the majority differs and holds > 60 %.
    Majority ties go positive, neutral, negative (the fixed order of the count table)."""
    vids = TB.posts(spark, sf).where(F.col("platform") == "youtube").select("doc_id", "sentiment")
    cnt = stats.label_counts(analysis.comment_labels(TB.comments(spark, sf)), "label", by=["video_key"])
    j = vids.join(cnt, vids.doc_id == cnt.video_key, "left")
    total = F.coalesce(F.col("negative") + F.col("neutral") + F.col("positive"), F.lit(0))
    overall = stats.comment_override(F.col("sentiment"), F.col("negative"), F.col("neutral"), F.col("positive"))
    return j.select("doc_id", "sentiment", total.alias("n_comments"), overall.alias("overall"))


oracle("overall_sentiment", Q.with_ctes(Q.posts_cte(), Q.comments_cte(), Q.comment_labels_cte()) + f"""SELECT doc_id, sentiment, n_comments,
  CAST(CASE WHEN n_comments > {C.COMMENT_MIN_COUNT} AND sentiment IS NOT NULL AND sentiment <> 0 AND major <> sentiment
            AND top > n_comments * {C.COMMENT_MIN_SHARE} THEN major ELSE sentiment END AS INTEGER) AS overall
FROM (SELECT v.doc_id, v.sentiment, coalesce(c.negative + c.neutral + c.positive, 0) AS n_comments,
        greatest(c.positive, c.neutral, c.negative) AS top,
        CASE WHEN c.positive = greatest(c.positive, c.neutral, c.negative) THEN 2
             WHEN c.neutral = greatest(c.positive, c.neutral, c.negative) THEN 1 ELSE 0 END AS major
      FROM (SELECT doc_id, sentiment FROM posts WHERE platform = 'youtube') v LEFT JOIN (
        SELECT video_key, count(*) FILTER (WHERE label = 0) AS negative, count(*) FILTER (WHERE label = 1) AS neutral,
               count(*) FILTER (WHERE label = 2) AS positive FROM labelled GROUP BY video_key) c ON v.doc_id = c.video_key)""")


def _vote_sql(src):
    return f"""SELECT doc_id, label AS sentiment, round(mean_conf, 6) AS confidence, n_votes AS votes FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_votes DESC, mean_conf DESC, first_ord) AS rn FROM (
    SELECT doc_id, label, count(*) AS n_votes, avg(confidence) AS mean_conf, min(model_ord) AS first_ord
    FROM {src} GROUP BY doc_id, label)) WHERE rn = 1"""


@register("ensemble_vote")
def q_ensemble_vote(spark, sf):
    """A12 on the row: the members' votes never leave their post."""
    return analysis.row_votes(TB.posts(spark, sf))


VOTES = Q.with_ctes(Q.posts_cte(), Q.votes_cte())
oracle("ensemble_vote", VOTES + _vote_sql("votes"))


@register("analyze_ensemble")
def q_analyze_ensemble(spark, sf):
    """M6 with the balanced set: the members' votes are decided on the row."""
    return analysis.analyze_ensemble(TB.posts(spark, sf), scoring.resolve_model_set("balanced"))


_BALANCED = f"(SELECT * FROM votes WHERE model IN ({', '.join(Q.q(m) for m in C.MODEL_SETS['balanced'])}))"
oracle("analyze_ensemble", VOTES + f"""SELECT v.doc_id, p.platform, v.sentiment, v.confidence, {len(C.MODEL_SETS['balanced'])} AS n_models
FROM ({_vote_sql(_BALANCED)}) v JOIN posts p USING (doc_id)""")


@register("ensemble_by_set")
def q_ensemble_by_set(spark, sf):
    """M5: the vote restricted to a named model set."""
    return analysis.row_votes(TB.posts(spark, sf), scoring.resolve_model_set("balanced"))


oracle("ensemble_by_set", VOTES + _vote_sql(_BALANCED))


@register("model_vote_summary")
def q_model_vote_summary(spark, sf):
    v = analysis.model_votes(TB.posts(spark, sf))
    return v.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"),
                                           F.round(F.avg("confidence"), 6).alias("mean_confidence"))


oracle("model_vote_summary", VOTES +
       "SELECT model, label, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM votes GROUP BY model, label")


@register("date_profile")
def q_date_profile(spark, sf):
    """Min / max parsed date and valid / invalid / blank counts in one aggregate."""
    p = TB.posts(spark, sf).select("date_text", D.parse_date_trend("date_text").alias("d"))
    blank = T.strip_blank("date_text") == ""
    return p.agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("min_date"),
                 F.date_format(F.max("d"), "yyyy-MM-dd").alias("max_date"),
                 F.count_if(F.col("d").isNotNull()).alias("n_valid"),
                 F.count_if(F.col("d").isNull() & ~blank).alias("n_invalid"),
                 F.count_if(blank).alias("n_blank"))


oracle("date_profile", POSTS + f"""SELECT strftime(min(d), '%Y-%m-%d') AS min_date, strftime(max(d), '%Y-%m-%d') AS max_date,
  count(*) FILTER (WHERE d IS NOT NULL) AS n_valid, count(*) FILTER (WHERE d IS NULL AND {Q.strip_blank('date_text')} <> '') AS n_invalid,
  count(*) FILTER (WHERE {Q.strip_blank('date_text')} = '') AS n_blank
FROM (SELECT date_text, {Q.parse_date_trend('date_text')} AS d FROM posts)""")


@register("run_summary")
def q_run_summary(spark, sf):
    """Total and per-platform counts; the total is the rollup's null group."""
    return TB.posts(spark, sf).rollup("platform").agg(F.count(F.lit(1)).alias("n_posts"))


oracle("run_summary", POSTS + "SELECT platform, count(*) AS n_posts FROM posts GROUP BY ROLLUP (platform)")


def _word_freq_sql(where=""):
    return ANALYZED + f"""SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(content), '{T.WORD}{{2,}}')) AS word FROM analyzed {where})
GROUP BY word"""


@register("word_freq")
def q_word_freq(spark, sf):
    return stats.word_freq(_analyzed(spark, sf), "content")


oracle("word_freq", _word_freq_sql())


@register("word_freq_positive")
def q_word_freq_positive(spark, sf):
    return stats.word_freq(_analyzed(spark, sf).where(F.col("sentiment") == 2), "content")


oracle("word_freq_positive", _word_freq_sql("WHERE sentiment = 2"))


@register("recent_articles")
def q_recent_articles(spark, sf):
    """N most recent posts (TakeOrderedAndProject), 4 columns plus the key."""
    p = TB.posts(spark, sf)
    top = p.orderBy(F.col("crawled_at").desc(), F.col("doc_id").desc()).limit(C.RECENT_DEFAULT_N)
    return top.select("doc_id", "title", "platform",
                      F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss").alias("date"), "url")


oracle("recent_articles", POSTS + f"""SELECT doc_id, title, platform, strftime(crawled_at, '%Y-%m-%d %H:%M:%S') AS date, url
FROM posts ORDER BY crawled_at DESC, doc_id DESC LIMIT {C.RECENT_DEFAULT_N}""")


@register("report_sample")
def q_report_sample(spark, sf):
    """Distinct non-null contents, deterministic sample of 10 (by content hash),
    truncated to an excerpt.  Digests find the sample; only its posts' texts are read again."""
    p = TB.posts(spark, sf)
    d = analysis.analyze_dataset(p).select("doc_id", F.sha2("content", 256).alias("digest"))
    ids = d.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).orderBy("digest").limit(C.REPORT_SAMPLE_N)
    picked = p.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    return analysis.analyze_dataset(picked).select(S.excerpt("content").alias("excerpt"))


oracle("report_sample", ANALYZED + f"""SELECT left(content, {C.EXCERPT_LENGTH}) || '...' AS excerpt FROM (
  SELECT DISTINCT content FROM analyzed WHERE content IS NOT NULL) ORDER BY sha256(content) LIMIT {C.REPORT_SAMPLE_N}""")


# ------------------------------------------------------------------ validation

@register("validate_report")
def q_validate_report(spark, sf):
    """V1 per platform name: unknown names and missing columns are errors (decided from the schema),
    a derived video_id, dates that don't parse (D6) and blank contents are warnings with counts."""
    p = TB.posts(spark, sf).withColumnRenamed("date_text", "published_date")
    missing = [c for c in C.REQUIRED_COMMON if c not in p.columns]
    blank = lambda c: F.col(c).isNull() | T.is_blank(c)
    name, plat = F.lower("platform"), F.col("platform")
    has_id = "video_id" in p.columns
    no_id = F.lit(not has_id) & (name == "youtube_api")          # only plain youtube gets one derived
    errors = F.concat_ws("; ", F.when(~name.isin(*C.VALID_PLATFORMS), F.concat(F.lit("unsupported platform: "), plat)),
                         F.when(name.isin(*C.VALID_PLATFORMS) & (F.lit(bool(missing)) | no_id),
                                F.concat(F.lit("missing columns: "), F.concat_ws(", ", *[F.lit(c) for c in missing], F.when(no_id, F.lit("video_id"))))))
    d = G.ymd_text("published_date")
    ids = S.video_id("url")
    return p.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(d.isNull()).alias("bad_date"),
        F.count_if(blank("content")).alias("blank_content"),
        F.count_if(blank("content") & blank("title")).alias("dropped"),
        F.count_if((name == "youtube") & F.lit(not has_id) & ids.isNotNull()).alias("derived_video_id"),
    ).select("*", errors.alias("errors"), (errors == "").alias("is_valid"))


def _parse_clean_sql(e):
    s = Q.strip_blank(e)
    k = Q.rx_replace(Q.rx_replace(Q.rx_replace(s, "[년월]\\s*", "-"), "일.*$", ""), "[./]", "-")
    return (f"coalesce(CASE WHEN regexp_full_match({s}, '^[0-9]{{8}}$') THEN TRY_CAST(strptime({s}, '%Y%m%d') AS DATE) END, "
            f"{Q.strptime_date(k, '%Y-%m-%d')}, CAST(TRY_CAST({k} AS TIMESTAMP) AS DATE))")


oracle("validate_report", POSTS + f"""SELECT *, CASE WHEN lower(platform) IN ('naver', 'naver_blog', 'naver_blog_api', 'naver_cafe',
    'naver_cafearticle', 'naver_cafearticle_api', 'naver_news', 'naver_community', 'youtube', 'google', 'google_search', 'google_news',
    'buan_gov', 'buan_gov_news', 'buan_gov_notice', 'community', 'local_community', 'tour_community') THEN ''
    WHEN lower(platform) = 'youtube_api' THEN 'missing columns: video_id' ELSE 'unsupported platform: ' || platform END AS errors,
  errors = '' AS is_valid FROM (
  SELECT platform, count(*) AS n_rows, count(*) FILTER (WHERE {_parse_clean_sql('date_text')} IS NULL) AS bad_date,
    count(*) FILTER (WHERE content IS NULL OR {Q.strip_blank('content')} = '') AS blank_content,
    count(*) FILTER (WHERE (content IS NULL OR {Q.strip_blank('content')} = '') AND (title IS NULL OR {Q.strip_blank('title')} = '')) AS dropped,
    count(*) FILTER (WHERE lower(platform) = 'youtube') AS derived_video_id
  FROM posts GROUP BY platform)""")


@register("repaired_rows")
def q_repaired_rows(spark, sf):
    """V1's repairs: dates as D6's text or null, blank contents from the title (rows without either go),
    video ids of plain youtube rows."""
    p = TB.posts(spark, sf)
    blank = lambda c: F.col(c).isNull() | T.is_blank(c)
    x = p.select("doc_id", "platform", F.when(blank("content"), F.when(~blank("title"), F.col("title"))).otherwise(F.col("content")).alias("content"),
                 G.ymd_text("date_text").alias("published_date"), F.when(F.lower("platform") == "youtube", S.video_id("url")).alias("video_id"))
    return x.where("content is not null")


oracle("repaired_rows", POSTS + f"""SELECT * FROM (SELECT doc_id, platform, CASE WHEN content IS NULL OR {Q.strip_blank('content')} = ''
  THEN CASE WHEN title IS NOT NULL AND {Q.strip_blank('title')} <> '' THEN title END ELSE content END AS content,
  strftime({_parse_clean_sql('date_text')}, '%Y%m%d') AS published_date,
  CASE WHEN lower(platform) = 'youtube' THEN {Q.video_id('url')} END AS video_id FROM posts) WHERE content IS NOT NULL""")


@register("validate_dataset")
def q_validate_dataset(spark, sf):
    """V2 per dataset (all posts of a source, and all posts of a source and platform): one platform is
    rolled up or rejected; mixed ones count as youtube if any row is, and are rejected otherwise."""
    p = TB.posts(spark, sf).select("source", "platform")
    sets = p.select(F.explode(F.array(F.col("source"), F.concat_ws("/", "source", "platform"))).alias("dataset"), F.lower("platform").alias("name"))
    g = sets.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.min("name").alias("lo"), F.max("name").alias("hi"),
                                    F.max(F.col("name") == "youtube").alias("video"))
    resolved = F.when(F.col("lo") == F.col("hi"), S.platform_parent("lo")).when(F.col("video"), F.lit("youtube"))
    return g.select("dataset", "n_rows", (F.col("lo") != F.col("hi")).alias("mixed"), resolved.alias("platform"),
                    resolved.isNotNull().alias("is_valid"))


oracle("validate_dataset", POSTS + f"""SELECT dataset, n_rows, n > 1 AS mixed, p AS platform, p IS NOT NULL AS is_valid FROM (
  SELECT dataset, count(*) AS n_rows, count(DISTINCT name) AS n,
    CASE WHEN count(DISTINCT name) = 1 THEN {_parent_sql('min(name)')} WHEN bool_or(name = 'youtube') THEN 'youtube' END AS p
  FROM (SELECT source AS dataset, lower(platform) AS name FROM posts UNION ALL
        SELECT source || '/' || platform, lower(platform) FROM posts) GROUP BY dataset)""")


@register("invalid_rows")
def q_invalid_rows(spark, sf):
    """V3/V4: rows with a non-8-digit date (with its repaired value), blank content or a non-http URL."""
    p = TB.posts(spark, sf)
    bad_date = ~F.col("date_text").rlike("^\\d{8}$")
    blank = T.is_blank("content")
    bad_url = ~F.col("url").rlike("^https?://")
    return p.where(bad_date | blank | bad_url).select(
        "doc_id", bad_date.alias("bad_date"), blank.alias("blank_content"), bad_url.alias("bad_url"),
        D.parse_date_today("date_text").alias("repaired_date"))


oracle("invalid_rows", POSTS + f"""SELECT doc_id, bad_date, blank_content, bad_url, repaired_date FROM (
  SELECT doc_id, NOT regexp_full_match(date_text, '^\\d{{8}}$') AS bad_date, {Q.strip_blank('content')} = '' AS blank_content,
    NOT regexp_matches(url, '^https?://') AS bad_url, {Q.parse_date_today('date_text')} AS repaired_date FROM posts)
WHERE bad_date OR blank_content OR bad_url""")


@register("clean_posts")
def q_clean_posts(spark, sf):
    """V5: parse dates (D5), keep 2000..as_of, nulls -> '', title fallback, drop duplicates on
    (title, content, published_date) keeping the first."""
    p = TB.posts(spark, sf)
    d = D.parse_date_clean("date_text")
    x = p.select("doc_id", "ingest_seq", F.coalesce("title", F.lit("")).alias("title"),
                 F.coalesce(F.nullif(T.strip_blank("content"), F.lit("")), F.col("title"), F.lit("")).alias("content"),
                 D.in_window(d).alias("d"))
    x = x.withColumn("published_date", D.ymd("d"))
    # groups travel as digests, not as texts
    x = x.select("doc_id", "ingest_seq", "published_date", dedup.row_digest(["title", "content", "published_date"]).alias("key"))
    return dedup.keep_first(x, ["key"]).select("doc_id", "published_date")


oracle("clean_posts", POSTS + f"""SELECT arg_min(doc_id, ingest_seq) AS doc_id, published_date FROM (
  SELECT doc_id, ingest_seq, coalesce(title, '') AS title,
         coalesce(nullif({Q.strip_blank('content')}, ''), title, '') AS content, strftime(d, '%Y%m%d') AS published_date
  FROM (SELECT *, {_parse_clean_sql('date_text')} AS d FROM posts) WHERE d BETWEEN DATE '2000-01-01' AND {Q.as_of()})
GROUP BY title, content, published_date""")


@register("filter_ratio")
def q_filter_ratio(spark, sf):
    """V8: share of posts dropped by the post-processing filter, per platform."""
    p = barrier(TB.posts(spark, sf).select("platform", P.postprocess_keep("title", "content").alias("kept")))
    kept = F.col("kept")
    n = F.count(F.lit(1))
    return p.groupBy("platform").agg(n.alias("n_in"), F.count_if(kept).alias("n_kept"),
                                     F.round(F.count_if(~kept) * 100.0 / n, 6).alias("dropped_pct"))


def _full(e1="title", e2="content"):
    return f"concat_ws(' ', coalesce({e1}, ''), coalesce({e2}, ''))"


_KEEP_SQL = f"({Q.contains_any(_full(), C.REQUIRED_KEYWORDS)} AND NOT {Q.contains_any(_full(), C.EXCLUDED_KEYWORDS)})"
oracle("filter_ratio", POSTS + f"""SELECT platform, count(*) AS n_in, count(*) FILTER (WHERE {_KEEP_SQL}) AS n_kept,
  round(count(*) FILTER (WHERE NOT {_KEEP_SQL}) * 100.0 / count(*), 6) AS dropped_pct FROM posts GROUP BY platform""")


@register("quality_metrics")
def q_quality_metrics(spark, sf):
    """V9: per platform, required-field missing rate, optional-field fill rate, URL validity and
    date-format uniformity, in percent, one aggregate."""
    p = TB.posts(spark, sf)
    blank = lambda c: F.col(c).isNull() | T.is_blank(c)

    def pct(c):
        return F.round(F.avg(c.cast("double")) * 100.0, 6)

    return p.groupBy("platform").agg(
        pct(blank("title") | blank("content") | blank("url")).alias("required_missing_pct"),
        pct(F.col("sentiment").isNotNull()).alias("optional_fill_pct"),
        pct(F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))).alias("url_valid_pct"),
        pct(F.coalesce(F.col("date_text").rlike("^\\d{8}$"), F.lit(False))).alias("date_uniform_pct"))


def _blank_sql(c):
    return f"({c} IS NULL OR {Q.strip_blank(c)} = '')"


oracle("quality_metrics", POSTS + f"""SELECT platform,
  round(avg(CAST({_blank_sql('title')} OR {_blank_sql('content')} OR {_blank_sql('url')} AS DOUBLE)) * 100.0, 6) AS required_missing_pct,
  round(avg(CAST(sentiment IS NOT NULL AS DOUBLE)) * 100.0, 6) AS optional_fill_pct,
  round(avg(CAST(coalesce(regexp_matches(url, '^https?://'), false) AS DOUBLE)) * 100.0, 6) AS url_valid_pct,
  round(avg(CAST(coalesce(regexp_full_match(date_text, '^\\d{{8}}$'), false) AS DOUBLE)) * 100.0, 6) AS date_uniform_pct
FROM posts GROUP BY platform""")


# ------------------------------------------------------------------ analysis flows

@register("process_data")
def q_process_data(spark, sf):
    return analysis.process_data(TB.posts(spark, sf))


def _process_sql():
    content = f"coalesce(nullif({Q.strip_blank('content')}, ''), title)"
    return POSTS + f"""SELECT doc_id, platform, title, label AS sentiment_numeric, {Q.label_name('label')} AS sentiment,
  CASE {Q.label_name('label')} WHEN 'positive' THEN 'green' WHEN 'neutral' THEN 'gray' WHEN 'negative' THEN 'red' END AS sentiment_color,
  confidence FROM (
  SELECT doc_id, platform, title, s.label AS label, round(s.confidence, 6) AS confidence FROM (
    SELECT doc_id, platform, title,
      CASE WHEN {Q.eligibility_reason('c')} = 'ok' THEN {Q.rule_score('c')} ELSE {{'label': 1, 'confidence': 0.0::DOUBLE}} END AS s
    FROM (SELECT doc_id, platform, {Q.basic_clean('title')} AS title, {Q.basic_clean(content)} AS c FROM posts)))
WHERE confidence >= {C.MIN_CONFIDENCE}"""


oracle("process_data", _process_sql())


@register("softmax_argmax")
def q_softmax_argmax(spark, sf):
    """M3 on 3-way logits (first three embedding elements)."""
    x = scoring.with_argmax_head(TB.logits(spark, sf), "logits", "h")
    return x.select("vec_id", F.col("h.label").alias("label"), F.round("h.confidence", 6).alias("confidence"))


oracle("softmax_argmax", f"""SELECT vec_id, h.label AS label, round(h.confidence, 6) AS confidence FROM (
  SELECT vec_id, {Q.argmax_head('list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE))')} AS h FROM embeddings)""")
