"""Queries over sources/sinks (S*), pages (T13-T15), ML (M1, M2) and streams (ST*)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import shape as S
from postlens.functions import text as T
from postlens.operators import dedup, pages, scoring, stats
from postlens.operators.rowops import barrier, spread
from postlens.plans import analysis
from postlens.plans import sqlfrag as Q
from postlens.plans.registry import register
from postlens.session import scratch_path
from postlens.sources import catalog as CT
from postlens.sources import files as FS
from postlens.sources import tables as TB
from postlens.streaming import jobs as ST

ORACLE: dict[str, str] = {}
POSTS = Q.with_ctes(Q.posts_cte())
ANALYZED = Q.with_ctes(Q.posts_cte(), Q.analyzed_cte())


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ------------------------------------------------------------------ sources / sinks

@register("scan_posts")
def q_scan_posts(spark, sf):
    """Posts written as JSON partitioned by platform, read back with the fixed schema
    (platform comes back from the directory names)."""
    p = TB.posts(spark, sf).select("doc_id", "ingest_seq", "platform", "title", "content", "url",
                                   "date_text", "keyword", "sentiment", "confidence")
    path = scratch_path(spark, "posts-json")
    FS.write_json(p, path)
    back = FS.read_json(spark, path, FS.POST_FIELDS)
    return back.select("doc_id", "platform", "title", "url", "date_text", "keyword", "sentiment",
                       "confidence", F.length("content").alias("content_len"))


oracle("scan_posts", POSTS + """SELECT doc_id, platform, title, url, date_text, keyword, sentiment, confidence,
  length(content) AS content_len FROM posts""")


@register("sink_roundtrip")
def q_sink_roundtrip(spark, sf):
    """Analysed rows to CSV with header, re-read with a schema, labels decoded."""
    a = analysis.analyze_dataset(TB.posts(spark, sf)).drop("content")
    path = scratch_path(spark, "analysis-csv")
    FS.write_csv(a, path)
    back = FS.read_csv(spark, path, FS.ANALYSIS_CSV)
    return back.select("doc_id", "title", "platform", "published_date", "url",
                       S.label_name("sentiment").alias("sentiment_name"), "confidence")


oracle("sink_roundtrip", ANALYZED + f"""SELECT doc_id, title, platform, published_date, url,
  {Q.label_name('sentiment')} AS sentiment_name, confidence FROM analyzed""")


INPUT_FILE = "posts.json"


@register("run_metadata")
def q_run_metadata(spark, sf):
    """One-row run metadata (item count, label distribution, models, columns, file names, thresholds)
    written as JSON and read back."""
    a = analysis.analyze_dataset(TB.posts(spark, sf))
    n = F.count(F.lit(1))
    meta = a.agg(n.alias("item_count"),
                 *[F.round(F.count_if(F.col("sentiment") == k) * 100.0 / n, 1).alias(f"pct_{v}")
                   for k, v in C.LABEL_NAMES.items()])
    meta = meta.select("*", F.lit(",".join(C.MODEL_SETS["light"])).alias("models"),
                       F.lit(",".join(a.columns)).alias("columns"), F.lit(INPUT_FILE).alias("input_file"),
                       F.lit(INPUT_FILE.replace(".json", "_result.csv")).alias("result_file"),
                       F.lit(C.MIN_CONFIDENCE).alias("min_confidence"),
                       F.lit(C.MAX_TEXT_LENGTH).alias("max_text_length"))
    path = scratch_path(spark, "run-meta")
    meta.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema(meta.schema).json(path)


oracle("run_metadata", ANALYZED + "SELECT count(*) AS item_count, " + ", ".join(
    f"round(count(*) FILTER (WHERE sentiment = {k}) * 100.0 / count(*), 1) AS pct_{v}" for k, v in C.LABEL_NAMES.items())
    + f", {Q.q(','.join(C.MODEL_SETS['light']))} AS models, "
      f"'doc_id,title,content,platform,published_date,url,sentiment,confidence' AS columns, 'posts.json' AS input_file, "
      f"'posts_result.csv' AS result_file, {C.MIN_CONFIDENCE} AS min_confidence, "
      f"{C.MAX_TEXT_LENGTH} AS max_text_length FROM analyzed")

HISTORY_FILE = "youtube.json"


@register("analysis_history")
def q_analysis_history(spark, sf):
    """Two analysis runs in the history table, then the history of one file.  A run that is entered
    again replaces its own entries."""
    a = analysis.analyze_dataset(TB.posts(spark, sf))
    per = scratch_path(spark, "history-entries")
    a.groupBy("platform").agg(F.count(F.lit(1)).alias("item_count")).write.parquet(per)      # analysed once
    counts = spark.read.schema("platform string, item_count long").parquet(per)
    path = scratch_path(spark, "history")
    for run in (1, 2, 2):
        FS.append_history(counts.select(
            F.lit(run).alias("run_no"), F.concat("platform", F.lit(".json")).alias("file_path"),
            F.array(*[F.lit(m) for m in C.MODEL_SETS["light"]]).alias("models"), "item_count"), path, "run_no")
    h = spark.read.parquet(path)
    return h.where(F.col("file_path") == HISTORY_FILE).select(
        "run_no", "file_path", F.array_join("models", ",").alias("models"), "item_count")


oracle("analysis_history", ANALYZED + f"""SELECT run_no, platform || '.json' AS file_path, {Q.q(','.join(C.MODEL_SETS['light']))} AS models,
  count(*) AS item_count FROM analyzed, (VALUES (1), (2)) r(run_no)
WHERE platform || '.json' = '{HISTORY_FILE}' GROUP BY run_no, platform""")

DATASET = "doc_id long, platform string, lang string, title string"
DAY = "20240601_"


def _stamp(last):
    return F.concat(F.lit(DAY), F.lpad((last % 240000).cast("string"), 6, "0"))


def _write_datasets(spark, sf):
    """Posts landed as one directory per (platform, lang), named platform_count_keywords_stamp."""
    p = TB.posts(spark, sf).select("doc_id", "platform", "lang", "title")
    counts = p.groupBy("platform", "lang").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    # the broadcast holds a row for each platform and language
    named = p.join(F.broadcast(counts), ["platform", "lang"]).withColumn(
        "dataset", F.concat_ws("_", "platform", F.col("n").cast("string"), "lang", _stamp(F.col("last"))))
    path = scratch_path(spark, "datasets")
    # few files per directory; a directory that holds much of the data is still split
    named.drop("n", "last").hint("rebalance", F.col("dataset")).write.mode("overwrite").partitionBy("dataset").json(path)
    return path


_LANDED = f"""landed AS (SELECT platform, lang, n, '{DAY}' || lpad(CAST(last % 240000 AS VARCHAR), 6, '0') AS stamp,
  platform || '_' || n || '_' || lang || '_{DAY}' || lpad(CAST(last % 240000 AS VARCHAR), 6, '0') AS dataset
  FROM (SELECT platform, lang, count(*) AS n, max(doc_id) AS last FROM posts GROUP BY ALL))"""


@register("file_catalog")
def q_file_catalog(spark, sf):
    """Datasets landed as directories named platform_count_keywords_stamp; the catalogue
    is built from file metadata and the names are parsed with one anchored regex."""
    path = _write_datasets(spark, sf)
    ft = FS.file_table(spark, path, "json", DATASET)
    named = ft.select(FS.dataset_of(F.col("file_path")).alias("dataset"))
    plat, cnt, kw, stamp = FS.parse_dataset_name(F.col("dataset"))
    return named.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "dataset", plat.alias("platform"), cnt.cast("long").alias("count"), kw.alias("keyword"), "n_rows")


oracle("file_catalog", Q.with_ctes(Q.posts_cte(), _LANDED) + "SELECT dataset, platform, n AS count, lang AS keyword, n AS n_rows FROM landed")


NEWEST = 5


def _datasets(spark, sf):
    """Dataset names with their parts; the stamp's hour comes from the posts' languages and sources."""
    p = TB.table(spark, sf, "documents").select("doc_id", "lang", "source")
    plat = F.element_at(F.array(*[F.lit(x) for x in TB.ADAPTER_PLATFORMS]), (F.col("doc_id") % 7 + 1).cast("int"))
    g = p.groupBy(plat.alias("platform"), "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    return g.select(F.concat_ws("_", "platform", F.col("n").cast("string"), F.concat_ws("-", "lang", "source"),
                                _stamp(F.col("last"))).alias("dataset"))


_DATASETS = f"""ds AS (SELECT platform, n, lang || '-' || source AS kw, '20240601_' || lpad(CAST(last % 240000 AS VARCHAR), 6, '0') AS stamp,
  platform || '_' || n || '_' || lang || '-' || source || '_20240601_' || lpad(CAST(last % 240000 AS VARCHAR), 6, '0') AS dataset FROM (
  SELECT ({Q.arr(TB.ADAPTER_PLATFORMS)})[doc_id % 7 + 1] AS platform, lang, source, count(*) AS n, max(doc_id) AS last
  FROM documents GROUP BY ALL))"""


def _catalog(datasets):
    plat, cnt, kw, stamp = FS.parse_dataset_name(F.col("dataset"))
    return datasets.select("dataset", plat.alias("platform"), cnt.cast("long").alias("count"), kw.alias("keywords"), stamp.alias("stamp"))


@register("recent_files")
def q_recent_files(spark, sf):
    """The newest NEWEST datasets of each platform, then the newest NEWEST of these."""
    c = _catalog(_datasets(spark, sf))
    newest = [F.col("stamp").desc(), F.col("dataset")]
    return stats.top_per_group(c, "platform", newest, NEWEST).orderBy(*newest).limit(NEWEST)


oracle("recent_files", f"""WITH {_DATASETS} SELECT dataset, platform, n AS count, kw AS keywords, stamp FROM (
  SELECT *, row_number() OVER (PARTITION BY platform ORDER BY stamp DESC, dataset) AS rn FROM ds) WHERE rn <= {NEWEST}
ORDER BY stamp DESC, dataset LIMIT {NEWEST}""")


@register("dataset_catalog")
def q_dataset_catalog(spark, sf):
    """S6 + J6: datasets with the newest analysis of each, if any.  Runs are recorded with their input
    file and time; only those whose result has rows count."""
    c = _catalog(_datasets(spark, sf)).withColumn("file", F.concat("dataset", F.lit(".json")))
    # the run log: sources 0-9 were analysed, even ones a second time
    src = F.regexp_extract("keywords", "src(\\d+)$", 1).cast("int")
    runs = c.where(src < 10).select(F.col("file").alias("input_file"), F.explode(F.when(src % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("run"),
                                    F.col("count").alias("item_count"))
    last = runs.where("item_count > 1").groupBy("input_file").agg(F.max("run").alias("last_run"))
    return (c.join(last, c["file"] == last["input_file"], "left")
            .select("dataset", "platform", "count", "keywords", "stamp", F.coalesce("last_run", F.lit(0)).alias("last_run"),
                    F.col("last_run").isNotNull().alias("is_analyzed")))


oracle("dataset_catalog", f"""WITH {_DATASETS}, k AS (SELECT *, TRY_CAST(regexp_extract(kw, 'src(\\d+)$', 1) AS INTEGER) AS src FROM ds)
SELECT dataset, platform, n AS count, kw AS keywords, stamp,
  CASE WHEN src < 10 AND n > 1 THEN CASE WHEN src % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS last_run,
  coalesce(src < 10 AND n > 1, false) AS is_analyzed FROM k""")


@register("latest_dataset")
def q_latest_dataset(spark, sf):
    """The rows of each platform's newest dataset, by the stamp in its name."""
    path = _write_datasets(spark, sf)
    names = CT.folders(CT.list_files(spark, path, "*.json"), "dataset").select("dataset")       # metadata only
    plat, _, _, stamp = FS.parse_dataset_name(F.col("dataset"))
    rows = FS.read_newest(spark, path, "json", DATASET, names, "dataset", plat, stamp)
    return rows.select("platform", "dataset", "doc_id", "title")


oracle("latest_dataset", Q.with_ctes(Q.posts_cte(), _LANDED) + """SELECT p.platform, n.dataset, p.doc_id, p.title FROM posts p JOIN (
  SELECT platform, lang, dataset, row_number() OVER (PARTITION BY platform ORDER BY stamp DESC, dataset DESC) AS rn FROM landed) n
ON p.platform = n.platform AND p.lang = n.lang WHERE n.rn = 1""")

RUNS = ["20240601_010000", "20240602_010000"]           # the first run knew the posts seen before


@register("latest_processed")
def q_latest_processed(spark, sf):
    """Processed results land as CSV named prefix_processed_stamp; the newest name of each platform
    prefix is loaded."""
    p = TB.posts(spark, sf)
    seen = F.col("base_date") < F.lit(TB.SEEN_BEFORE).cast("date")
    stamps = F.when(seen, F.array(*[F.lit(r) for r in RUNS])).otherwise(F.array(F.lit(RUNS[1])))
    x = p.select("doc_id", "platform", "date_text", F.explode(stamps).alias("stamp"))
    prefix = F.substring_index("platform", "_", 1)
    path = scratch_path(spark, "processed")
    (x.withColumn("dataset", F.concat(prefix, F.lit("_processed_"), F.col("stamp"))).drop("stamp")
     .hint("rebalance", F.col("dataset")).write.mode("overwrite").option("header", True).option("nullValue", FS.NULL_MARK)
     .option("emptyValue", '""').partitionBy("dataset").csv(path))
    schema = "doc_id long, platform string, date_text string"
    names = CT.folders(CT.list_files(spark, path, "*.csv"), "dataset").select("dataset")
    return FS.read_newest(spark, path, "csv", schema, names, "dataset",
                          F.substring_index("dataset", "_processed_", 1), F.col("dataset"),
                          {"header": "true", "nullValue": FS.NULL_MARK, "emptyValue": ""})


oracle("latest_processed", POSTS + f"""SELECT doc_id, platform, date_text,
  split_part(platform, '_', 1) || '_processed_{RUNS[1]}' AS dataset FROM posts""")


@register("observed_run")
def q_observed_run(spark, sf):
    """X-UDF3: a run that reports its progress: rows read, scored and of each label, counted by
    observations while the result is written, without another pass."""
    read, done = Observation("read"), Observation("scored")
    p = TB.posts(spark, sf).observe(read, F.count(F.lit(1)).alias("n"))
    a = analysis.analyze_dataset(p).select("doc_id", "sentiment", "confidence").observe(
        done, F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("sentiment") == k).alias(v) for k, v in C.LABEL_NAMES.items()])
    path = scratch_path(spark, "observed")
    a.write.mode("overwrite").parquet(path)
    r, s = read.get, done.get
    names = list(C.LABEL_NAMES.values())
    return spark.createDataFrame([(r["n"], s["n"], *[s[v] for v in names])],
                                 "rows_read long, rows_scored long, " + ", ".join(f"{v} long" for v in names))


oracle("observed_run", ANALYZED + "SELECT (SELECT count(*) FROM posts) AS rows_read, count(*) AS rows_scored, " + ", ".join(
    f"count(*) FILTER (WHERE sentiment = {k}) AS {v}" for k, v in C.LABEL_NAMES.items()) + " FROM analyzed")


# ------------------------------------------------------------------ pages

@register("page_main_text")
def q_page_main_text(spark, sf):
    pg = spread(TB.pages(spark, sf), "page_id")
    x = pg.select("page_id", pages.article_text(F.col("html")).alias("text"))
    n = F.length("text") - F.length(F.regexp_replace("text", "[A-Za-z]", ""))
    return x.select("page_id", "text", (n >= 50).alias("accepted"))


def _article_sql():
    inner = f"regexp_extract(html, {Q.q(pages.ARTICLE_RE)}, 1)"
    inner = Q.rx_replace(inner, pages.SCRIPT_RE, " ")
    inner = Q.rx_replace(inner, T.TAG_RE, " ")
    for ent, rep in C.HTML_ENTITIES:
        inner = f"replace({inner}, {Q.q(ent)}, {Q.q(rep)})"
    return Q.strip_blank(Q.collapse_blank(inner))


oracle("page_main_text", f"""SELECT page_id, text, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) >= 50 AS accepted
FROM (SELECT page_id, {_article_sql()} AS text FROM pages)""")


@register("page_title_links")
def q_page_title_links(spark, sf):
    pg = spread(TB.pages(spark, sf), "page_id")
    x = barrier(pg.select("page_id", pages.page_title(F.col("html")).alias("title"), pages.page_links(F.col("html")).alias("links")))
    return x.select("page_id", "title", F.size("links").alias("n_links"), F.array_join("links", "|").alias("links"))


def _title_sql():
    t = f"regexp_extract(html, {Q.q(pages.TITLE_RE)}, 1)"
    for ent, rep in C.HTML_ENTITIES:
        t = f"replace({t}, {Q.q(ent)}, {Q.q(rep)})"
    return Q.strip_blank(Q.collapse_blank(t))


oracle("page_title_links", f"""SELECT page_id, {_title_sql()} AS title,
  len(regexp_extract_all(html, {Q.q(pages.ANY_HREF_RE)}, 1)) AS n_links,
  array_to_string(list_transform(regexp_extract_all(html, {Q.q(pages.ANY_HREF_RE)}, 1),
    lambda x: CASE WHEN x[1] IN ('"', '''') THEN x[2:length(x) - 1] ELSE x END), '|') AS links FROM pages""")


@register("page_main_text_parsed")
def q_page_main_text_parsed(spark, sf):
    """The selectors of the page's site class in turn, then the body; the first text with enough
    letters is taken."""
    pg = spread(TB.pages(spark, sf), "page_id")
    return pages.parsed_main_text(pg.withColumn("site_class", S.url_site_class("url")))


def _page_text_sql(inner):
    t = Q.rx_replace(inner, pages.SCRIPT_RE, " ")
    t = Q.rx_replace(t, "(?s)<!--.*?-->", " ")
    t = Q.rx_replace(t, T.TAG_RE, " ")
    for ent, rep in [("&copy;", "©"), ("&middot;", "·")] + C.HTML_ENTITIES:
        t = f"replace({t}, {Q.q(ent)}, {Q.q(rep)})"
    return Q.strip_blank(Q.collapse_blank(t))


def _letters_sql(e):
    return f"length({e}) - length(regexp_replace({e}, '[A-Za-z]', '', 'g')) >= 50"


oracle("page_main_text_parsed", f"""SELECT page_id, 'general' AS site_class,
  CASE WHEN {_letters_sql('art')} THEN 'article' WHEN {_letters_sql('body')} THEN 'body' END AS selector,
  CASE WHEN {_letters_sql('art')} THEN art WHEN {_letters_sql('body')} THEN body END AS text
FROM (SELECT page_id, {_page_text_sql(f"regexp_extract(html, {Q.q(pages.ARTICLE_RE)}, 1)")} AS art,
        {_page_text_sql("regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1)")} AS body FROM pages)""")


def _board_pages(spark, sf):
    """Result pages of a board: at most ten posts each, ids of one block of 70; every third item leaves
    its end tag out, every fifth names no author, undated posts have no date element."""
    p = TB.posts(spark, sf).where(F.col("platform") == "dcinside")
    esc = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    k = F.col("doc_id")
    li = F.concat(F.lit('<li><a class="sch_tit" href="'), "url", F.lit('"><b>'), esc, F.lit("</b></a>"),
                  F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('<span class="user_nick x">'), "source", F.lit("</span>"))),
                  F.when(F.col("date_text") == "", F.lit("")).otherwise(F.concat(F.lit("<span class='date'>"), "date_text", F.lit("</span>"))),
                  F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("</li>")))
    g = p.select(F.expr("doc_id div 70").alias("page_id"), F.struct("doc_id", li.alias("li")).alias("i")) \
        .groupBy("page_id").agg(F.array_sort(F.collect_list("i")).alias("items"))
    return g.select("page_id", F.concat(F.lit('<html><body><ul class="menu"><li><a href="/">x</a></li></ul><ul class="sch_result_list">'),
                                        F.array_join(F.transform("items", lambda i: i["li"]), "\n"),
                                        F.lit("</ul></body></html>")).alias("html"))


@register("page_listing")
def q_page_listing(spark, sf):
    """Title, link, author and date of each result on a board's pages."""
    rows = pages.listing(_board_pages(spark, sf), pages.BOARD_RESULTS)
    return rows.drop("item_no")


oracle("page_listing", POSTS + f"""SELECT doc_id // 70 AS page_id, t AS title, url,
  CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE source END AS author, CASE WHEN date_text <> '' THEN date_text END AS published_date
FROM (SELECT *, {Q.strip_blank(Q.collapse_blank('title'))} AS t FROM posts WHERE platform = 'dcinside') WHERE t <> ''""")


@register("page_items")
def q_page_items(spark, sf):
    return pages.page_items(spread(TB.pages(spark, sf), "page_id"))


def _item_sql(tag, part):
    """an item of the test pages, whose paragraphs and list items hold no further ones"""
    text = Q.rx_replace(part, T.TAG_RE, "")
    href = f"regexp_extract({part}, {Q.q(pages.HREF_RE)}, 1)"
    for ent, rep in C.HTML_ENTITIES:
        text, href = (f"replace({e}, {Q.q(ent)}, {Q.q(rep)})" for e in (text, href))
    return f"{{'tag': '{tag}', 'text': {Q.strip_blank(Q.collapse_blank(text))}, 'href': {href}}}"


oracle("page_items", f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS item_no, items[i].tag AS tag, items[i].text AS text, items[i].href AS href
FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM (
  SELECT page_id, list_filter(list_concat(
    list_transform(regexp_extract_all(html, '(?s)<li>.*?</li>'), lambda x: {_item_sql('li', 'x')}),
    list_transform(string_split(regexp_extract(html, {Q.q(pages.ARTICLE_RE)}, 1), '<p>')[2:],
                   lambda x: {_item_sql('p', "split_part(x, '</p>', 1)")})), lambda x: x.text <> '') AS items FROM pages))""")


# ------------------------------------------------------------------ ML

@register("batch_score")
def q_batch_score(spark, sf):
    """M2: plug-in scorer (Arrow batches, one scorer per task) on cleaned text, F6-gated."""
    x = T.with_preprocessed(TB.posts(spark, sf).select("doc_id", "content"), "content", "text")
    return scoring.batch_score(x, "text").withColumn("confidence", F.round("confidence", 6))


oracle("batch_score", POSTS + f"""SELECT doc_id, s.label AS sentiment, round(s.confidence, 6) AS confidence FROM (
  SELECT doc_id, CASE WHEN {Q.eligibility_reason('c')} = 'ok' THEN {Q.plain_rule_score('c')} ELSE {{'label': 1, 'confidence': 0.0::DOUBLE}} END AS s
  FROM (SELECT doc_id, {Q.basic_clean('content')} AS c FROM posts))""")


@register("nb_train_predict")
def q_nb(spark, sf):
    """M1: multinomial naive Bayes on regex tokens; trained on labelled documents (quality),
    applied to all documents."""
    docs = spread(TB.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    lab = TB.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    train = docs.join(lab, "doc_id")
    _, pred = scoring.naive_bayes(train, docs)
    return pred


_WORDS = f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD}+')) AS word FROM documents"
oracle("nb_train_predict", f"""WITH w AS ({_WORDS}), t AS (SELECT w.word, l.quality AS y FROM w JOIN labels l USING (doc_id)),
c AS (SELECT word, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM t GROUP BY word),
s AS (SELECT sum(n0) AS s0, sum(n1) AS s1, count(*) AS v FROM c),
p AS (SELECT ln(greatest(count(*) FILTER (WHERE quality = 1), 0.5)) - ln(greatest(count(*) FILTER (WHERE quality = 0), 0.5)) AS prior
      FROM labels JOIN documents USING (doc_id)),
o AS (SELECT w.doc_id, sum(ln(n1 + 1.0::DOUBLE) - ln(n0 + 1.0::DOUBLE) - ln((s1 + v)::DOUBLE) + ln((s0 + v)::DOUBLE)) AS odds
      FROM w JOIN c USING (word), s GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(o.odds, 0) + p.prior > 0 AS INTEGER) AS prediction FROM documents d LEFT JOIN o USING (doc_id), p""")


# ------------------------------------------------------------------ streams

def _docs_glob(sf):
    return f"{sf.rstrip('/')}/documents.parquet*"


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    """ST2: landed document files streamed (availableNow) into a Parquet sink with the platform
    rule applied; the result is read from the sink."""
    s = ST.file_stream(spark, _docs_glob(sf), DOC_SCHEMA)
    plat = F.element_at(F.array(*[F.lit(p) for p in TB.ADAPTER_PLATFORMS]), (F.col("doc_id") % 7 + 1).cast("int"))
    out = ST.run_available_now(s.select("doc_id", plat.alias("platform"), "lang"), "ingest")
    return spark.read.parquet(out).groupBy("platform", "lang").agg(F.count(F.lit(1)).alias("n_posts"))


oracle("stream_ingest", POSTS + "SELECT platform, lang, count(*) AS n_posts FROM posts GROUP BY ALL")


@register("stream_dedup")
def q_stream_dedup(spark, sf):
    """ST1: streaming de-duplication of repeated texts within a 30-day watermark."""
    s = ST.file_stream(spark, _docs_glob(sf), DOC_SCHEMA)
    ev = s.select("doc_id", F.sha2("text", 256).alias("key"),
                  F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 86400).alias("event_time"))
    out = ST.run_available_now(ST.dedup_within_watermark(ev, "key", "event_time", "30 days"), "dedup")
    return spark.read.parquet(out).select("key")


oracle("stream_dedup", "SELECT DISTINCT sha256(text) AS key FROM documents")


@register("stream_daily_counts")
def q_stream_daily(spark, sf):
    """ST3: label counts per day with a watermark; update mode into a foreachBatch sink, final
    state = latest version of each (day, label)."""
    e = ST.file_stream(spark, f"{sf.rstrip('/')}/events.parquet*",
                       "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    lab = F.when(F.col("event_type").isin("purchase", "signup"), 2) \
        .when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type") == "error", 0)
    # the wall-clock (zone-less) event time is read as UTC, so day windows are calendar days
    # whatever the session time zone is
    tz = spark.conf.get("spark.sql.session.timeZone")
    x = e.select(F.to_utc_timestamp(F.col("ts").cast("timestamp"), tz).alias("ts"),
                 lab.cast("int").alias("label"))
    agg = ST.windowed_counts(x, "ts", "label").select(F.col("w.start").alias("start"), "label", "n")
    out = ST.run_available_now(agg, "daily", output_mode="update", foreach_batch=ST.append_batches)
    r = spark.read.parquet(out)
    last = dedup.keep_last(r.select("start", "label", "n", "batch_id"), ["start", "label"], order="batch_id")
    return last.select(F.date_format(F.from_utc_timestamp("start", tz), "yyyy-MM-dd").alias("day"), "label", "n")


oracle("stream_daily_counts", """SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(CASE WHEN event_type IN ('purchase','signup') THEN 2
  WHEN event_type IN ('view','click') THEN 1 WHEN event_type = 'error' THEN 0 END AS INTEGER) AS label, count(*) AS n
FROM events GROUP BY ALL""")

