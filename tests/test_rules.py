import pytest
from pyspark.sql import functions as F

from postlens.functions import predicates as P
from postlens.functions import shape as S
from postlens.operators import dedup, scoring, stats
from tests.conftest import one


def test_strict_keywords(spark):
    # C6
    spec = [("r", "AND"), ("a", "AND"), ("b", "OR"), ("c", "OR")]
    f = lambda s, sp=spec: one(spark, P.keyword_match_strict(F.col("s"), sp), s)
    assert f("r a c") is True
    assert f("r a") is False
    assert f("a b") is False
    assert f("r", [("r", "AND")]) is True
    assert f("", [("r", "AND")]) is False


def test_loose_keywords(spark):
    # C7
    f = lambda s, sp: one(spark, P.keyword_match_loose(F.col("s"), sp), s)
    assert f("a", [("r", "AND"), ("a", "AND")]) is True
    assert f("r", [("r", "AND"), ("b", "OR")]) is False
    assert f("zzz", [("b", "OR")]) is True


def test_vote_rules(spark):
    # C9
    schema = "v array<struct<model_ord:int,label:int,confidence:double>>"
    rows = [([(0, 2, 0.5), (1, 2, 0.7), (2, 0, 0.9)],),
            ([(0, 2, 0.6), (1, 0, 0.8)],),
            ([(0, 1, 0.5), (1, 2, 0.5)],),
            ([],)]
    out = spark.createDataFrame(rows, schema).select(scoring.vote_array("v").alias("r")).collect()
    assert (out[0]["r"]["label"], round(out[0]["r"]["confidence"], 6)) == (2, 0.6)
    assert (out[1]["r"]["label"], out[1]["r"]["confidence"]) == (0, 0.8)
    assert out[2]["r"]["label"] == 1  # equal counts and means -> the earliest model's label
    assert (out[3]["r"]["label"], out[3]["r"]["confidence"]) == (1, 0.0)


def test_vote_long_table_matches_array_form(spark):
    rows = [(1, "m0", 0, 2, 0.6), (1, "m1", 1, 0, 0.8), (2, "m0", 0, 1, 0.5), (2, "m1", 1, 2, 0.5),
            (3, "m0", 0, 2, 0.5), (3, "m1", 1, 2, 0.7), (3, "m2", 2, 0, 0.9)]
    v = spark.createDataFrame(rows, "doc_id long, model string, model_ord int, label int, confidence double")
    got = {r["doc_id"]: (r["sentiment"], round(r["confidence"], 6)) for r in scoring.ensemble_vote(v).collect()}
    assert got == {1: (0, 0.8), 2: (1, 0.5), 3: (2, 0.6)}


def test_comment_override(spark):
    # (post label, negative, neutral, positive) -> overall
    cases = [(2, 5, 1, 1, 0), (2, 3, 1, 1, 2), (2, 6, 2, 2, 2), (0, 7, 0, 0, 0), (None, 9, 0, 0, None)]
    df = spark.createDataFrame([c[:4] for c in cases], "s int, n long, u long, p long")
    out = df.select(stats.comment_override(F.col("s"), F.col("n"), F.col("u"), F.col("p")).alias("o")).collect()
    assert [r["o"] for r in out] == [c[4] for c in cases]


def test_eligibility(spark):
    # C11
    f = lambda s: one(spark, P.sentiment_eligibility(F.col("s")), s)
    assert f("x" * 29)["valid"] is False
    assert f("this text is sponsored content of some length")["reason"] == "excluded_keyword"
    assert f("y" * 30)["reason"] == "too_few_words"
    assert f("a reasonably long text with several words")["valid"] is True


def test_video_id(spark):
    # C12
    f = lambda s: one(spark, S.video_id(F.col("s")), s)
    assert f("https://youtu.be/abc?t=1") == "abc"
    assert f("https://www.youtube.com/embed/q") == "q"
    assert f("https://www.youtube.com/watch?a=1&v=z") == "z"
    assert f("https://example.com/x").startswith("video_")
    assert f("") == ""


def test_last_wins(spark):
    # C13
    df = spark.createDataFrame([("u", 1, "old"), ("u", 5, "new"), ("w", 2, "only")],
                               "url string, ingest_seq long, v string")
    got = {r["url"]: (r["v"], r["first_seq"]) for r in dedup.keep_last(df, ["url"]).collect()}
    assert got == {"u": ("new", 1), "w": ("only", 2)}


def test_first_wins_and_idempotent(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("j", 2, "b")], "k string, ingest_seq long, v string")
    once = dedup.keep_first(df, ["k"])
    assert {r["k"]: r["v"] for r in once.collect()} == {"k": "a", "j": "b"}
    assert sorted(dedup.keep_first(once, ["k"]).collect()) == sorted(once.collect())


def test_period_unit(spark):
    # C14
    f = lambda n: one(spark, stats.period_unit(F.col("s")), n, "s int")
    assert [f(n) for n in (30, 31, 181, 1826, 3651)] == ["D", "W", "M", "3M", "Y"]


def test_snippet(spark):
    # C15
    f = lambda s: one(spark, S.kwic(F.col("s"), ["key"]), s)
    assert f("key then some text") == "key then some text"
    long = "x" * 60 + "key" + "y" * 60
    assert f(long) == "..." + "x" * 50 + "key" + "y" * 50 + "..."
    assert f("nothing") is None


def test_label_bucket(spark):
    # C16
    f = lambda s: one(spark, S.label_bucket(F.col("s")), s)
    assert f(None) == "unknown"
    assert f("0") == "negative"
    assert f("negative") == "negative"
    assert f("7") == "unknown"


def test_softmax_head(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0],), ([2.0, 2.0, 0.0],)], "lg array<double>")
    out = scoring.with_argmax_head(df, "lg", "h").collect()
    assert out[0]["h"]["label"] == 2 and abs(out[0]["h"]["confidence"] - 0.5761168847658291) < 1e-12
    assert out[1]["h"]["label"] == 0  # first on ties


def test_platform_roll_up(spark):
    f = lambda s: one(spark, S.platform_parent(F.col("s")), s)
    assert [f(x) for x in ("naver_blog_api", "naver_other", "youtube_api", "google_news", "buan_gov", "buan_gov_notice")] \
        == ["naver", "naver", "youtube", "google", "buan_gov", "buan_gov"]
    assert [f(x) for x in ("community", "local_community", "tour_community", "dcinside", "fmkorea", "x")] \
        == ["community"] * 3 + [None] * 3


def test_one_failing_text_changes_one_row(spark):
    class OneBadText:
        name = "fragile"

        def score(self, texts):
            import pandas as pd
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return pd.DataFrame({"label": [2] * len(texts), "confidence": [0.9] * len(texts)})

    class OneByOne:
        name = "single"

        def analyze_text(self, text):
            if "boom" in text:
                raise ValueError("boom")
            return 0, 0.8

    rows = [(k, f"a text that is long enough to be scored, number {k}" + " boom" * (k == 3)) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for scorer, good in ((OneBadText, (2, 0.9)), (OneByOne, (0, 0.8))):
        failed = spark.sparkContext.accumulator(0)
        got = {r["doc_id"]: (r["sentiment"], r["confidence"]) for r in scoring.batch_score(df, "text", scorer, failures=failed).collect()}
        assert got == {k: (1, 0.0) if k == 3 else good for k in range(6)}
        assert failed.value == 1


def test_the_end_of_a_long_text_counts(spark):
    from postlens.plans import analysis
    text = "filler " * 20000 + "zebra " + "good " * 9000
    df = spark.createDataFrame([(1, "t", "google", "20240101", "u", text)],
                               "doc_id long, title string, platform string, date_text string, url string, content string")
    a = analysis.analyze_dataset(df)
    assert a.first()["sentiment"] == 2
    assert stats.word_freq(a, "content").where("word = 'zebra'").count() == 1


def test_unclosed_items(spark):
    from postlens.operators import pages
    html = "<article><p>one<p>two<br>more<p>three</article><ul><li><a href='/x'>x</a><li>y</ul><p>outside</p>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<article><p>open")], "page_id long, html string")
    got = [(r["page_id"], r["item_no"], r["tag"], r["text"], r["href"]) for r in pages.page_items(df).collect()]
    assert sorted(got) == [(1, 0, "p", "one", ""), (1, 1, "p", "twomore", ""), (1, 2, "p", "three", ""), (1, 3, "li", "x", "/x"),
                           (1, 4, "li", "y", ""), (3, 0, "p", "open", "")]


def test_dotted_path(spark):
    f = lambda p: one(spark, S.json_field(F.col("s"), p), '{"a": {"b": {"c": 5}}}')
    assert [f("a.b.c"), f("a.x.c"), f("z")] == ["5", "", ""]


def test_first_rows_keeps_whole_rows_and_nulls_apart(spark):
    from postlens.operators import dedup
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "a", None, "y"), (3, "a", "", "z"), (4, None, None, "w"), (5, "a", "", "v")],
                               "ingest_seq long, title string, content string, extra string")
    got = sorted(tuple(r) for r in dedup.first_rows(df, ["title", "content"]).collect())
    assert [(g[0], g[3]) for g in got] == [(1, "x"), (3, "z"), (4, "w")]
    assert dedup.first_rows(df.limit(0), ["title"]).collect() == []


def test_report_input_fills_columns_and_rejects_empty(spark):
    from postlens.operators import stats
    df = spark.createDataFrame([("naver",)], "platform string")
    assert stats.report_input(df).first().asDict() == {"platform": "naver", "sentiment": "unknown", "content": "unknown"}
    with pytest.raises(ValueError):
        stats.report_input(df.limit(0))


def test_votes_of_blank_text_and_single_member(spark):
    df = spark.createDataFrame([(1, "und und good"), (2, " "), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(v["model"], v["label"]) for v in r["votes"]] for r in scoring.with_votes(df, "text", ["kobert"]).collect()}
    assert got == {1: [("kobert", 2)], 2: [], 3: []}


def test_score_or_null(spark):
    df = spark.createDataFrame([(1, "good best"), (2, " "), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] and r["score"]["label"] for r in scoring.score_or_null(df, "text").collect()}
    assert got == {1: 2, 2: None, 3: None}
