"""Dates by grammar: layouts written by strftime come back, non-dates don't, and one regex does it."""

import datetime as dt
import email.utils
import random

import pytest
from pyspark.sql import functions as F

from postlens.functions import dategrammar as G
from postlens.functions import dates as D

LAYOUTS = ["%Y%m%d", "%Y-%m-%d", "%Y.%m.%d", "%Y/%m/%d", "%Y. %m. %d.", "%Y년%m월%d일", "%Y년 %m월 %d일", "%d %B %Y", "%d-%b-%Y", "%B %d, %Y",
           "%b %d %Y", "%b. %d, %Y", "%Y %b %d", "%Y-%b-%d", "%A, %d %B %Y", "%a, %d %b %Y %H:%M:%S +0900", "%a, %d %b %Y %H:%M GMT", "%G-W%V-%u",
           "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f+05:30", "%Y-%m-%d %I:%M %p", "%Y%m%dT%H:%M:%S", "%d %b, %Y"]


def read(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, s string")
    return {r.k: r.r for r in df.select("k", G.parse("s").alias("r")).collect()}


def test_layouts_come_back(spark):
    r = random.Random(3)
    cases = []
    for layout in LAYOUTS:
        for _ in range(25):
            t = dt.datetime(1990, 1, 1) + dt.timedelta(seconds=r.randrange(45 * 366 * 86400))
            cases.append((t.strftime(layout), t, layout))
    got = read(spark, [c[0] for c in cases])
    for k, (text, t, layout) in enumerate(cases):
        assert got[k]["date"] == t.date(), text
        if "%H" in layout or "%I" in layout:
            seconds = t.hour * 3600 + t.minute * 60 + (t.second if "%S" in layout else 0)
            assert got[k]["seconds"] == seconds, text
        else:
            assert got[k]["seconds"] is None


def test_mail_dates(spark):
    r = random.Random(4)
    moments = [dt.datetime(2000, 1, 1, tzinfo=dt.timezone(dt.timedelta(minutes=r.choice([0, 540, -300, 330])))) + dt.timedelta(seconds=r.randrange(10**9)) for _ in range(60)]
    got = read(spark, [email.utils.format_datetime(m) for m in moments])
    for k, m in enumerate(moments):
        x = got[k]
        assert (x["date"], x["seconds"]) == (m.date(), m.hour * 3600 + m.minute * 60 + m.second)
        assert x["offset"] == m.utcoffset().total_seconds() // 60


@pytest.mark.parametrize(("text", "want"), [
    ("05/13/2025", dt.date(2025, 5, 13)), ("13/05/2025", dt.date(2025, 5, 13)), ("5.6.2024", dt.date(2024, 5, 6)), (" 2024-2-9 ", dt.date(2024, 2, 9)),
    ("2024-02-30", None), ("20240230", None), ("2023-W53-1", None), ("2020-W53-5", dt.date(2021, 1, 1)), ("2020-W01", dt.date(2019, 12, 30)),
    ("Tue, 13 May 2025 25:00:00 +0900", None), ("13 Mayo 2025", None), ("not a date", None), ("", None), (None, None), ("2024", None), ("12345678901", None),
    ("2024-01-02 and more", None), ("Sept 5, 2024", dt.date(2024, 9, 5)), ("TUE, 13 MAY 2025 10:00:00 EST", dt.date(2025, 5, 13)),
    ("2024-01-02 12:30 am", dt.date(2024, 1, 2)), ("2024-01-02 13:30 pm", None), ("2024-01-02T23:59:60Z", dt.date(2024, 1, 2))])
def test_single_cases(spark, text, want):
    assert read(spark, [text])[0]["date"] == want


def test_one_regular_expression(spark, capsys):
    spark.createDataFrame([("x",)], "s string").select(G.ymd_text("s").alias("d")).explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("regexp") == 1 and "RLIKE" not in plan


def test_news_dates_in_the_rules(spark):
    df = spark.createDataFrame([("Tue, 13 May 2025 10:00:00 +0900",)], "s string")
    got = df.select(D.parse_date_relative("s").alias("relative"), D.parse_date_clean("s").alias("clean"), G.ymd_text("s").alias("text"),
                    G.rfc822(F.lit("2025-05-13")).alias("other")).first()
    assert tuple(got) == ("20250513", dt.date(2025, 5, 13), "20250513", None)
