"""Queries of the analysis path and the result view."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.plans import analysis
from postlens.plans import sqlfrag as Q
from postlens.plans.registry import register
from postlens.sources import tables as TB

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ------------------------------------------------------------------ M6 flagship

@register("analyze_dataset")
def q_analyze_dataset(spark, sf):
    return analysis.analyze_dataset(TB.posts(spark, sf)).drop("content")


oracle("analyze_dataset", Q.with_ctes(Q.posts_cte(), Q.analyzed_cte()) +
       "SELECT doc_id, title, platform, published_date, url, sentiment, confidence FROM analyzed")


@register("sentiment_share_by_platform")
def q_share_by_platform(spark, sf):
    return analysis.label_share_by_platform(analysis.analyze_dataset(TB.posts(spark, sf)))


oracle("sentiment_share_by_platform", Q.with_ctes(Q.posts_cte(), Q.analyzed_cte()) + """
SELECT platform, count(*) AS n_posts,
  round(count(*) FILTER (WHERE sentiment = 0) * 100.0 / count(*), 6) AS pct_negative,
  round(count(*) FILTER (WHERE sentiment = 1) * 100.0 / count(*), 6) AS pct_neutral,
  round(count(*) FILTER (WHERE sentiment = 2) * 100.0 / count(*), 6) AS pct_positive
FROM analyzed GROUP BY platform""")
