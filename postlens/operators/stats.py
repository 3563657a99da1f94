"""Result-view aggregates (A1-A17) and ranking.

All aggregates are hash aggregates with map-side partial aggregation (counts, sums, min/max,
``count_if``, ``max_by``); pivots always get their value list so Spark plans them as one
aggregate without a distinct-values job.  Top-k uses ``orderBy().limit()``
(TakeOrderedAndProject: a bounded heap per task) and ``row_number() <= k`` (window group limit:
a bounded partial top-k before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import text as T


def label_counts(df: DataFrame, label: str = "sentiment", by=()) -> DataFrame:
    """counts per label as columns negative/neutral/positive (absent labels 0)"""
    aggs = [F.count_if(F.col(label) == k).alias(name) for k, name in C.LABEL_NAMES.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def label_shares(df: DataFrame, label: str = "sentiment", by=()) -> DataFrame:
    """A5: percent of each label, absent labels 0."""
    n = F.count(F.lit(1))
    aggs = [F.round(F.count_if(F.col(label) == k) * 100.0 / n, 6).alias(f"pct_{name}")
            for k, name in C.LABEL_NAMES.items()]
    return (df.groupBy(*by) if by else df.groupBy()).agg(n.alias("n_rows"), *aggs)


def pivot_labels(df: DataFrame, by: str, label: str = "sentiment") -> DataFrame:
    """``by`` x label count table, missing cells 0."""
    p = df.groupBy(by).pivot(label, list(C.LABEL_NAMES)).count().na.fill(0)
    for k, name in C.LABEL_NAMES.items():
        p = p.withColumnRenamed(str(k), name)
    return p


def word_freq(df: DataFrame, text_col: str, top: int | None = None) -> DataFrame:
    """Lower-cased word tokens of >= 2 characters, counted; with ``top`` only the ``top`` most
    frequent (count desc, word).

    ``explode`` + ``groupBy`` runs a partial count per map task, so very frequent words (the
    skewed keys of any text corpus) are combined before the shuffle.
    """
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"{T.WORD}{{2,}}"), 0)
    words = df.select(F.explode(toks).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.col("n").desc(), F.col("word")).limit(top)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """``row_number() <= k`` per group (Spark adds a partial window group limit before the shuffle)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def period_end(d: Column, unit: Column, first_month: Column) -> Column:
    """A8 bins labelled with the period end; 3M counts months in steps of 3 from the first month
    present."""
    k = F.months_between(F.trunc(d, "MM"), first_month).cast("int")
    q3 = F.last_day(F.add_months(first_month, (F.ceil(k / 3.0) * 3).cast("int")))
    return (F.when(unit == "D", d)
            .when(unit == "W", F.next_day(F.date_sub(d, 1), "SUN"))
            .when(unit == "M", F.last_day(d))
            .when(unit == "3M", q3)
            .otherwise(F.make_date(F.year(d), F.lit(12), F.lit(31))))


def period_unit(span_days: Column) -> Column:
    """Unit from the span of dates in days."""
    out = None
    for limit, unit in C.PERIOD_UNIT_STEPS:
        out = F.when(span_days > limit, F.lit(unit)) if out is None else out.when(span_days > limit, F.lit(unit))
    return out.otherwise(F.lit("D"))


def comment_override(sentiment: Column, negative: Column, neutral: Column, positive: Column) -> Column:
    """The comments' majority label replaces the post label when there are more than
    COMMENT_MIN_COUNT labelled comments, the post has a truthy label (not null, not 0), and the
    majority differs and holds more than COMMENT_MIN_SHARE.  Majority ties: positive, neutral,
    negative (the fixed order of the count table)."""
    total = F.coalesce(negative + neutral + positive, F.lit(0))
    top = F.greatest(positive, neutral, negative)
    major = F.when(positive == top, 2).when(neutral == top, 1).otherwise(0)
    override = (total > C.COMMENT_MIN_COUNT) & sentiment.isNotNull() & (sentiment != 0) \
        & (major != sentiment) & (top > total * C.COMMENT_MIN_SHARE)
    return F.when(F.coalesce(override, F.lit(False)), major).otherwise(sentiment).cast("int")


REPORT_COLUMNS = ["platform", "sentiment", "content"]


def report_input(df: DataFrame, required=tuple(REPORT_COLUMNS)) -> DataFrame:
    """V6: a report's input; absent columns read 'unknown', an empty input is an error."""
    if df.isEmpty():
        raise ValueError("the report's input has no rows")
    return df.withColumns({c: F.lit("unknown") for c in required if c not in df.columns})
