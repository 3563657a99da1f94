"""End-to-end analysis flows (M6, M7) as one DataFrame chain each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import predicates as P
from postlens.functions import shape as S
from postlens.functions import text as T
from postlens.operators import scoring
from postlens.operators.rowops import barrier, where_computed


def analyze_dataset(posts: DataFrame) -> DataFrame:
    """M6: drop blank content -> clean (T1, T2) -> drop blank -> score -> one row per post.

    Pure narrow transformations: no shuffle; the scan reads only the projected columns.
    """
    kept = (posts.where(P.not_blank("content"))
            .select("doc_id", "title", "platform", "date_text", "url", "content"))
    cleaned = where_computed(T.with_preprocessed(kept, "content", "content"),
                             lambda r: F.length(r["content"]) > 0)
    scored = scoring.with_rule_score(cleaned, "content", "_s")
    return barrier(scored.select("doc_id", "title", "content", "platform",
                                 F.col("date_text").alias("published_date"), "url",
                                 F.col("_s.label").alias("sentiment"),
                                 F.round(F.col("_s.confidence"), 6).alias("confidence")))


def model_votes(posts: DataFrame, models=C.MODEL_NAMES, keep=("doc_id",)) -> DataFrame:
    """Long vote table (``keep``, model, model_ord, label, confidence) of the scorers on cleaned content."""
    x = T.with_preprocessed(posts.select(*keep, "content"), "content", "text")
    # barrier: a generator over the vote expression itself would be planned with copies of it
    return barrier(scoring.with_votes(x, "text", models).select(*keep, "votes")).select(*keep, F.inline("votes"))


def row_votes(posts: DataFrame, models=C.MODEL_NAMES) -> DataFrame:
    """A12 on each post's vote array, without a shuffle: doc_id, sentiment, confidence, votes (of the
    winner).  Posts that no member votes on drop out."""
    x = T.with_preprocessed(posts.select("doc_id", "content"), "content", "text")
    x = barrier(scoring.with_votes(x, "text", models).select("doc_id", "votes"))
    x = where_computed(x.withColumn("_v", scoring.vote_array("votes")).drop("votes"), lambda r: r["_v"]["votes"] > 0)
    return x.select("doc_id", F.col("_v.label").alias("sentiment"), F.round("_v.confidence", 6).alias("confidence"), F.col("_v.votes").alias("votes"))


def analyze_ensemble(posts: DataFrame, models=C.MODEL_NAMES) -> DataFrame:
    """M6 with an ensemble: clean -> every member votes -> A12 on the row, without a shuffle.  Blank
    contents drop out."""
    kept = posts.where(P.not_blank("content")).select("doc_id", "platform", "content")
    cleaned = where_computed(T.with_preprocessed(kept, "content", "content"),
                             lambda r: F.length(r["content"]) > 0)
    x = scoring.with_votes(cleaned, "content", models).drop("content")
    x = barrier(x).withColumn("_v", scoring.vote_array("votes"))
    return x.select("doc_id", "platform", F.col("_v.label").alias("sentiment"),
                    F.round("_v.confidence", 6).alias("confidence"), F.size("votes").alias("n_models"))


def comment_labels(comments: DataFrame) -> DataFrame:
    """M8 on comments: ``label`` is the scorer's."""
    return scoring.with_rule_score(comments, "text", "_s").withColumn("label", F.col("_s.label")).drop("_s", "text")


def label_share_by_platform(analysed: DataFrame) -> DataFrame:
    """A5 per platform: percent of each label (absent labels 0); one partial + final aggregate."""
    n = F.count(F.lit(1))
    aggs = [F.round(F.count_if(F.col("sentiment") == k) * 100.0 / n, 6).alias(f"pct_{name}")
            for k, name in C.LABEL_NAMES.items()]
    return analysed.groupBy("platform").agg(n.alias("n_posts"), *aggs)


def process_data(posts: DataFrame, min_conf: float = C.MIN_CONFIDENCE) -> DataFrame:
    """M7: title fallback -> clean title and content (T1 both) -> F6 gate -> score -> decode -> confidence
    filter.  Ineligible text scores (1, 0.0) and is then removed by the confidence filter."""
    content = F.coalesce(F.nullif(T.strip_blank("content"), F.lit("")), F.col("title"))
    x = posts.select("doc_id", "platform", T.basic_clean("title").alias("title"),
                     content.alias("content"))
    x = T.with_preprocessed(x, "content", "content")
    x = scoring.with_rule_score(x, "content", "_r")
    elig = P.sentiment_eligibility("content")
    x = x.withColumn("_s", F.when(elig["valid"], F.col("_r")).otherwise(scoring.neutral_score()))
    out = x.select("doc_id", "platform", "title", F.col("_s.label").alias("sentiment_numeric"),
                   S.label_name(F.col("_s.label")).alias("sentiment"),
                   S.label_color(F.col("_s.label")).alias("sentiment_color"),
                   F.round(F.col("_s.confidence"), 6).alias("confidence"))
    return where_computed(out, lambda r: r["confidence"] >= min_conf)
