"""Queries of the trained ensemble members (M2, M5, M6, A12, A17).  They train models, so they have no
SQL; tests hold them against held-out labels and a plain fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import predicates as P
from postlens.functions import text as T
from postlens.operators import members as M
from postlens.operators import scoring
from postlens.operators.rowops import barrier
from postlens.plans.registry import register
from postlens.sources import tables as TB

ORACLE: dict[str, str] = {}


def _posts(spark, sf):
    """Cleaned contents with the label that ``labels`` gives, if any."""
    p = TB.posts(spark, sf).where(P.not_blank("content")).select("doc_id", "platform", "content", F.col("sentiment").alias("known"))
    return T.with_preprocessed(p, "content", "content")


@register("trained_ensemble")
def q_trained_ensemble(spark, sf):
    """M6 with members learnt from labels: every member votes, A12 decides on the row."""
    p = _posts(spark, sf)
    x = M.train(p, "doc_id", "content", "known").votes(p.select("doc_id", "platform", "content"), "content")
    x = barrier(x).withColumn("_v", scoring.vote_array("votes"))
    return x.select("doc_id", "platform", F.col("_v.label").alias("sentiment"), F.round("_v.confidence", 4).alias("confidence"),
                    F.size("votes").alias("n_models"))


@register("trained_vote_summary")
def q_trained_vote_summary(spark, sf):
    """A17 over the votes of the trained members."""
    p = _posts(spark, sf)
    v = M.train(p, "doc_id", "content", "known").votes(p.select("doc_id", "content"), "content")
    return v.select(F.inline("votes")).groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


@register("member_accuracy")
def q_member_accuracy(spark, sf):
    """Votes on the labelled posts that nothing was learnt from: how often each member, the ensemble and
    the word list are right, and how sure they say they are."""
    p = _posts(spark, sf)
    held = p.where((M.fold("doc_id") == M.HELD_OUT) & F.col("known").isNotNull()).select("doc_id", "content", "known")
    x = scoring.with_rule_score(M.train(p, "doc_id", "content", "known").votes(held, "content"), "content", "_rule")
    x = barrier(x).withColumn("_v", scoring.vote_array("votes"))
    word_list, ensemble = (F.struct(F.lit(n).alias("model"), F.col(f"{c}.label").alias("label"), F.col(f"{c}.confidence").alias("confidence"))
                           for n, c in (("word-list", "_rule"), ("ensemble", "_v")))
    each = F.concat(F.transform("votes", lambda v: F.struct(v["model"].alias("model"), v["label"].alias("label"), v["confidence"].alias("confidence"))),
                    F.array(word_list, ensemble))
    v = x.select("known", F.explode(each).alias("v")).select("known", "v.*")
    right = (F.col("label") == F.col("known")).cast("double")
    return v.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("known")).alias("n_right"),
                                  F.round(F.avg(right), 3).alias("accuracy"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
