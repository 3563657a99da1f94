"""Ensemble members that are models: trained from labelled posts, calibrated, and voted.

Three members see a post in different ways:

* ``words-logistic``: hashed words, multinomial logistic loss, L-BFGS;
* ``words-bayes``: hashed words and pairs of words, multinomial naive Bayes;
* ``shape-logistic``: counts of characters, lines, words and word lengths, multinomial logistic loss.

Training is Spark ML's: each gradient is a tree aggregate over the labelled rows, all of which are
used.  Labelled rows fall into ``FOLDS`` folds by the crc32 of their key; the fold ``HELD_OUT`` is
never learnt from.  For each other fold a member is trained on the rest and votes on it; these
out-of-fold votes calibrate the member's confidence by isotonic regression (confidence -> share of
right votes), over at most ``STEPS`` distinct confidences, so its size doesn't grow with the posts.  The
members that vote are trained on all folds but the held-out one.

Votes are arrays on the row, as the lexicon members' are, so ``scoring.vote_array`` decides them
without a shuffle.

Defined cases: rows without a label or a key are not learnt from; a label that training has not seen
is never voted; blank text gets no votes; without any labelled row, or with labels of one kind only,
``train`` raises ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators.rowops import barrier
from postlens.session import scratch_path

MEMBERS = ["words-logistic", "words-bayes", "shape-logistic"]
FOLDS, HELD_OUT = 4, 2
FEATURES = 1 << 15
STEPS = 1000
ITERATIONS = 15
L2 = 0.001
PART_ROWS = 16384


def fold(key) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def _shape(text: str, tokens: str, distinct: str) -> Column:
    """Measures of a text that don't depend on which words it holds; ``distinct``: its different tokens."""
    t, w = F.col(text), F.col(tokens)
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.greatest(F.size(w), F.lit(1)).cast("double")

    def share(chars: str) -> Column:
        # runs of the class are few beside the characters outside it
        return (F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]+", ""))) / n

    lines = F.split(t, "\n")
    return F.array(F.log1p(n), F.log1p(words), share("A-Z"), share("0-9"), share("\\p{P}\\p{S}"), share("\\s"),
                   F.size(distinct) / words, F.length(F.array_join(w, "")) / words,
                   F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)), F.log1p(F.size(lines).cast("double")))


def with_features(df: DataFrame, text_col: str) -> DataFrame:
    """Adds the vectors ``_words``, ``_pairs`` and ``_shape``."""
    x = barrier(df.withColumn("_text", F.coalesce(text_col, F.lit(""))).withColumn("_tok", T.tokens("_text")))
    x = x.withColumn("_set", F.array_distinct("_tok"))
    # the words, each with its follower, and the last word once more
    later = F.slice("_tok", F.lit(2), F.greatest(F.size("_tok") - 1, F.lit(0)))
    pairs = F.concat("_tok", F.transform(later, lambda w, k: F.concat(F.get("_tok", k), F.lit(" "), w)), F.slice("_tok", -1, 1))
    x = x.withColumns({"_two": pairs, "_shape": array_to_vector(_shape("_text", "_tok", "_set"))})
    x = HashingTF(inputCol="_set", outputCol="_words", numFeatures=FEATURES, binary=True).transform(x)
    x = HashingTF(inputCol="_two", outputCol="_pairs", numFeatures=FEATURES).transform(x)
    return x.drop("_text", "_tok", "_set", "_two")


def _estimator(member: str):
    names = {"labelCol": "label", "predictionCol": f"_vote_{member}", "probabilityCol": f"_prob_{member}", "rawPredictionCol": f"_raw_{member}"}
    if member == "words-bayes":
        return NaiveBayes(featuresCol="_pairs", smoothing=1.0, **names)
    return LogisticRegression(featuresCol="_words" if member == "words-logistic" else "_shape", family="multinomial",
                              maxIter=ITERATIONS, regParam=L2, standardization=member == "shape-logistic", **names)


def _raw_votes(df: DataFrame, models: dict[str, Model]) -> DataFrame:
    """``df`` with struct columns ``_v_<member>`` (label, p) of uncalibrated votes."""
    for member, model in models.items():
        df = model.transform(df)
        df = df.withColumn(f"_v_{member}", F.struct(F.col(f"_vote_{member}").cast("int").alias("label"),
                                                    F.array_max(vector_to_array(f"_prob_{member}")).alias("p")))
        df = df.drop(f"_vote_{member}", f"_prob_{member}", f"_raw_{member}")
    return df


def _calibrated(p: Column, steps: list[tuple[float, float]]) -> Column:
    """Piecewise linear between the calibration's steps, constant beyond them."""
    if len(steps) < 2:
        return F.lit(steps[0][1] if steps else None).cast("double")
    places, values = (F.lit(np.array(v, "float64")) for v in zip(*steps, strict=True))
    # steps at or below p, by halving: a row meets log2 of the steps
    halves = F.lit(np.array([1 << k for k in reversed(range(len(steps).bit_length()))], "int32"))
    at = F.aggregate(halves, F.lit(0), lambda n, h: F.when(F.get(places, n + h - 1) <= p, n + h).otherwise(n))

    def line(at):
        x, y = F.get(places, at - 1), F.get(values, at - 1)
        between = y + (F.get(values, at) - y) * (p - x) / (F.get(places, at) - x)
        return F.when(at == 0, F.lit(steps[0][1])).when(at == len(steps), F.lit(steps[-1][1])).otherwise(between)

    return T.let(at, line)


def _steps(model: IsotonicRegressionModel) -> list[tuple[float, float]]:
    """The corners of the fitted function; repeated places keep their last value."""
    return sorted(dict(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True)).items())


@dataclass
class Members:
    models: dict[str, Model]
    steps: dict[str, list[tuple[float, float]]] = field(default_factory=dict)

    def votes(self, df: DataFrame, text_col: str, out: str = "votes") -> DataFrame:
        """``df`` with array<struct<model, model_ord, label, confidence>>; blank text gets none."""
        own = df.columns
        x = _raw_votes(with_features(df, text_col), self.models)
        votes = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("model_ord"), F.col(f"_v_{m}.label").alias("label"),
                                   F.round(_calibrated(F.col(f"_v_{m}.p"), self.steps[m]), 4).alias("confidence"))
                          for k, m in enumerate(self.models)])
        blank = F.col(text_col).isNull() | T.is_blank(F.col(text_col))
        return barrier(x.withColumn(out, F.when(blank, F.slice(votes, 1, 0)).otherwise(votes)).select(*own, out))


def train(posts: DataFrame, key: str, text_col: str, label_col: str, members=MEMBERS) -> Members:
    """Members learnt from the labelled rows of ``posts`` outside the held-out fold."""
    spark = posts.sparkSession
    known = (posts.where(F.col(key).isNotNull() & F.col(label_col).isNotNull())
             .select(F.col(label_col).cast("double").alias("label"), fold(key).cast("int").alias("fold"), text_col)
             .where(F.col("fold") != HELD_OUT))
    path = scratch_path(spark, "member-features")
    with_features(known, text_col).drop(text_col).write.parquet(path)
    rows = spark.read.parquet(path)
    kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(kinds) < 2:
        raise ValueError("labels of two kinds at least are needed")
    # every step of a fit moves one gradient for each partition, so these hold many rows
    rows = rows.coalesce(-(-sum(kinds.values()) // PART_ROWS))
    out_of_fold = None
    for k in (k for k in range(FOLDS) if k != HELD_OUT):
        models = {m: _estimator(m).fit(rows.where(F.col("fold") != k)) for m in members}
        v = _raw_votes(rows.where(F.col("fold") == k), models).select("label", *[f"_v_{m}" for m in members])
        out_of_fold = v if out_of_fold is None else out_of_fold.unionByName(v)
    path = scratch_path(spark, "member-votes")
    out_of_fold.write.parquet(path)
    votes = spark.read.parquet(path)
    steps = {}
    for m in members:
        points = (votes.select(F.round(F.col(f"_v_{m}.p") * STEPS).cast("int").alias("at"),
                               (F.col(f"_v_{m}.label") == F.col("label")).cast("double").alias("right"))
                  .groupBy("at").agg(F.avg("right").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
                  .select((F.col("at") / STEPS).alias("features"), "label", "weight"))
        steps[m] = _steps(IsotonicRegression(weightCol="weight").fit(points))
    return Members({m: _estimator(m).fit(rows) for m in members}, steps)
