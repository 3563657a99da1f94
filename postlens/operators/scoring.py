"""Sentiment scoring (M1-M8) and the ensemble vote.

* The rule scorer runs natively (token counts -> 3 logits -> softmax/argmax), so it stays inside
  whole-stage codegen and has an exact SQL oracle.
* Plug-in scorers follow a small protocol (``name``, ``score(pd.Series) -> DataFrame[label,
  confidence]``) and run in ``mapInPandas``: one scorer object per task, Arrow batches in and out.
* The vote over a long (doc_id, model, label, confidence) table is two hash aggregates, both with
  map-side partial aggregation, so a document or label holding many votes cannot overload one
  task; no vote list is ever collected.
"""

from __future__ import annotations

import math
from typing import Iterator, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import predicates as P
from postlens.functions import text as T
from postlens.session import scratch_path, ship


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- M3 / M4 classifier head
#
# Higher-order functions are not common-subexpression-eliminated, so each multi-step score is
# built as a chain of projections: an expensive column referenced twice stays in its own
# projection (CollapseProject keeps it), and every step is evaluated once per row.

def neutral_score() -> Column:
    return F.struct(F.lit(C.NEUTRAL).alias("label"), F.lit(0.0).alias("confidence"))


def with_argmax_head(df: DataFrame, logits: str, out: str) -> DataFrame:
    """M3 for 3-way logits: softmax, argmax (first on ties) and its probability, in closed form.
    Adds struct column ``out`` (label, confidence)."""
    l0, l1, l2 = (F.element_at(F.col(logits), i) for i in (1, 2, 3))
    x = df.withColumn("_l", F.struct(l0.alias("a"), l1.alias("b"), l2.alias("c")))
    x = x.withColumn("_m", F.greatest("_l.a", "_l.b", "_l.c"))
    x = x.withColumn("_e", F.struct(F.exp(F.col("_l.a") - F.col("_m")).alias("a"),
                                    F.exp(F.col("_l.b") - F.col("_m")).alias("b"),
                                    F.exp(F.col("_l.c") - F.col("_m")).alias("c")))
    x = x.withColumn("_p", F.struct(*[(F.col(f"_e.{k}") / (F.col("_e.a") + F.col("_e.b") + F.col("_e.c")))
                                      .alias(k) for k in "abc"]))
    top = F.greatest("_p.a", "_p.b", "_p.c")
    label = F.when(F.col("_p.a") == top, 0).when(F.col("_p.b") == top, 1).otherwise(2)
    x = x.withColumn(out, F.struct(label.cast("int").alias("label"), top.cast("double").alias("confidence")))
    return x.drop("_l", "_m", "_e", "_p")


def apply_fallbacks(score: Column, text: Column, min_conf: float | None = C.LOW_CONFIDENCE_FALLBACK
                    ) -> Column:
    """M4: blank text -> (1, 0.0); confidence below ``min_conf`` -> (1, 0.0)."""
    blank = text.isNull() | T.is_blank(text)
    out = F.when(blank, neutral_score())
    if min_conf is not None:
        out = out.when(score["confidence"] < min_conf, neutral_score())
    return out.otherwise(score)


# ---------------------------------------------------------------- native rule scorer

def rule_logits(toks: Column, pos=C.POSITIVE_WORDS, neg=C.NEGATIVE_WORDS,
                scale: float = C.RULE_SCORE_SCALE) -> Column:
    n = F.greatest(F.size(toks), F.lit(1)).cast("double")
    pos_arr = F.array(*[F.lit(w) for w in pos])
    neg_arr = F.array(*[F.lit(w) for w in neg])
    npos = F.size(F.filter(toks, lambda x: F.array_contains(pos_arr, x))).cast("double")
    nneg = F.size(F.filter(toks, lambda x: F.array_contains(neg_arr, x))).cast("double")
    return F.array(nneg * scale / n, F.lit(1.0), npos * scale / n)


def with_rule_score(df: DataFrame, text_col: str, out: str = "score") -> DataFrame:
    """Native scorer: adds struct ``out`` (label, confidence) with the M4 fallbacks."""
    x = df.withColumn("_tok", T.tokens(text_col))
    x = x.withColumn("_lg", rule_logits(F.col("_tok")))
    x = with_argmax_head(x, "_lg", "_head")
    x = x.withColumn(out, apply_fallbacks(F.col("_head"), F.col(text_col)))
    return x.drop("_tok", "_lg", "_head")


# ---------------------------------------------------------------- M2 plug-in scorer protocol

class Scorer(Protocol):
    """Either form will do: a batch of texts, or one text at a time."""

    name: str

    def score(self, texts: pd.Series) -> pd.DataFrame:  # columns label, confidence
        ...

    def analyze_text(self, text: str) -> tuple[int, float]:  # label, confidence
        ...


def score_texts(scorer, texts: pd.Series) -> tuple[pd.DataFrame, int]:
    """Scores of a batch and the number of texts that failed.  A scorer that fails on a batch gets
    it again text by text; a text that fails alone scores (1, 0.0)."""
    if hasattr(scorer, "score"):
        try:
            return scorer.score(texts)[["label", "confidence"]].reset_index(drop=True), 0
        except Exception:  # one text may have failed: find out which
            pass
    rows, failed = [], 0
    for t in texts:
        try:
            if hasattr(scorer, "analyze_text"):
                label, confidence = scorer.analyze_text(t)
            else:
                label, confidence = scorer.score(pd.Series([t]))[["label", "confidence"]].iloc[0]
            rows.append((int(label), float(confidence)))
        except Exception:
            rows.append((C.NEUTRAL, 0.0))
            failed += 1
    return pd.DataFrame(rows, columns=["label", "confidence"]), failed


class PandasRuleScorer:
    """The rule scorer as a plug-in (same lexicon), for the ``mapInPandas`` path."""

    name = "rule"

    def __init__(self, pos=C.POSITIVE_WORDS, neg=C.NEGATIVE_WORDS, scale=C.RULE_SCORE_SCALE):
        import re

        import numpy as np
        self._np = np
        self._tok = re.compile(r"\w+")             # letters, numbers, _
        self.pos, self.neg, self.scale = set(pos), set(neg), scale

    def score(self, texts: pd.Series) -> pd.DataFrame:
        np = self._np
        labels, confs = [], []
        for t in texts:
            toks = self._tok.findall(t.lower()) if isinstance(t, str) else []
            n = max(len(toks), 1)
            lg = np.array([sum(w in self.neg for w in toks) * self.scale / n, 1.0,
                           sum(w in self.pos for w in toks) * self.scale / n])
            e = np.exp(lg - lg.max())
            p = e / e.sum()
            k = int(p.argmax())
            labels.append(k)
            confs.append(float(p[k]))
        return pd.DataFrame({"label": labels, "confidence": confs})


def batch_score(df: DataFrame, text_col: str, scorer_factory=PandasRuleScorer,
                key_cols=("doc_id",), failures=None) -> DataFrame:
    """M2: score ``text_col`` with a plug-in scorer built once per task.

    Ineligible text (F6) and texts that the scorer fails on give (1, 0.0); the score stays on its
    row, and one failing text changes no other.  ``failures``: an accumulator that counts them.
    """
    keys = list(key_cols)
    src = df.select(*keys, F.col(text_col).alias("_text"),
                    P.sentiment_eligibility(text_col)["valid"].alias("_valid"))
    ship(df.sparkSession)
    failures = failures if failures is not None else df.sparkSession.sparkContext.accumulator(0)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                           for f in src.schema.fields if f.name in keys)
    schema = f"{key_schema}, sentiment int, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for b in batches:
            out = b[keys].copy()
            out["sentiment"] = C.NEUTRAL
            out["confidence"] = 0.0
            ok = b["_valid"].fillna(False).astype(bool).to_numpy()
            if ok.any():
                s, bad = score_texts(scorer, b.loc[ok, "_text"].reset_index(drop=True))
                out.loc[ok, "sentiment"] = s["label"].to_numpy()
                out.loc[ok, "confidence"] = s["confidence"].to_numpy()
                if bad:
                    failures.add(bad)
            out["sentiment"] = out["sentiment"].astype("int32")
            yield out

    return src.mapInPandas(run, schema)


# ---------------------------------------------------------------- A12 ensemble vote, M5 sets

def with_votes(df: DataFrame, text_col: str, models=C.MODEL_NAMES, out: str = "votes") -> DataFrame:
    """The members' votes on ``text_col`` as array<struct<model, model_ord, label, confidence>>.

    The lexicon words are counted once per text and shared by the members.  Blank text gets no votes.
    Confidences have four digits, so means of up to five votes are exact at six.
    """
    def count(words, group):
        arr = F.array(*[F.lit(w) for w in words if (w in C.GERMANIC_WORDS) == group])
        return F.size(F.filter(F.col("_tok"), lambda t: F.array_contains(arr, t))).cast("double")

    x = df.withColumn("_tok", T.tokens(text_col))
    x = x.withColumn("_c", F.array(F.greatest(F.size("_tok"), F.lit(1)).cast("double"),
                                   count(C.POSITIVE_WORDS, True), count(C.POSITIVE_WORDS, False),
                                   count(C.NEGATIVE_WORDS, True), count(C.NEGATIVE_WORDS, False)))
    n, pos_g, pos_r, neg_g, neg_r = (F.element_at("_c", i) for i in range(1, 6))
    rules = [(m, C.MODEL_NAMES.index(m), *C.MODEL_RULES[m]) for m in models]
    votes = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("model_ord"), F.lit(scale).alias("scale"),
                               F.lit(g).alias("g"), F.lit(r).alias("r")) for m, k, scale, g, r in rules])

    def step(votes, **made):
        return F.transform(votes, lambda v: F.struct(v["model"].alias("model"), v["model_ord"].alias("model_ord"),
                                                     *[f(v).alias(name) for name, f in made.items()]))

    # one transform per step of the head, so that no step is evaluated twice
    votes = step(votes, a=lambda v: (neg_g * v["g"] + neg_r * v["r"]) * v["scale"] / n,
                 b=lambda v: F.lit(1.0), c=lambda v: (pos_g * v["g"] + pos_r * v["r"]) * v["scale"] / n)
    logits = {k: (lambda v, k=k: v[k]) for k in "abc"}
    votes = step(votes, top=lambda v: F.greatest(v["a"], v["b"], v["c"]), **logits)
    votes = step(votes, **{k: (lambda v, k=k: F.exp(v[k] - v["top"])) for k in "abc"})
    votes = step(votes, total=lambda v: v["a"] + v["b"] + v["c"], **logits)
    votes = step(votes, **{k: (lambda v, k=k: v[k] / v["total"]) for k in "abc"})
    votes = step(votes, top=lambda v: F.greatest(v["a"], v["b"], v["c"]), **logits)
    votes = step(votes, label=lambda v: F.when(v["a"] == v["top"], 0).when(v["b"] == v["top"], 1).otherwise(2),
                 confidence=lambda v: F.round(v["top"], 4))
    x = x.withColumn("_v", votes)
    blank = F.col(text_col).isNull() | T.is_blank(F.col(text_col))
    x = x.withColumn(out, F.when(blank, F.slice("_v", 1, 0)).otherwise(F.col("_v")))
    return x.drop("_tok", "_c", "_v")


def score_or_null(df: DataFrame, text_col: str, out: str = "score") -> DataFrame:
    """M8: the score of a text while it is collected; blank text has none."""
    x = with_rule_score(df, text_col, "_s")
    has = F.col(text_col).isNotNull() & ~T.is_blank(F.col(text_col))
    return x.withColumn(out, F.when(has, F.col("_s"))).drop("_s")


def resolve_model_set(names) -> list[str]:
    """M5: a set name or a list; unknown names dropped; empty -> the three defaults."""
    if isinstance(names, str):
        names = C.MODEL_SETS.get(names, [names])
    picked = [n for n in (names or C.MODEL_NAMES) if n in C.MODEL_NAMES]
    return picked or list(C.DEFAULT_FALLBACK_MODELS)


def ensemble_vote(votes: DataFrame, key: str = "doc_id") -> DataFrame:
    """A12 over a long vote table (key, model_ord, label, confidence).

    Winner: most votes, then higher mean confidence, then the label first voted by the earliest
    model; confidence = mean confidence of the winner.
    """
    per_label = votes.groupBy(key, "label").agg(
        F.count(F.lit(1)).alias("n_votes"),
        F.avg("confidence").alias("mean_conf"),
        F.min("model_ord").alias("first_ord"))
    best = per_label.groupBy(key).agg(F.max_by(
        F.struct("label", "mean_conf", "n_votes"),
        F.struct("n_votes", "mean_conf", (-F.col("first_ord")).alias("neg_ord"))).alias("w"))
    return best.select(key, F.col("w.label").alias("sentiment"),
                       F.col("w.mean_conf").alias("confidence"),
                       F.col("w.n_votes").alias("votes"))


def vote_array(votes) -> Column:
    """A12 on a row-local vote array<struct<model_ord,label,confidence>>: no shuffle at all.
    struct(label, confidence, votes of the winner); no votes -> (1, 0.0, 0)."""
    v = _c(votes)

    def stats(k):
        sel = F.filter(v, lambda x: x["label"] == k)
        n = F.size(sel)
        mean = F.aggregate(sel, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.greatest(n, F.lit(1))
        first = F.coalesce(F.array_min(F.transform(sel, lambda x: x["model_ord"])), F.lit(1 << 30))
        return F.struct(n.alias("n"), mean.alias("mean"), (-first).alias("neg_first"),
                        F.lit(k).alias("label"))

    best = F.array_max(F.array(*[stats(k) for k in (0, 1, 2)]))
    none = F.struct(F.lit(C.NEUTRAL).alias("label"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("votes"))
    return F.when(F.size(v) > 0, T.let(best, lambda b: F.struct(
        b["label"].alias("label"), b["mean"].alias("confidence"), b["n"].cast("long").alias("votes")))).otherwise(none)


# ---------------------------------------------------------------- M1 naive Bayes

HOT_WORDS = 1 << 17


def naive_bayes(train: DataFrame, apply: DataFrame, text_col: str = "text",
                label_col: str = "label", key: str = "doc_id"):
    """M1: multinomial naive Bayes (labels 0/1, add-one smoothing) over all words.

    Returns (weights, predictions of ``apply``).  The model is a table of one row per word with the
    difference of its log likelihoods, so the vocabulary is as large as it is and never leaves the
    executors; the counts are written once.  The most frequent words meet a broadcast and are summed per
    document before anything moves.  Each other occurrence moves once to its word and its weight once
    to its document; such a word has less than 1 / ``HOT_WORDS`` of the training words.  Words that
    training has not seen say nothing.
    """
    spark = train.sparkSession
    t = train.select(key, F.col(label_col).cast("int").alias("label"), F.explode(T.tokens(text_col)).alias("word"))
    path = scratch_path(spark, "word-counts")
    (t.groupBy("word").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
     .write.parquet(path))
    counts = spark.read.schema("word string, n0 long, n1 long").parquet(path)
    total = counts.agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"), F.count(F.lit(1)).alias("v")).first()
    docs = train.agg(F.count_if(F.col(label_col) == 0).alias("d0"), F.count_if(F.col(label_col) == 1).alias("d1")).first()
    s0, s1, v = (float(total[k] or 0) for k in ("s0", "s1", "v"))
    hot = (F.col("n0") + F.col("n1")) >= max(s0 + s1, 1.0) / HOT_WORDS
    weights = counts.select("word", (F.log(F.col("n1") + 1.0) - F.log(F.col("n0") + 1.0)
                                     - F.lit(math.log(s1 + v) - math.log(s0 + v) if v else 0.0)).alias("weight"), hot.alias("hot"))
    prior = math.log(max(docs["d1"], 0.5)) - math.log(max(docs["d0"], 0.5))
    often = F.broadcast(weights.where("hot").select("word", F.col("weight").alias("known")))
    words = apply.select(key, F.explode(T.tokens(text_col)).alias("word")).join(often, "word", "left")
    # one pass over the texts: a row's own sum of frequent words, and its other words as they are
    rare = words.where("known is null").select(key, "word").join(weights.where("not hot").select("word", "weight"), "word")
    parts = (words.where("known is not null").groupBy(key).agg(F.sum("known").alias("weight"))
             .unionByName(rare.groupBy(key).agg(F.sum("weight").alias("weight"))))
    odds = parts.groupBy(key).agg(F.sum("weight").alias("odds"))
    pred = (apply.select(key).join(odds, key, "left")
            .select(key, (F.coalesce("odds", F.lit(0.0)) + F.lit(prior) > 0).cast("int").alias("prediction")))
    return weights.drop("hot"), pred
