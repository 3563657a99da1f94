"""Trained members: held-out accuracy, calibration, and the logistic member against a plain optimum."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import members as M
from postlens.operators import scoring

GOOD, BAD, DULL = ["fine", "great", "lovely", "sunny"], ["awful", "rotten", "nasty", "grim"], ["table", "road", "paper", "stone"]


def posts(spark, n=400, noise=0.1):
    r = random.Random(2)
    rows = []
    for k in range(n):
        label = r.randrange(3)
        own = (BAD, DULL, GOOD)[label if r.random() > noise else r.randrange(3)]
        words = [r.choice(own) if r.random() < 0.6 else r.choice(["the", "and", "of", "it"]) for _ in range(r.randrange(5, 15))]
        rows.append((k, " ".join(words), label if k % 5 else None))
    rows += [(n, None, None), (n + 1, "  ", 1), (None, "lovely sunny", 2)]
    return spark.createDataFrame(rows, "doc_id long, content string, known int")


def test_members_learn_and_the_vote_is_right(spark):
    p = posts(spark)
    got = M.train(p, "doc_id", "content", "known")
    held = p.where((M.fold("doc_id") == M.HELD_OUT) & F.col("known").isNotNull())
    v = got.votes(held, "content").withColumn("v", scoring.vote_array("votes"))
    rows = v.collect()
    assert len(rows) > 50
    for m in ("words-logistic", "words-bayes"):
        right = np.mean([next(x.label for x in r.votes if x.model == m) == r.known for r in rows if r.votes])
        assert right > 0.8, m
    assert np.mean([r.v.label == r.known for r in rows]) > 0.8
    # calibrated: the mean confidence is near the share of right votes
    sure = np.mean([next(x.confidence for x in r.votes if x.model == "words-logistic") for r in rows if r.votes])
    right = np.mean([next(x.label for x in r.votes if x.model == "words-logistic") == r.known for r in rows if r.votes])
    assert abs(sure - right) < 0.12
    for steps in got.steps.values():
        assert steps == sorted(steps) and [y for _, y in steps] == sorted(y for _, y in steps)
    blank = got.votes(p.where("content is null or trim(content) = ''"), "content").collect()
    assert [r.votes for r in blank] == [[], []]
    # learning again gives the same votes
    again = M.train(p, "doc_id", "content", "known").votes(held, "content")
    key = lambda df: sorted((r.doc_id, [(x.model, x.label, round(x.confidence, 2)) for x in r.votes]) for r in df.collect())
    assert key(again) == key(v.select("doc_id", "votes"))


def test_held_out_rows_teach_nothing(spark):
    p = posts(spark)
    other = p.withColumn("known", F.when(M.fold("doc_id") == M.HELD_OUT, F.lit(0)).otherwise(F.col("known")))
    a, b = (M.train(x, "doc_id", "content", "known", ["words-bayes"]) for x in (p, other))
    assert np.allclose(a.models["words-bayes"].theta.toArray(), b.models["words-bayes"].theta.toArray())


def test_one_kind_of_label_is_refused(spark):
    p = posts(spark).withColumn("known", F.lit(1))
    with pytest.raises(ValueError):
        M.train(p, "doc_id", "content", "known")


def test_calibration_is_the_fitted_line(spark):
    steps = [(0.2, 0.1), (0.5, 0.4), (0.9, 0.8)]
    xs = [0.0, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0]
    got = spark.createDataFrame([(x,) for x in xs], "p double").select("p", M._calibrated(F.col("p"), steps).alias("y")).collect()
    assert [r.y for r in got] == pytest.approx(list(np.interp(xs, *zip(*steps, strict=True))))
    assert spark.range(1).select(M._calibrated(F.lit(0.3), [(0.5, 0.7)]).alias("y")).first().y == 0.7


def test_calibration_meets_few_steps_a_row(spark):
    """Places found by halving, once a row: equal to numpy's line for any number of steps."""
    r = random.Random(5)
    for n in (2, 3, 7, 8, 9, 667):
        steps = [(k / n, y) for k, y in enumerate(sorted(r.random() for _ in range(n)))]
        xs = [x for x, _ in steps] + [r.random() * 1.2 - 0.1 for _ in range(50)]
        df = spark.createDataFrame([(x,) for x in xs], "p double").select("p", M._calibrated(F.col("p"), steps).alias("y"))
        assert [x.y for x in df.collect()] == pytest.approx(list(np.interp(xs, *zip(*steps, strict=True))))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") == 1
    assert len(re.findall(r"aggregate\(\[([\d,]+)\]", plan)[0].split(",")) == 10     # 667 steps


def test_features_are_plain_counts(spark):
    """Equal to counting in Python, and no measure replaces or folds a text piece by piece."""
    texts = ["", "one", "A b A b, b", "x1 2\ny\ny ..!?", "\u03a9 \uac00\ub098 \U0001f600 _a \uac00\ub098", "\t\t"]
    df = M.with_features(spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "doc_id long, content string"), "content")
    hashed = M.HashingTF(inputCol="t", outputCol="h", numFeatures=M.FEATURES)
    for x, t in zip(df.orderBy("doc_id").collect(), [*texts, ""], strict=True):
        w = re.findall(r"\w+", t.lower())
        words = Counter(hashed.indexOf(a) for a in set(w))
        pairs = Counter(hashed.indexOf(a) for a in w + [f"{a} {b}" for a, b in zip(w, w[1:])] + w[-1:])
        assert dict(zip(x._words.indices, x._words.values)) == dict.fromkeys(words, 1.0)
        assert dict(zip(x._pairs.indices, x._pairs.values)) == pairs
        n, k, lines = max(len(t), 1), max(len(w), 1), t.split("\n")
        share = [sum(bool(re.match(c, a)) for a in t) / n for c in ("[A-Z]", "[0-9]", r"[.,!?_\U0001f600]", r"\s")]
        assert list(x._shape) == pytest.approx([math.log1p(n), math.log1p(k), *share, len(set(w)) / k, sum(map(len, w)) / k,
                                                len(set(lines)) / len(lines), math.log1p(len(lines))])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "[^A-Z]" not in plan and "concat_ws" not in plan and plan.count("array_distinct(_tok") == 1


def test_logistic_member_is_near_the_optimum(spark):
    """Its loss is within a hundredth of a plain gradient descent's on the same vectors."""
    p = posts(spark, 200).where("known is not null and doc_id is not null")
    rows = M.with_features(p.withColumn("label", F.col("known").cast("double")), "content").select("label", "_words").collect()
    words = sorted({i for r in rows for i in r._words.indices})
    x = np.zeros((len(rows), len(words)))
    for k, r in enumerate(rows):
        x[k, np.searchsorted(words, r._words.indices)] = r._words.values
    y = np.array([int(r.label) for r in rows])

    def loss(w, b):
        z = x @ w + b
        z = z - z.max(1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(1, keepdims=True))
        return -logp[np.arange(len(y)), y].mean() + M.L2 / 2 * (w ** 2).sum(), np.exp(logp)

    w, b = np.zeros((x.shape[1], 3)), np.zeros(3)
    for _ in range(4000):
        _, prob = loss(w, b)
        prob[np.arange(len(y)), y] -= 1
        w -= 0.5 * (x.T @ prob / len(y) + M.L2 * w)
        b -= 0.5 * prob.mean(0)
    df = spark.createDataFrame([(r.label, r._words) for r in rows], ["label", "_words"])
    m = M._estimator("words-logistic").fit(df)
    got, _ = loss(m.coefficientMatrix.toArray().T[words], m.interceptVector.toArray())
    assert got < loss(w, b)[0] + 0.01


def test_naive_bayes_moves_a_word_once(spark, monkeypatch):
    """Equal to counting in Python, with and without frequent words; no shuffle by document and word."""
    r = random.Random(7)
    texts = [(k, " ".join(r.choice(["the", "a", f"w{r.randrange(60)}", f"x{k % 2}"]) for _ in range(30)), k % 2) for k in range(60)]
    texts += [(60, "the unseen word", None), (61, "", 1), (62, None, 0), (5, "x0 the again", 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, label int")
    seen = {y: Counter(w for _, t, label in texts if label == y for w in (t or "").split()) for y in (0, 1, None)}
    size, v = {y: sum(seen[y].values()) for y in (0, 1)}, len(seen[0] | seen[1] | seen[None])
    prior = math.log(sum(t[2] == 1 for t in texts)) - math.log(sum(t[2] == 0 for t in texts))
    odds = Counter({k: prior for k, _, _ in texts})
    for k, t, _ in texts:
        odds[k] += sum(math.log(seen[1][w] + 1) - math.log(seen[0][w] + 1) - math.log(size[1] + v) + math.log(size[0] + v) for w in (t or "").split())
    for hot in (2, 40, 1 << 17):
        monkeypatch.setattr(scoring, "HOT_WORDS", hot)
        weights, pred = scoring.naive_bayes(df, df.select("doc_id", "text"))
        assert weights.columns == ["word", "weight"] and weights.count() == v
        assert all(abs(o) > 1e-9 for o in odds.values())
        assert sorted(map(tuple, pred.collect())) == sorted((k, int(odds[k] > 0)) for k, _, _ in texts)
        assert not re.search(r"hashpartitioning\(doc_id#\d+L?, word", pred._jdf.queryExecution().executedPlan().toString())
