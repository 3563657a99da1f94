"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile.

A labelled good document is preferred to a labelled bad one.  With utility w . x of the features of
a text, P(good preferred) = sigmoid(w . (x_good - x_bad)); w is the maximiser of that likelihood
over ``PAIRS_EACH`` pairs per labelled document, with a small ridge.  The cut is the quantile of the
utilities, each label weighted to its share among the labelled rows, at the share of bad documents:
the middle between the quantiles just below and just above it, so
that a gap between the labels is cut in its middle.  score = sigmoid(scale (utility - cut) +
logit(0.7)), so predicted = 1 exactly from the cut on.

Features describe form, not content: shares of symbols, capitals, digits and punctuation, word
lengths, words that repeat the one before, distinct words, words and three-word windows, repeated
lines, words per line.  They are computed over whole texts in one pass without a shuffle and written,
``FEATURES`` numbers a row; learning and scoring read them.

Learning uses every labelled document that isn't held out, once each (of a repeated id the row with
the smallest features; a null text teaches nothing).  The documents of the rarer label are dealt by
hash into groups of about ``RARER``, those of the other label into parts of about ``GROUP`` of the same
groups, and each part meets all of its group's rarer ones; a fixed rotation pairs the two labels of a
part.  Each Newton step sums the parts' gradients and Hessians; the quantiles are exact, by histograms
that narrow down on one value.

Defined cases: a text without words (null, empty) has zero for every feature and is scored as such;
without labels of both kinds every utility is 0 and every score 0.7; rows that repeat are scored
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from postlens.llm.jobs import arrow_job, held_out, written
from postlens.llm.wordhash import Piece, range_hash, windows, word_pieces
from postlens.session import ship

GROUP, RARER = 4096, 256           # documents of the two labels that are paired in one part
PAIRS_EACH = 8
BINS = 1024
THRESHOLD = 0.7
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>!=@^~"])
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LETTER = UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
MARK = ~(LETTER | DIGIT) & (np.arange(256) > 32)
FEATURES = 15


def _per_doc(p: Piece, values: np.ndarray) -> np.ndarray:
    """Sum over each document's words."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[p.bounds[1:]] - total[p.bounds[:-1]]


def _distinct(bounds: np.ndarray, doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """Number of distinct values in each document."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=docs).astype(float)


def features(p: Piece) -> np.ndarray:
    """(documents, FEATURES) of a piece of texts."""
    out = np.zeros((p.docs, FEATURES))
    n = np.diff(p.bounds).astype(float)
    some = n > 0
    if not some.any():
        return out
    doc = p.doc_of()

    def in_words(kind):
        c = np.concatenate([[0], np.cumsum(kind[p.data])])
        return c[p.end] - c[p.start]

    size = (p.end - p.start).astype(float)
    chars = np.maximum(_per_doc(p, size), 1)
    letters, upper, symbols = in_words(LETTER), in_words(UPPER), in_words(SYMBOLS)
    same = np.zeros(len(doc))
    same[1:] = (p.hash[1:] == p.hash[:-1]) & (doc[1:] == doc[:-1])
    h3, whole = windows(p.hash, p.bounds, 3)
    h3, d3 = h3[whole], doc[:len(h3)][whole]
    n3 = np.maximum(np.bincount(d3, minlength=p.docs), 1)
    # lines: a word that is the first of its line starts one; a line's hash covers its words
    breaks = np.concatenate([[0], np.cumsum(p.data == 10)])
    line = np.ones(len(doc), bool)
    line[1:] = (breaks[p.start[1:]] != breaks[p.start[:-1]]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(line)
    last = np.append(first[1:], len(doc))
    lines = np.bincount(doc[first], minlength=p.docs).astype(float)
    distinct_lines = _distinct(p.bounds, doc[first], range_hash(p.hash, first, last), p.docs)

    with np.errstate(invalid="ignore", divide="ignore"):
        cols = [
            np.log1p(n) / 10,
            chars / np.maximum(n, 1) / 10,
            _per_doc(p, symbols) / chars,
            _per_doc(p, symbols > 0) / n,
            _per_doc(p, upper) / np.maximum(_per_doc(p, letters), 1),
            _per_doc(p, (upper == letters) & (letters > 1)) / n,
            _per_doc(p, in_words(DIGIT)) / chars,
            _per_doc(p, in_words(MARK)) / chars,
            _per_doc(p, letters == 0) / n,
            _per_doc(p, same) / n,
            _distinct(p.bounds, doc, p.hash, p.docs) / n,
            _distinct(p.bounds, d3, h3, p.docs) / n3,
            1 - distinct_lines / np.maximum(lines, 1),
            np.log1p(n / np.maximum(lines, 1)) / 10,
            _per_doc(p, size > 25) / n,
        ]
    for k, c in enumerate(cols):
        out[some, k] = c[some]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.utility(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features and their distance from the mean, so that both ends can be bad."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.abs(z)], axis=1)


def _features(text: pa.Array) -> np.ndarray:
    x = [features(p) for p in word_pieces(text)]
    return np.concatenate(x) if x else np.zeros((0, FEATURES))


def feature_udf(spark):
    ship(spark)

    @arrow_udf("array<double>")
    def vectors(text: pa.Array) -> pa.Array:
        x = _features(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
    return vectors


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def parts(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(label array<int>, x array<double>) of each part: ``rows`` (doc_id, label, x) dealt for pairing."""
    rare, other = sorted((0, 1), key=lambda k: sizes[k])
    groups = max(sizes[rare] // RARER, 1)
    cuts = -(-sizes[other] // (groups * GROUP))
    share = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(cuts))
    dealt = rows.select("*", F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(groups)).alias("g"), F.explode(
        F.when(F.col("label") == rare, F.sequence(F.lit(0).cast("long"), F.lit(cuts - 1).cast("long"))).otherwise(F.array(share))).alias("c"))
    row = F.array_sort(F.collect_list(F.struct("doc_id", "label", "x")))
    return dealt.groupBy("g", "c").agg(row.alias("r")).select("r.label", F.flatten("r.x").alias("x"))


def _newton(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """A row (pairs, gradient and Hessian without ridge, flat) for the parts of a task."""
    def run(batches):
        n, grad, hess = 0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            for k in range(batch.num_rows):
                y = batch.column("label")[k].values.to_numpy()
                z = expand((batch.column("x")[k].values.to_numpy().reshape(len(y), -1) - mean) / scale)
                good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
                if not len(good) or not len(bad):
                    continue
                rounds = np.arange(PAIRS_EACH * max(len(good), len(bad)))
                diff = z[good[rounds % len(good)]] - z[bad[(rounds + rounds // len(bad) * 7) % len(bad)]]
                p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
                n += len(diff)
                grad += diff.T @ (1 - p)
                hess += (diff * (p * (1 - p))[:, None]).T @ diff
        yield pa.RecordBatch.from_pydict({"n": [n], "grad": [grad], "hess": [hess.ravel()]})
    return run


def quantiles(values: DataFrame, weight: dict[int, float], at: list[float]) -> list[float]:
    """For each share q the smallest u of ``values`` (u, label) whose cumulated weight reaches q of all."""
    out = []
    ends = values.groupBy("label").agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi")).collect()
    total = sum(r["n"] * weight[r["label"]] for r in ends)
    for q in at:
        lo, hi, below = min(r["lo"] for r in ends), max(r["hi"] for r in ends), 0.0
        while lo < hi:
            # a value's bin grows with it, whatever the rounding
            at_bin = F.least(F.floor((F.col("u") - F.lit(lo)) / F.lit(hi - lo) * BINS), F.lit(BINS - 1)) if hi - lo > 0 else F.lit(0)
            bins: dict[int, list] = {}
            for r in (values.where(F.col("u").between(F.lit(lo), F.lit(hi))).groupBy(at_bin.alias("bin"), "label")
                      .agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi")).collect()):
                b = bins.setdefault(r["bin"], [0.0, r["lo"], r["hi"]])
                b[:] = b[0] + r["n"] * weight[r["label"]], min(b[1], r["lo"]), max(b[2], r["hi"])
            mass = below + np.cumsum([bins[b][0] for b in sorted(bins)])
            k = min(int(np.searchsorted(mass, min(max(q, 0), 1) * total * (1 - 1e-12))), len(mass) - 1)
            below, (_, lo, hi) = (mass[k - 1] if k else below), bins[sorted(bins)[k]]
        out.append(lo)
    return out


def fit(rows: DataFrame, counts: dict[int, int]) -> Model:
    """Model of all ``rows`` (doc_id, label, x); ``counts``: labelled documents of each label."""
    x = [F.get("x", F.lit(k)) for k in range(FEATURES)]
    stat = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("good"), F.array(*[F.avg(c) for c in x]).alias("mean"),
                    F.array(*[F.stddev_pop(c) for c in x]).alias("std")).first()
    sizes = {0: stat["n"] - stat["good"], 1: stat["good"]}
    mean, scale = (np.array(stat["mean"]), np.array(stat["std"]) + 1e-6) if stat["n"] else (np.zeros(FEATURES), np.ones(FEATURES))
    if not sizes[0] or not sizes[1]:
        return Model(mean, scale, np.zeros(2 * FEATURES), 0.0, 1.0)
    paired = written(parts(rows, sizes), "parts")
    w = np.zeros(2 * FEATURES)
    for _ in range(40):                             # Newton on the pairwise log-likelihood
        sums = arrow_job(paired, _newton(mean, scale, w), "n long, grad array<double>, hess array<double>").collect()
        ridge = 1e-3 * sum(r["n"] for r in sums)
        h = sum(np.array(r["hess"]) for r in sums).reshape(len(w), len(w)) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, sum(np.array(r["grad"]) for r in sums) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0, 1.0)
    values = written(rows.select("label", _apply(rows.sparkSession, model.utility)("x").alias("u")), "utilities")
    bad_share = counts.get(0, 0) / max(sum(counts.values()), 1)
    at = quantiles(values, {k: counts.get(k, 0) / sizes[k] for k in (0, 1)}, [bad_share * 0.97, bad_share * 1.01 + 0.002])
    return Model(mean, scale, w, float(sum(at) / 2), float(4 / max(values.agg(F.stddev_pop("u")).first()[0], 1e-6)))


def _apply(spark, fn):
    """``fn`` of the feature vectors of a column."""
    ship(spark)

    @arrow_udf("double")
    def value(x: pa.Array) -> pa.Array:
        return pa.array(fn(_matrix(x)) if len(x) else np.zeros(0))
    return value


def train(vectors: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """The model of all labelled rows of ``vectors`` (doc_id, blank, x) that aren't held out."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max(column).cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    one = vectors.where(~F.col("blank")).groupBy("doc_id").agg(F.min("x").alias("x"))
    return fit(written(one.join(known, "doc_id").select("doc_id", "label", "x"), "labelled"), counts)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    spark = docs.sparkSession
    vectors = written(docs.select("doc_id", F.col("text").isNull().alias("blank"), feature_udf(spark)("text").alias("x")), "vectors")
    model = train(vectors, labels)
    return (vectors.select("doc_id", _apply(spark, model.score)("x").alias("score"))
            .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
