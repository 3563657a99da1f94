"""Toxicity by a linear-chain conditional random field over the words of whole texts.

Two states, clean and toxic.  A word's emission is the sum of hashed weights of the word and of its
first 4, 5 and 6 bytes (ASCII lower case, ASCII punctuation left out); transitions tie neighbours.
The tables hold labels of documents, not of words, so training words are labelled first: in toxic
documents, a word is toxic where one of its features occurs in far more toxic than clean documents
of the sample (by document counts, near copies left out).  The field is trained on these words by
gradient ascent on the conditional likelihood (forward-backward in numpy).  Forward-backward
marginals of every word give a document's score (logistic in the strongest word and in the expected
number of toxic words, fitted on a part of the sample that the field has not seen) and the character
offsets of its toxic words.

Learning uses at most ``SAMPLE`` labelled documents of each label (``jobs.labelled_sample``); the
model has a fixed size (2**20 weights).  Scoring is one pass without a shuffle, over whole texts.

Forward-backward runs over a whole piece of documents at once: the step into a document's first word
doesn't depend on the word before, so documents don't touch; the chain is laid out in rows, the
2 x 2 products of the rows are chained, and all rows are then run side by side.  The result is the
exact one for each document, however long.

Defined cases: a text without words (null, empty) has no spans and the score of a document with no
toxic word; without labels of both kinds every score is 0; rows that repeat are scored alike; an
empty table gives an empty result; all columns of the input are kept by ``with_scores``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from postlens.llm.jobs import arrow_job, held_out, labelled_sample
from postlens.llm.wordhash import U, Piece, mix, word_pieces
from postlens.session import ship

SAMPLE = 1800                      # labelled documents of each label that the model learns from
BITS = 20                          # weights
PREFIXES = [4, 5, 6]
THRESHOLD = 0.3
STEPS = 25
ROW = 256                          # words in a row of the layout
MIN_DOCS, MIN_RATIO = 4, 40.0      # a feature marks a word: so many toxic documents, so much more often


def features(p: Piece) -> np.ndarray:
    """(words, 4) places in the weight table."""
    columns = [p.hash, *p.prefix_hashes(PREFIXES)]
    salt = [U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(len(columns))]
    return np.stack([((h ^ s) * U(0xFF51AFD7ED558CCD) >> U(64 - BITS)).astype(np.int32) for h, s in zip(columns, salt, strict=True)], 1)


def chain(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Forward and backward vectors (words, 2), scaled to sum 1, of a run of documents.

    ``first`` marks each document's first word.  The step into word t multiplies by
    M[i, j] = step[i, j] * exp(emission if j == 1), where step is ``start`` at a first word.
    """
    n = len(emission)
    rows = -(-n // ROW)
    hot = np.exp(np.clip(emission, -30, 30))
    # scaled so that the larger factor of a step is 1
    a, b = 1 / np.maximum(hot, 1), hot / np.maximum(hot, 1)
    step = np.empty((rows * ROW, 2, 2))
    step[:n] = np.where(first[:, None, None], start[None, None, :], trans[None])
    step[:n, :, 0] *= a[:, None]
    step[:n, :, 1] *= b[:, None]
    step[n:] = np.eye(2)
    step = step.reshape(rows, ROW, 2, 2)
    whole = np.broadcast_to(np.eye(2), (rows, 2, 2))
    for t in range(ROW):
        whole = whole @ step[:, t]
        if t % 16 == 15:
            whole = whole / whole.sum((1, 2), keepdims=True)
    into, back = np.empty((rows, 2)), np.empty((rows, 2))
    v = np.array([0.5, 0.5])
    for r in range(rows):
        into[r] = v
        v = v @ whole[r]
        v = v / v.sum()
    v = np.array([0.5, 0.5])
    for r in range(rows - 1, -1, -1):
        back[r] = v
        v = whole[r] @ v
        v = v / v.sum()
    alpha, beta = np.empty((rows, ROW, 2)), np.empty((rows, ROW, 2))
    v = into
    for t in range(ROW):
        s = step[:, t]
        v = np.stack([v[:, 0] * s[:, 0, 0] + v[:, 1] * s[:, 1, 0], v[:, 0] * s[:, 0, 1] + v[:, 1] * s[:, 1, 1]], 1)
        v /= v.sum(1, keepdims=True)
        alpha[:, t] = v
    v = back
    for t in range(ROW - 1, -1, -1):
        beta[:, t] = v
        s = step[:, t]
        v = np.stack([s[:, 0, 0] * v[:, 0] + s[:, 0, 1] * v[:, 1], s[:, 1, 0] * v[:, 0] + s[:, 1, 1] * v[:, 1]], 1)
        v /= v.sum(1, keepdims=True)
    return alpha.reshape(-1, 2)[:n], beta.reshape(-1, 2)[:n], step.reshape(-1, 2, 2)[:n]


def marginals(emission, first, trans, start) -> np.ndarray:
    """P(word is toxic) of every word."""
    if not len(emission):
        return np.zeros(0)
    alpha, beta, _ = chain(emission, first, trans, start)
    both = alpha * beta
    return both[:, 1] / both.sum(1)


class Model:
    """weights (2**BITS float32), trans and start (factors), calibration (3) and prior."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.bias = -6.0
        self.trans = np.array([[0.95, 0.05], [0.9, 0.1]])
        self.start = np.array([0.95, 0.05])
        self.calibration = None

    def words(self, p: Piece) -> np.ndarray:
        e = self.weights[features(p)].sum(1, dtype=np.float64) + self.bias
        first = np.zeros(len(e), bool)
        first[p.bounds[:-1][np.diff(p.bounds) > 0]] = True
        return marginals(e, first, self.trans, self.start)

    def summary(self, m: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(documents, 3): 1, log-odds of the strongest word, log of 1 + expected toxic words."""
        n = np.diff(bounds)
        total = np.concatenate([[0], np.cumsum(m)])
        out = np.zeros((len(n), 3))
        out[:, 0] = 1
        top = np.full(len(n), 1e-6)
        some = n > 0
        if some.any():
            top[some] = np.clip(np.maximum.reduceat(m, bounds[:-1][some]), 1e-6, 1 - 1e-6)
        out[:, 1] = np.log(top / (1 - top))
        out[:, 2] = np.log1p(np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0))
        return out

    def score(self, m, bounds) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(self.summary(m, bounds) @ self.calibration, -30, 30)))


def _sample_features(batches):
    for batch in batches:
        ids, label, f = [], [], []
        docs = batch.column("doc_id").to_pylist()
        labels = batch.column("label").to_pylist()
        for p in word_pieces(batch.column("text"), lower=True, strip=True):
            own = features(p)
            for k in range(p.docs):
                ids.append(docs[p.row + k])
                label.append(labels[p.row + k])
                f.append(own[p.bounds[k]:p.bounds[k + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(f, pa.binary())],
                                         ["doc_id", "label", "f"])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = SAMPLE) -> Model:
    sample, counts = labelled_sample(docs, labels, column, per_class)
    rows = sorted(arrow_job(sample, _sample_features, "doc_id long, label int, f binary").collect(),
                  key=lambda r: (r["doc_id"], bytes(r["f"])))
    data = [(r["label"], np.frombuffer(r["f"], np.int32).reshape(-1, 1 + len(PREFIXES))) for r in rows if len(r["f"])]
    del rows
    return fit(without_copies(data), counts)


def without_copies(data: list, hashes: int = 16, alike: int = 8) -> list:
    """The sample without near copies, whose shared words would count as evidence again and again: a
    text goes if half of its minimum hashes of words equal those of an earlier text."""
    odd = (np.arange(hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    where: dict[tuple[int, int], list[int]] = {}
    out = []
    for label, f in data:
        low = mix(np.unique(f[:, 0]).astype(np.uint64)[:, None] * odd[None, :]).min(0)
        met: dict[int, int] = {}
        for k, v in enumerate(low.tolist()):
            for d in where.get((k, v), ()):
                met[d] = met.get(d, 0) + 1
        if max(met.values(), default=0) < alike:
            for k, v in enumerate(low.tolist()):
                where.setdefault((k, v), []).append(len(out))
            out.append((label, f))
    return out


def _groups(data: list, words: int = 100_000):
    """Runs of documents of about so many words: what training holds in memory at once."""
    group, n = [], 0
    for d in data:
        group.append(d)
        n += len(d[1])
        if n >= words:
            yield group
            group, n = [], 0
    if group:
        yield group


def _piece(group: list, marked: np.ndarray) -> tuple:
    """Features, first words, truth, and the counts of pairs, first words and toxic words in it."""
    f = np.concatenate([x for _, x in group])
    sizes = np.array([len(x) for _, x in group])
    first = np.zeros(len(f), bool)
    first[np.cumsum(sizes) - sizes] = True
    truth = (marked[f].any(1) & np.repeat(np.array([d[0] for d in group]) == 1, sizes)).astype(float)
    same = ~first[1:]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (truth[:-1][same].astype(int), truth[1:][same].astype(int)), 1)
    return f, first, truth, pairs, np.array([(1 - truth[first]).sum(), truth[first].sum()]), truth.sum()


def fit(data: list[tuple[int, np.ndarray]], counts: dict[int, int]) -> Model:
    """data: (label, features of the words) of distinct texts; counts: documents of each label."""
    model = Model()
    y = np.array([label for label, _ in data])
    if not (y == 1).any() or not (y == 0).any():
        return model
    df = np.zeros((2, 1 << BITS))
    for label, f in data:
        df[label, np.unique(f)] += 1
    ratio = ((df[1] + 0.5) / (y == 1).sum()) / ((df[0] + 0.5) / (y == 0).sum())
    marked = (df[1] >= min(MIN_DOCS, max(1, (y == 1).sum() // 20))) & (ratio >= MIN_RATIO)

    part = np.arange(len(data)) % 3
    pieces = [_piece(group, marked) for group in _groups([d for d, k in zip(data, part, strict=True) if k])]
    pair_truth, start_truth, words_truth = (sum(p[k] for p in pieces) for k in (3, 4, 5))
    w = np.zeros(1 << BITS)
    speed = np.full(1 << BITS, 1e-8)
    logt, logs, bias = np.log(model.trans), np.log(model.start), model.bias
    for _ in range(STEPS):
        grad, pair, first_words, words = -0.02 * w, np.zeros((2, 2)), np.zeros(2), 0.0
        for f, first, truth, *_ in pieces:
            alpha, beta, step = chain(w[f].sum(1) + bias, first, np.exp(logt), np.exp(logs))
            both = alpha * beta
            m = both[:, 1] / both.sum(1)
            grad += np.bincount(f.ravel(), np.repeat(truth - m, f.shape[1]), minlength=1 << BITS)
            two = alpha[:-1, :, None] * step[1:] * beta[1:, None, :]
            pair += (two / two.sum((1, 2), keepdims=True))[~first[1:]].sum(0)
            first_words += [(1 - m[first]).sum(), m[first].sum()]
            words += m.sum()
        speed += grad * grad
        w += 0.7 * grad / np.sqrt(speed)
        logt += 0.3 * np.clip((pair_truth - pair) / np.maximum(pair_truth + pair, 10), -1, 1)
        logs += 0.3 * np.clip((start_truth - first_words) / np.maximum(start_truth + first_words, 10), -1, 1)
        bias += 0.3 * np.clip((words_truth - words) / max(words_truth + words, 10), -1, 1)
    model.weights, model.bias = w.astype(np.float32), float(bias)
    model.trans, model.start = np.exp(logt), np.exp(logs)

    rest = [d for d, k in zip(data, part, strict=True) if not k] or data
    x = []
    for group in _groups(rest):
        f = np.concatenate([x for _, x in group])
        bounds = np.concatenate([[0], np.cumsum([len(x) for _, x in group])])
        first = np.zeros(len(f), bool)
        first[bounds[:-1]] = True
        e = model.weights[f].sum(1, dtype=np.float64) + model.bias
        x.append(model.summary(marginals(e, first, model.trans, model.start), bounds))
    x = np.concatenate(x)
    t = np.array([d[0] for d in rest])
    share = np.array([counts.get(k, 1) / max((t == k).sum(), 1) for k in (0, 1)])
    model.calibration = _logistic(x, t, share[t])
    return model


def _logistic(x, t, weight, ridge=1e-2, steps=60):
    weight = weight / weight.mean()
    c = np.zeros(x.shape[1])
    for _ in range(steps):                          # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(c)) * len(t) / 100
        g = x.T @ (weight * (t - p)) - ridge * c * len(t) / 100
        d = np.linalg.solve(h, g)
        c = c + np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-6:
            break
    return c


def score_udf(spark, model: Model):
    ship(spark)
    held = spark.sparkContext.broadcast(model)      # 4 MB

    @arrow_udf("struct<score:double,spans:array<struct<start:int,end:int>>>")
    def score(text: pa.Array) -> pa.Array:
        m, scores, count, begin, end = held.value, [], [], [], []
        for p in word_pieces(text, lower=True, strip=True):
            prob = m.words(p)
            scores.append(m.score(prob, p.bounds))
            bad = np.flatnonzero(prob >= 0.5)
            a, b = p.char_offsets(bad)
            begin.append(a)
            end.append(b)
            count.append(np.histogram(bad, p.bounds)[0] if len(bad) else np.zeros(p.docs, int))
        if not scores:
            count, scores, begin, end = [[]], [[]], [[]], [[]]
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(begin).astype(np.int32)),
                                            pa.array(np.concatenate(end).astype(np.int32))], ["start", "end"])
        off = np.concatenate([[0], np.cumsum(np.concatenate(count))]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores).astype(float)),
                                           pa.ListArray.from_arrays(pa.array(off), spans)], ["score", "spans"])
    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (characters of toxic words) for each row."""
    model = train(docs, labels)
    return (docs.select("doc_id", score_udf(docs.sparkSession, model)("text").alias("r"))
            .select("doc_id", held_out("doc_id").alias("held_out"), "r.score",
                    (F.col("r.score") >= THRESHOLD).cast("int").alias("predicted"), "r.spans"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows predicted toxic."""
    model = train(docs, labels)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                         score_udf(docs.sparkSession, model)(docs["text"]).alias("r"))
    return packed.where(F.col("r.score") < THRESHOLD).select("row.*")
