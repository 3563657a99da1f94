"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeats and clashes."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import periodic_runs, suffix_dedup, whitening
from postlens.llm.wordhash import mix

from .conftest import CLASH, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# ---- 11 -----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        return df.withColumns({c: F.lit(f"extra {c}") for c in [*CLASH, "x", "index", "whole", "component"]})
    return make


def test_whitening_equals_numpy(vectors):
    r = np.random.default_rng(3)
    some = r.normal(size=(300, 20)) * r.uniform(0.1, 3, 20) @ r.normal(size=(20, 20))
    rows = [(k, some[k % 250].tolist()) for k in range(300)]
    rows += [(None, some[0].tolist()), (7, some[1].tolist()), (900, None), (901, [1.0] * 19 + [None]), (902, [1.0] * 19 + [float("nan")]),
             (903, [1.0] * 19 + [float("-inf")]), (904, [1.0] * 5), (905, [])]
    got = whitening.whiten(vectors(rows)).collect()
    good = rows[:302]
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    y = ((n * x - s) / n) @ v[:, :16] / np.sqrt(e[:16])
    assert len(got) == len(good) * 16 and {g.n for g in got} == {n}
    assert max(g.identity_error for g in got) < 1e-9
    for g in got:
        assert g.explained == pytest.approx(e[g.component - 1] / e.sum(), rel=1e-9)
    want = Counter((i, int(d)) for (i, _), d in zip(good, ((n * x - s) ** 2).sum(1), strict=True))
    assert Counter((g.vec_id, g.deviation) for g in got if g.component == 1) == want
    own = {i: k for k, (i, _) in reversed(list(enumerate(good))) if i != 7}
    sign = {}
    for g in got:
        if g.vec_id in own:
            w = y[own[g.vec_id], g.component - 1]
            sign.setdefault(g.component, np.sign(w * g.whitened))
            assert g.whitened == pytest.approx(sign[g.component] * w, abs=1e-8)


def test_whitening_far_from_zero_keeps_its_digits(vectors):
    # spread of one unit at an offset of a million: products of uncentred sums would lose it
    rows = [(k, [k % 3 / 64, (k % 5) / 64, 0.0]) for k in range(15)]
    got = whitening.whiten(vectors(rows)).collect()
    assert {(g.component, round(g.eigenvalue, 12)) for g in got} == {(1, 2.0), (2, round(2 / 3, 12)), (3, 0.0)}
    assert all((g.whitened is None) == (g.component == 3) for g in got)
    assert max(g.identity_error for g in got) < 1e-12


def test_whitening_large_entries_take_decimals(vectors):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 3.0]), (3, [0.0, 1.0]), (4, [2e9, 2.0])]
    with pytest.raises(Exception, match="(?i)overflow|cast"):
        whitening.whiten(vectors([(i, [x * 64 for x in v]) for i, v in rows])).collect()
    small = [(i, [x / 1e4 for x in v]) for i, v in rows]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in small]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for (i, _), v in zip(small, x, strict=True)}
    assert {g.vec_id: g.deviation for g in whitening.whiten(vectors(small)).collect()} == want


def test_whitening_of_few_rows(vectors):
    assert whitening.whiten(vectors([])).collect() == []
    assert whitening.whiten(vectors([(1, None)])).collect() == []
    got = whitening.whiten(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in got] == [(1, 0, None, 0.0, None)] * 4


def test_products_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "COLUMNS", 3)
    r = np.random.default_rng(5)
    a = r.normal(size=(150, 7))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "row long, centred array<double>")
    m = whitening.block_matrix(rows, 150, 7)
    assert np.allclose(whitening.gram(m), a.T @ a)
    w = r.normal(size=(7, 2))
    got = whitening.multiply(m, whitening.local_blocks(spark, w, m.colsPerBlock), 1)
    assert np.allclose(got.toLocalMatrix().toArray(), a @ w)


# ---- 12 -----------------------------------------------------------------------------------------

def brute_strings(rows, w):
    count = Counter()
    rows = [(i, (t or "").encode()) for i, t in rows]
    for _, t in rows:
        count.update(t[p:p + w] for p in range(len(t) - w + 1))
    out = []
    for i, t in rows:
        edge = [0] * (len(t) + 1)
        for p in range(len(t) - w + 1):
            if count[t[p:p + w]] > 1:
                edge[p] += 1
                edge[p + w] -= 1
        gone = np.cumsum(edge[:-1]) > 0 if t else np.zeros(0, bool)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if t else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def string_texts():
    r = random.Random(5)
    base = " ".join(f"{w}é" for w in prose(1, 300).split())
    out = [base, None, "", " \n", "a" * 3000, "ab" * 700, "a" * 900, "é" * 700, "xyz" * 300 + prose(9, 100) + "xyz" * 300, prose(2, 15000)]
    for k in range(30):
        w = base.split()
        for _ in range(k % 5):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w[r.randrange(100):len(w) - r.randrange(60)]))
    passage = prose(7, 110)
    return out + [prose(100 + k, 80) + "\n" + passage + prose(200 + k, 50) for k in range(20)]


@pytest.mark.parametrize(("window", "cells"), [(400, 8192), (400, 3), (517, 2)])
def test_strings_equal_brute_force(frame, monkeypatch, window, cells):
    """With few cells a task, buckets are dealt to several tasks and merged."""
    monkeypatch.setattr(suffix_dedup.find_repeats, "__defaults__", (window, cells))
    t = string_texts()
    ids = list(range(len(t)))
    ids[4], ids[9] = None, ids[11]                  # no doc_id; one doc_id, two texts
    rows = list(zip(ids, t, strict=True)) + [(12, t[12])] * 3 + [(None, t[4])]
    got = suffix_dedup.digest(frame([x for _, x in rows], [i for i, _ in rows]), window)
    assert Counter(tuple(r) for r in got.collect()) == brute_strings(rows, window)


def test_string_spans_and_texts(frame):
    same = prose(3, 120)
    t = ["one " + same + " two", "three " + same, "short", None]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(t)).collect()}
    assert bytes(got[0].kept).decode() == "one  two" or len(got[0].kept) < 12
    for k, r in got.items():
        raw, cut = (t[k] or "").encode(), b""
        at = 0
        for s in r.spans:
            cut += raw[at:s.start]
            at = s.end
        assert bytes(r.kept) == cut + raw[at:]


def test_strings_of_empty_table(frame):
    assert suffix_dedup.digest(frame([])).collect() == []
    assert suffix_dedup.digest(frame([None, ""])).count() == 2


def test_many_equal_rows_stay_linear(frame):
    t = [prose(4, 150)] * 2000
    got = suffix_dedup.digest(frame(t, [1] * 2000)).select("n_bytes", "n_removed", "n_spans").distinct().collect()
    assert [tuple(r) for r in got] == [(len(t[0]), len(t[0]), 1)]


def test_windows_must_hold_the_ranked_bytes(frame):
    with pytest.raises(ValueError):
        suffix_dedup.digest(frame(["x"]), 100)


def test_cover_holds_every_distance():
    for m in (suffix_dedup, periodic_runs):
        assert {(a - b) % m.STEP for a in m.COVER for b in m.COVER} == set(range(m.STEP))


@pytest.mark.parametrize("most", [1 << 19, 200])
def test_suffixes_are_sorted(monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "RANGE", most)
    r = random.Random(2)
    base = bytes(r.choice(b"abcd") for _ in range(2500))
    parts = [b"a" * 600, b"ab" * 300, b"a" * 500 + b"b" * 100]
    for _ in range(30):
        s = r.randrange(1900)
        x = bytearray(base[s:s + r.randrange(400, 601)])
        if r.random() < 0.5:
            x[r.randrange(len(x))] = ord("z")
        parts.append(bytes(x))
    text, off = b"".join(parts), np.cumsum([0] + [len(p) for p in parts])
    starts = np.concatenate([np.arange(off[k], off[k + 1] - 399) for k in range(len(parts))])
    got = [(text[o:o + 400], bool(s)) for x in suffix_dedup.sorted_suffixes(np.frombuffer(text, np.uint8), starts) for o, s in zip(*x, strict=True)]
    want = sorted(text[s:s + 400] for s in starts)
    assert got == [(x, k > 0 and x == want[k - 1]) for k, x in enumerate(want)]


# ---- 13 -----------------------------------------------------------------------------------------

def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q - s), q)
    return sorted((s, size, q) for (s, size), q in out.items())


def brute_report(i, t):
    w = WORD.findall((t or "").encode())
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(), n)


def test_run_report_equals_brute_force(frame):
    r = random.Random(8)
    t = [None, "", " \t\n", "a", "a " * 5, "a " * 6, " a\n" * 700, "x y " * 300 + "z", prose(1, 4000), "é ü  " * 9 + " tail"]
    for k in range(300):
        n = r.choice([6, 7, 20, 60, 200])
        w = [r.choice("abc"[:r.randrange(1, 4)]) for _ in range(n)]
        if k % 2:
            p, s = r.randrange(1, n // 4 + 1), r.randrange(n // 2)
            for i in range(s + p, n):
                w[i] = w[i - p] if r.random() < 0.99 else "q"
        t.append("  ".join(w) + " " * r.randrange(2))
    t.append(" ".join((["a", "b"] * 40 + ["c"]) * 20))
    ids = [*range(len(t) - 2), None, 5]
    got = periodic_runs.run_report(frame(t, ids))
    assert Counter(tuple(x) for x in got.collect()) == Counter(brute_report(i, x) for i, x in zip(ids, t, strict=True))
    assert periodic_runs.run_report(frame([])).collect() == []


def test_runs_and_collapsed_texts(frame):
    got = periodic_runs.periodic_runs(frame(["start la la la la la la la end", "no repeat here", None])).collect()
    assert {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got} == {
        0: (9, [(1, 7, 1)], "start la end"), 1: (3, [], "no repeat here"), 2: (0, [], "")}


def test_extensions_equal_comparison():
    r = np.random.default_rng(1)
    v = mix(r.integers(0, 2, 700).astype(np.uint64))
    v[300:600] = v[0:300]
    v = np.append(v, mix(np.array([99], np.uint64)))
    e = periodic_runs.Extensions(v)
    i = r.integers(0, 690, 500)
    j = r.integers(0, 690, 500)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    i, j = np.append(i, 0), np.append(j, 300)

    def plain(a, b):
        n = 0
        while b + n < len(v) and v[a + n] == v[b + n]:
            n += 1
        return n
    assert e.lce(i, j).tolist() == [plain(a, b) for a, b in zip(i, j, strict=True)]
