"""Operators 3, 4, 5, 6, 8, 9 and 10."""

import datetime as dt
import hashlib
import random
import zlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from postlens.llm import html_lstm, mixing, pii_feistel, quality_bt, quality_llr, token_counts, toxicity_crf

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 3 -------------------------------------------------------------------------------------------

def water(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not full:
            goal.update({s: level * w[s] for s in open_})
            break
        for s in full:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            open_.discard(s)
    return goal


def test_mix(frame):
    r = random.Random(2)
    sources = [r.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"]) for _ in range(600)]
    t = [None if k % 97 == 0 else "" if k % 89 == 0 else prose(k, r.randrange(1, 60)) for k in range(600)]
    df = frame(t, sources=sources)
    rows = mixing.mix(df).collect()
    sizes = Counter()
    for s, x in zip(sources, t, strict=True):
        sizes[s] += len(WORD.findall(x or ""))
    goal = water(sizes)
    taken = defaultdict(int)
    for row in rows:
        s = sources[row["doc_id"]]
        assert row["size"] == len(WORD.findall(t[row["doc_id"]] or "")) and row["source_size"] == sizes[s]
        assert row["target"] == pytest.approx(goal[s])
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[s] += row["taken"]
    for s in goal:
        assert abs(taken[s] - goal[s]) < 0.25 * goal[s]
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, rows))
    copies = Counter(x["doc_id"] for x in mixing.emit(df).collect())
    assert all(copies[x["doc_id"]] * x["size"] == x["taken"] for x in rows)
    assert mixing.emit(df).columns == [*df.columns, "mix_copy"]
    assert mixing.mix(frame([])).count() == 0 and mixing.emit(frame([])).count() == 0
    assert [x["taken"] for x in mixing.mix(frame(["", None])).collect()] == [0, 0]


# --- 4, 8 and 9: learned verdicts -----------------------------------------------------------------

BAD = ["scum", "worthless", "idiot", "pathetic", "moron"]


@pytest.fixture(scope="module")
def corpus(frame, labels):
    r = random.Random(4)
    texts, marks = [], []
    for k in range(400):
        w = prose(k, r.randrange(60, 200), 400).split()
        toxic, junk = k % 5 == 0, k % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        if junk:
            w = [x + "%%%" for x in w]
        texts.append(" ".join(w))
        marks.append((k, int(not junk), int(toxic)))
    texts += [None, "", "x", prose(999, 20000, 400), " ".join(["la"] * 300)]
    return frame(texts).cache(), labels(marks + marks[:20]).cache(), texts, marks


def agreement(rows, marks, column):
    want = {m[0]: m[column] for m in marks}
    held = [r for r in rows if r["doc_id"] in want and r["held_out"]]
    assert len(held) > 50
    return sum(r["predicted"] == want[r["doc_id"]] for r in held) / len(held)


def test_quality(corpus, frame, labels):
    df, lab, texts, marks = corpus
    rows = quality_bt.quality(df, lab).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert agreement(rows, marks, 1) > 0.97
    assert quality_bt.quality(frame([]), lab).count() == 0
    assert [r["score"] for r in quality_bt.quality(frame(["a b"]), labels([])).collect()] == [pytest.approx(0.7)]


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    ids = list(range(16000))
    keep = [k for k in ids if zlib.crc32(str(k).encode()) % 4 != 2]
    feature = F.when(F.col("id") % 5 == 0, F.rand(3) - 0.5).otherwise(F.rand(4))
    rows = spark.range(len(ids)).select(F.col("id").alias("doc_id"), F.lit(False).alias("blank"), F.array(
        F.col("id").cast("double"), feature, *[F.lit(0.0)] * (quality_bt.FEATURES - 2)).alias("x"))
    lab = spark.range(len(ids)).select(F.col("id").alias("doc_id"), (F.col("id") % 5 > 0).cast("int").alias("quality"))
    m = quality_bt.train(rows, lab)
    assert m.mean[0] == pytest.approx(sum(keep) / len(keep), rel=1e-12)
    monkeypatch.setattr(quality_bt, "GROUP", 300)
    sizes = {0: sum(k % 5 == 0 for k in keep), 1: sum(k % 5 > 0 for k in keep)}
    dealt = quality_bt.parts(rows.where(F.col("doc_id").isin(keep)).join(lab, "doc_id").withColumnRenamed("quality", "label"), sizes).collect()
    seen = [(r["x"][k * quality_bt.FEATURES], y) for r in dealt for k, y in enumerate(r["label"])]
    assert {int(k) for k, _ in seen} == set(keep) and sum(y for _, y in seen) == sizes[1]
    assert all(0 < sum(r["label"]) < len(r["label"]) <= 1000 for r in dealt)


def test_quantiles_are_exact(spark):
    r = random.Random(5)
    rows = [(r.randrange(2), r.choice([r.gauss(0, 1), 0.25, 1e9])) for _ in range(3000)]
    weight, at = {0: 0.3, 1: 1.7}, [0.0, 0.2, 0.5, 0.77, 1.0]
    order = sorted(rows, key=lambda x: x[1])
    mass, total = 0.0, sum(weight[y] for y, _ in rows)
    want = [None] * len(at)
    for y, u in order:
        mass += weight[y]
        want = [u if v is None and mass >= q * total * (1 - 1e-12) else v for v, q in zip(want, at, strict=True)]
    assert quality_bt.quantiles(spark.createDataFrame(rows, "label int, u double"), weight, at) == want


def test_toxicity(corpus, frame, labels):
    df, lab, texts, marks = corpus
    rows = toxicity_crf.toxicity(df, lab).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert agreement(rows, marks, 2) > 0.97
    found = Counter()
    for r in rows:
        for s in r["spans"]:
            found[re.sub(r"\W", "", texts[r["doc_id"]][s["start"]:s["end"]]) in BAD] += 1
    assert found[True] > 10 * found[False]
    clean = toxicity_crf.keep_clean(df, lab)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in rows if not r["predicted"]}
    assert toxicity_crf.toxicity(frame([]), lab).count() == 0
    assert {r["score"] for r in toxicity_crf.toxicity(frame(["a", None]), labels([])).collect()} == {0.0}


def test_chain_equals_enumeration():
    import itertools

    import numpy as np
    r = np.random.RandomState(1)
    n = 9
    e, first = r.normal(0, 2, n), np.zeros(n, bool)
    first[[0, 4]] = True
    trans, start = r.rand(2, 2) + 0.1, np.array([0.7, 0.3])
    total, hot = 0.0, np.zeros(n)
    for y in itertools.product([0, 1], repeat=n):
        p = 1.0
        for t in range(n):
            p *= (start[y[t]] if first[t] else trans[y[t - 1], y[t]]) * np.exp(e[t] * y[t])
        total += p
        hot += p * np.array(y)
    assert toxicity_crf.marginals(e, first, trans, start) == pytest.approx(hot / total)
    long = r.normal(0, 2, 3000)
    f = np.zeros(3000, bool)
    f[[0, 1500]] = True
    whole = toxicity_crf.marginals(long, f, trans, start)
    assert whole[1500:] == pytest.approx(toxicity_crf.marginals(long[1500:], f[1500:], trans, start))


def base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if at[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(corpus, frame, labels):
    df, lab, texts, marks = corpus
    rows = {r["doc_id"]: r for r in quality_llr.judge(df, lab).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    judged = [(rows[k]["kept"], q) for k, q, _ in marks if not rows[k]["base_failed"]]
    assert sum(a == bool(b) for a, b in judged) / len(judged) > 0.97
    # the ratio, by hand
    trusted = {r["_id"]: r["trusted"] for r in quality_llr.trusted_ids(lab).collect()}

    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % quality_llr.BUCKETS
    raw, target, own = Counter(), Counter(), {}
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        own[k] = [h(x) for x in w] + [h(a, b) for a, b in zip(w, w[1:])]
        raw.update(own[k])
        if trusted.get(k) == 1:
            target.update(own[k])
    scale = sum(target.values()) / sum(raw.values())
    import math
    for k, grams in own.items():
        want = sum(math.log(target[g] + 2) - math.log(raw[g] * scale + 2) for g in grams) / len(grams) if grams else 0
        assert rows[k]["ratio"] == pytest.approx(want, abs=1e-9)
    assert quality_llr.judge(frame([]), lab).count() == 0
    assert [r["kept"] for r in quality_llr.judge(frame([prose(1, 80)]), labels([])).collect()] == [True]


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "x\n\nx\n x\nx", "a b c d a b c e b c e", " \n", "é|<é é|<é é|<é é"])
def test_base_counts(frame, labels, text):
    r = quality_llr.judge(frame([text]), labels([])).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(text)


def test_ngrams_are_counted_one_by_one(spark, frame, labels):
    n = 6000                                               # more trusted rows and more n-grams than fixed bounds held
    lab = labels([(k, 1, 0) for k in range(n)])
    ids = {r["_id"]: r["trusted"] for r in quality_llr.trusted_ids(lab).collect()}
    assert len(ids) > 4400 and set(ids.values()) == {1, 2}
    assert quality_llr.trusted_ids(labels([(k, 1, 0) for k in range(8 * n)])).count() > 35000
    docs = frame([" ".join(f"v{k}x{j}" for j in range(12)) + " same" for k in range(n)], clash=False)
    rows = quality_llr.counts(docs, quality_llr.trusted_ids(lab)).collect()
    assert len(rows) == n * 24 + 1                         # 12 words and 12 pairs of their own, one word of all
    assert [(r["raw"], r["target"]) for r in rows if r["gram"] is not None] == [(n, sum(t == 1 for t in ids.values()))]


def test_ngrams_move_once_and_whole(spark, frame, labels, monkeypatch):
    texts = [" ".join(f"v{(k * j) % 97}" for j in range(60)) + " the same end" for k in range(40)] + ["", None, "one", "the same end"] * 2
    docs, lab = frame(texts, ids=[*range(40), *range(40, 44), *range(40, 44)]), labels([(k, int(k % 3 > 0), 0) for k in range(44)])
    words = quality_llr._words(docs.withColumn("t", F.lit(1)), "t")
    want = Counter()
    for t in texts:
        w = WORD.findall(t or "")
        want.update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    hashes = {r["g"]: r["h"] for r in spark.createDataFrame([(g,) for g in want], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    for hot, shares in (([], 16), (["the", "same end"], 64)):
        rows = quality_llr.postings(words, hot, shares).collect()
        assert Counter(g for r in rows for g in r["grams"]) == Counter({hashes[g]: n for g, n in want.items() if g not in hot})
        assert len({(r["share"], tuple(r["grams"])) for r in rows}) <= shares * len(set(texts))
        assert all(r["share"] == (g + (1 << 63)) * shares >> 64 for r in rows for g in r["grams"])
    # the same ratios however many n-grams are looked up by a broadcast, and in however many shares
    ratios = []
    for some, most, each in ((1 << 30, 1 << 17, 1 << 28), (1, 1 << 17, 1 << 28), (1, 9, 64)):
        monkeypatch.setattr(quality_llr, "SOME", some)
        monkeypatch.setattr(quality_llr, "HOT", most)
        monkeypatch.setattr(quality_llr, "EACH", each)
        ratios.append(sorted((r["doc_id"], r["ratio"]) for r in quality_llr.judge(docs, lab).collect()))
    assert len(ratios[0]) == len(texts) and any(r for _, r in ratios[0])
    for other in ratios[1:]:
        assert [k for k, _ in other] == [k for k, _ in ratios[0]]
        assert [r for _, r in other] == pytest.approx([r for _, r in ratios[0]], abs=1e-9)


# --- 5 -------------------------------------------------------------------------------------------

def luhn(s):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def valid_card(r):
    p = "".join(str(r.randrange(10)) for _ in range(15))
    return next(p + str(k) for k in range(10) if luhn(p + str(k)))


def test_pseudonyms(frame):
    r = random.Random(5)
    cards = [valid_card(r) for _ in range(40)]
    t = [f"pay {c} or +1 (212) 555-{k:04d}, ip 10.20.{k}.7; mail ann.{k}@mail.example.com. Born 1987-03-{k % 28 + 1:02d}" for k, c in enumerate(cards)]
    t += [f"again {cards[0]} and 10.20.0.7", None, "", "no data", "1234567890123456 is no card, 300.1.1.1 no address, 2023-02-31 no date, 000-12-3456",
          "078-05-1120 / 3/4/1990, 31.12.1999 and 12/31/1999", 'token = "' + "0f" * 20 + '"', "4111 1111 1111 1111", "ends 10.0.0.1"]
    out = {x["doc_id"]: x for x in pii_feistel.find_and_replace(frame(t)).collect()}
    new_cards = []
    for k in range(40):
        m = re.fullmatch(r"pay (\d{16}) or \+1 \(\d{3}\) \d{3}-\d{4}, ip (\S+); mail (\S+@example\.invalid)\. Born (\d{4}-\d\d-\d\d)", out[k]["text"])
        assert m and luhn(m[1]) and all(0 <= int(o) <= 255 for o in m[2].split(".")) and out[k]["n_replaced"] == 5
        dt.date.fromisoformat(m[4])
        new_cards.append(m[1])
    assert len(set(new_cards)) == 40 and not set(new_cards) & set(cards)
    ip0 = re.search(r"ip (\S+);", out[0]["text"])[1]
    assert out[40]["text"] == f"again {new_cards[0]} and {ip0}"
    assert out[41]["text"] is None and out[41]["n_replaced"] == 0 and out[42]["text"] == "" and out[43]["text"] == "no data"
    assert out[44]["text"] == t[44] and out[44]["n_replaced"] == 0
    m = re.fullmatch(r"(\d{3}-\d\d-\d{4}) / (\d+/\d+/\d{4}), (\d\d\.\d\d\.\d{4}) and (\d\d/\d\d/\d{4})", out[45]["text"])
    assert m and out[45]["n_replaced"] == 4 and dt.datetime.strptime(m[3], "%d.%m.%Y") and dt.datetime.strptime(m[4], "%m/%d/%Y")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[46]["text"]) and out[46]["text"] != t[46]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", out[47]["text"]) and luhn(out[47]["text"].replace(" ", ""))
    other = {x["doc_id"]: x["text"] for x in pii_feistel.find_and_replace(frame(t), key="another").collect()}
    assert other[0] != out[0]["text"]
    kept = pii_feistel.pseudonymise(frame(t))
    assert kept.columns == frame(t).columns
    assert all(x["text"] == out[x["doc_id"]]["text"] and x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in kept.collect())
    assert pii_feistel.find_and_replace(frame([])).count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(271 * 271)
    f = pii_feistel.feistel(F.floor(F.col("id") / 271), F.col("id") % 271, F.lit(271), F.lit(271), "k", F.lit("t"))
    assert df.select((f["l"] * 271 + f["r"]).alias("x")).distinct().where("x between 0 and 73440").count() == 271 * 271
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert d.select(pii_feistel.permute_digits(F.col("d"), "k", "x").alias("p")).distinct().where("length(p) = 3").count() == 1000


# --- 6 -------------------------------------------------------------------------------------------

def page(k, body):
    nav = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in prose(k, 6).split())
    return (f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav>'
            f'<!-- ad --><div class="ad">{prose(k + 1, 9)}</div><article>{body}</article><form><input><button>Send</button></form>'
            f'<div class="comments"><p>{prose(k + 2, 12)}</p></div><footer>&copy; {prose(k + 3, 5)}</footer></body></html>')


def test_pages(spark):
    bodies = [f"<h1>Head {k}</h1>" + "".join(f"<p>{prose(50 * k + j, 30)} &amp; x<b>y</b>z\n  end<br>line" + "</p>" * (j % 2) for j in range(4)) for k in range(40)]
    rows = [(k, f"u{k}", page(k, b)) for k, b in enumerate(bodies)] + [(100, "n", None), (101, None, ""), (102, "x", "<p"), (3, "u3", page(3, bodies[3]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    out = html_lstm.extract(df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    for k in range(40):
        want = " ".join([f"Head {k}"] + [f"{prose(50 * k + j, 30)} & xyz end line" for j in range(4)])
        assert by[k]["text"] == want and by[k]["n_chars"] == len(want)
    assert all(by[k]["text"] == "" and by[k]["n_chars"] == 0 for k in (100, 101, 102))
    assert html_lstm.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("start", ["<head><title>T</title>", "<head><title>T", "<title>T<body>", "<head><meta charset=x><header><p>top</p></header>",
                                   "<body><select><option>", "<body><noscript>", "<body><object data=x>", "<body><svg><path d=x>", "<body><iframe src=x>",
                                   "<body><svg/>", "<body><noscript><p>top</p><svg><g></svg>", "<body><svg><svg></svg><text>T</text></svg>",
                                   "<head><script>if (a<b && c=='\"') x();</script></head>", "<head><style>T</styles></style >", "\u0130\u0130<title>T</title>"])
def test_missing_end_tags(start):
    got = [b.text for b in html_lstm.blocks(f"<html>{start}<article><h1>One</h1><p>two 'x</article><noscript>no</noscript><p>end")]
    assert got[-3:] == ["One", "two 'x", "end"] and "T" not in got and "no" not in got


@pytest.mark.parametrize("part, aside", [("p.lead", False), ("div.thread", False), ("div#download", False), ("div.ad", True), ("div.top-ad", True),
                                         ("ul#siteNav", True), ("div.page_footer", True), ("div.Ads", True), ("div.adBanner", True), ("div.x.ads", True)])
def test_names_of_asides(part, aside):
    path = None
    for name in ("", "html", "article", part):
        path = html_lstm.Path(path, name)
    assert path.names() == ("html", "article", part)
    assert html_lstm.label(html_lstm.Block(path, "x", 0)) == (not aside)


def test_gradient():
    import numpy as np
    r = np.random.RandomState(0)
    net = html_lstm.Labeller()
    x, mask = html_lstm.padded([r.normal(size=(4, html_lstm.INPUT)), r.normal(size=(2, html_lstm.INPUT))])
    y = r.randint(0, 2, mask.shape).astype(float)

    def loss():
        p = net.forward(x, mask)[0]
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()
    g = net.gradient(x, mask, y)
    for k in net.p:
        for _ in range(4):
            at = tuple(r.randint(s) for s in net.p[k].shape)
            keep = net.p[k][at]
            net.p[k][at] = keep + 1e-5
            up = loss()
            net.p[k][at] = keep - 1e-5
            down = loss()
            net.p[k][at] = keep
            assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# --- 10 ------------------------------------------------------------------------------------------

def edited(t, edits):
    right = len(t)
    for s, e, new in sorted(edits, key=lambda x: x[0])[::-1]:
        t, right = t[:s] + new + t[min(e, right):], s
    return t


def test_edits_equal_full_encoding():
    enc = token_counts.encoder(open(token_counts.RANKS, "rb").read())
    r = random.Random(6)
    for k in range(60):
        t = re.sub("w1", "  ", prose(k, r.randrange(0, 900))) + "\n" * (k % 3) + "it's 1234567890 é 漢字"
        points = sorted(r.randrange(len(t) + 1) for _ in range(2 * r.randrange(1, 8)))
        edits = [(a, b, r.choice(["", " ", "\n", "abc  ", " x", "!!", "é" * 3])) for a, b in zip(points[::2], points[1::2])]
        tree = token_counts.Tree(t, enc)
        assert tree.total == len(enc.encode_ordinary(t)) and "".join(token_counts.leaves(t)) == t
        tree = token_counts.Tree(t, enc, tree.state())
        assert tree.encoded == 0
        tree.apply(edits)
        assert tree.text() == edited(t, edits)
        assert tree.total == len(enc.encode_ordinary(tree.text()))
    t = prose(1, 20000)
    tree = token_counts.Tree(t, enc)
    tree.encoded = 0
    tree.apply([(50000, 50003, "new")])
    assert 0 < tree.encoded < 5 * token_counts.LEAF


def test_token_counts(spark, frame):
    enc = token_counts.encoder(open(token_counts.RANKS, "rb").read())
    t = ["a line\nother\na line\ncall 5551234567", None, "", prose(3, 5000), "x"]
    out = {r["doc_id"]: r for r in token_counts.edited_counts(frame(t)).collect()}
    for k, x in enumerate(t):
        want = edited(x or "", token_counts.cleaning_edits(x or ""))
        assert (out[k]["n_tokens"], out[k]["n_tokens_edited"]) == (len(enc.encode_ordinary(x or "")), len(enc.encode_ordinary(want)))
    assert out[0]["n_edits"] == 2
    df = spark.createDataFrame([(1, "hello there world", [(6, 11, "big"), (None, 3, "x"), (9, 2, "y"), None, (90, 99, None)]), (2, None, None), (3, "", [(0, 0, "new text")])],
                               "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    out = {r["doc_id"]: r["n_tokens_edited"] for r in token_counts.edited_counts(df).collect()}
    assert out == {1: len(enc.encode_ordinary("hello big world")), 2: 0, 3: len(enc.encode_ordinary("new text"))}
    assert token_counts.edited_counts(frame([])).count() == 0


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>x" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "<title " * 100_000, "<!-- >" * 150_000,
                                  '<a b="' * 100_000 + ">", '<a ">" ' * 100_000, "<script>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000])
def test_broken_pages_take_time_by_their_length(page):
    import time
    begin = time.time()
    html_lstm.vectors([html_lstm.blocks(page)])
    assert time.time() - begin < 10


def test_tags_end_outside_quotes():
    got = [b.text for b in html_lstm.blocks("<p title='a > b'>one<p title=\"x>two<p>three < four<p five")]
    assert got == ["one", "two", "three < four<p five"]


def test_pages_without_article_or_main(spark):
    """Nothing says what the text is: length, links and the names of sections teach."""
    words = "plain words that say something about the matter at hand and go on for a while"
    rows = [(k, "u", f"<body><div class='menu'><a href=a>Home</a> <a href=b>News {k}</a></div><div><p>{words} {k}.</p><p>{words} again, {k}.</p></div>"
             f"<div class='footer'>Imprint {k}</div></body>") for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_lstm.extract(df).collect():
        assert r.text == f"{words} {r.page_id}. {words} again, {r.page_id}."


def test_kept_trees_are_edited_again(spark, frame):
    """The second edit starts from the tree that the first left; only touched leaves are encoded."""
    enc = token_counts.encoder(open(token_counts.RANKS, "rb").read())
    line = prose(8, 4000)
    t = [f"{line}\n{prose(9, 50)} \n\n\n\n{prose(9, 50)}\nend", None, "x \n\n \n\ny"]
    for r in token_counts.edited_counts(frame(t)).collect():
        once = edited(t[r.doc_id] or "", token_counts.cleaning_edits(t[r.doc_id] or ""))
        twice = edited(once, token_counts.blank_edits(once))
        assert (r.n_tokens_edited, r.n_tokens_later) == (len(enc.encode_ordinary(once)), len(enc.encode_ordinary(twice)))
        assert r.n_encoded_later < 8 * token_counts.LEAF
    trees = token_counts.with_trees(spark.createDataFrame([(1, "a b " * 500, [(3, 4, "new")])], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>"))
    e = token_counts.edited(trees).select("edited.*").first()
    want = "a bnew" + ("a b " * 500)[4:]
    assert e.text == want and e.n_tokens == len(enc.encode_ordinary(want)) == sum(e.counts) and sum(e.lengths) == len(want)
    assert 0 < e.n_encoded < 4 * token_counts.LEAF


def test_texts_without_spaces_are_cut():
    enc = token_counts.encoder(open(token_counts.RANKS, "rb").read())
    t = "你好，世界。x1" * 4000
    tree = token_counts.Tree(t, enc)
    assert max(map(len, tree.leaves)) < 2 * token_counts.LEAF and tree.total == len(enc.encode_ordinary(t))
    tree.encoded = 0
    tree.apply([(9000, 9004, "'s ok")])
    assert tree.total == len(enc.encode_ordinary(tree.text())) and tree.encoded < 6 * token_counts.LEAF


def test_leaves_are_cut_where_tokens_end():
    enc = token_counts.encoder(open(token_counts.RANKS, "rb").read())
    r = random.Random(3)
    for _ in range(2000):
        t = "".join(r.choice("ab2Z 1.,!'’\"-_ \n\t你，。ñ$# 's 'll") for _ in range(r.randrange(50)))
        cut = token_counts.leaves(t, r.choice([1, 2, 5]))
        assert "".join(cut) == t and sum(token_counts.count(enc, x) for x in cut) == token_counts.count(enc, t)
