"""Operators 1, 2 and 7 against brute force, with nulls, empty and long texts, ties and clashes."""

import hashlib
import random
import re
from collections import Counter

import pytest

from postlens.llm import decontam, ngram_join, substring_dedup

from .conftest import prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(3)
    base = prose(1, 300).split()
    out = [" ".join(base), None, "", "   \n\t", "one two three", "one two  three", prose(2, 20000)]
    for k in range(30):
        w = list(base)
        for _ in range(k % 6):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w[: len(w) - (k % 4) * 20]))
    passage = prose(5, 70)
    out += [prose(100 + k, 80) + "\n" + passage + " " + prose(200 + k, 60) for k in range(12)]
    out += ["Same Thing Again here and there é", "same thing again here and there é"] * 2
    out += ["la " * 120, "la " * 200]
    return out


def words(t):
    return [w.decode() for w in WORD.findall((t or "").encode())]


def brute_repeats(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is None:
            continue
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(frame):
    t = texts()
    ids = list(range(len(t)))
    random.Random(1).shuffle(ids)
    ids[8] = None
    ids[9] = ids[10]                                # one doc_id, two texts
    rows = list(zip(ids, t, strict=True)) + [(ids[12], t[12])]
    got = substring_dedup.remove_repeats(frame([x for _, x in rows], [i for i, _ in rows]))
    assert Counter(tuple(r) for r in got.collect()) == brute_repeats(rows)


@pytest.mark.parametrize("window", [8, 50])
def test_repeats_other_window(frame, window):
    t = texts()
    got = substring_dedup.remove_repeats(frame(t), window)
    assert Counter(tuple(r) for r in got.collect()) == brute_repeats(list(enumerate(t)), window)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return Counter(out)


def test_components_equal_brute_force(frame):
    t = texts()
    ids = [7 * k % 101 for k in range(len(t))]
    ids[8] = None
    rows = list(zip(ids, t, strict=True)) + [(ids[12], t[12]), (500, t[3])]
    got = ngram_join.link_components(frame([x for _, x in rows], [i for i, _ in rows])).drop("th")
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows)


def test_chain_of_near_copies_is_one_component(frame):
    """Neighbours link, the ends don't: the component joins them all."""
    w = prose(9, 200).split()
    t = [" ".join(w[8 * k:8 * k + 140]) for k in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(frame(t)).collect()}
    assert set(got.values()) == {0}


def test_keep_one_of_each_component(frame):
    t = texts()
    df = frame(t + [t[0]], list(range(len(t))) + [0])
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    comp = {i: c for i, n, c in brute_components(list(enumerate(t))) if n}
    blank = [i for i, x in enumerate(t) if not words(x)]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values()) | set(blank))


def norm(t):
    return [w.lower() for w in re.sub(rb"[!-/:-@\[-`{-~]", b"", (t or "").encode()).split()]


def grams(w):
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = norm(t)
        for i, x in items:
            it = norm(x)
            m = len(it)
            if not m or not w or (len(w) < m and m <= 5):
                continue
            b = grams(it)
            size = min(m, len(w))
            best = 0
            for s in range(len(w) - size + 1):
                part = w[s:s + size]
                a = Counter(tuple(part[k:k + min(5, m)]) for k in range(size - min(5, m) + 1))
                c = sum((a & b).values())
                best = max(best, c / (sum(a.values()) + sum(b.values()) - c))
            if best >= 0.75:
                out[d, i] = round(best, 9)
    return out


def test_leaks_equal_brute_force(spark, frame):
    items = [(k, prose(300 + k, 15 + 4 * k)) for k in range(10)] + [(10, "tiny item"), (11, None), (12, ""), (13, prose(300, 15))]
    long = items[9][1].split()
    changed = list(long)
    changed[25] = "other"
    docs = [prose(400, 50) + " " + items[3][1].upper() + "!! " + prose(401, 50), items[5][1], " ".join(long[:-4]),
            prose(402, 30) + "\n" + " ".join(changed) + " end", prose(403, 90), None, "", "a tiny, item b",
            prose(404, 5000) + " " + items[0][1], " ".join(long[:20])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontam.leaks(frame(docs), bench).collect()}
    assert got == brute_leaks(list(enumerate(docs)), items)
    assert (2, 9) in got and (3, 9) in got and (9, 9) not in got
    clean = decontam.without_leaks(frame(docs), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(range(len(docs))) - {d for d, _ in got})
    assert clean.columns == frame(docs).columns


def test_edge_pairs_beyond_the_radius(spark, frame):
    r = random.Random(9)
    items = [(k, " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(26 + 7 * (k % 5)))) for k in range(200)]
    docs = []
    for k, x in items:
        w = x.split()
        cut = (len(w) - 4) // 7                            # the window that is left has similarity of about 0.75
        part = w[cut:] if k % 2 else w[:-cut]
        docs.append(" ".join([prose(2 * k, 30), *part, prose(2 * k + 1, 30)]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.leaks(frame(docs), bench).collect()
    want = {}
    for k, d in enumerate(docs):
        want.update({(k, i): v for (_, i), v in brute_leaks([(k, d)], [items[k]]).items()})
    assert {(x["doc_id"], x["item_id"]): round(x["similarity"], 9) for x in rows} == want
    assert len(want) == len(items) and any(x["distance"] > decontam.RADIUS for x in rows)


def test_empty_tables(spark, frame):
    empty = frame([])
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert ngram_join.link_components(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0
    assert decontam.leaks(empty, bench).count() == 0
    assert decontam.leaks(frame(["a b c d e f g"]), bench.limit(0)).count() == 0


def test_probes_meet_all_within_the_radius_and_few_others(spark):
    r = random.Random(9)
    pairs = []
    for distance in list(range(decontam.RADIUS + 1)) * 20:
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), distance):
            b ^= 1 << bit
        pairs.append((a, b))
    far = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(3000)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(a), signed(b)) for k, (a, b) in enumerate(pairs + far)], "k long, a long, b long")
    x = df.select("k", decontam.blocks("a").alias("x"), decontam.probes("b").alias("y"))
    met = {row.k for row in x.where("arrays_overlap(x, y)").collect()}
    assert set(range(len(pairs))) <= met
    assert len(met) - len(pairs) < 3000 * 0.02


def test_filter_follows_the_benchmark():
    assert [decontam.filter_bits(n) for n in (0, 4096, 4097, 10**6, 10**9)] == [16, 16, 17, 24, 26]
