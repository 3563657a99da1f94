"""Maximal periodic runs of words in each document, and the text without their repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that
no neighbouring word extends, of at least ``POWER`` periods and ``LEAST`` words.

*Harmonic grid.*  A run of 4q words holds a multiple i of 3q with i and i + q both inside, so for
each period q only the pairs (i, i + q) on that grid are looked at, about n ln(n) / 3 pairs for n
words.  A pair of identical words is extended to both sides by longest common extensions (LCE); if
left + q + right is long enough it is a run, and equal stretches keep their smallest period (a
longer one is a multiple of it by Fine and Wilf).

*Difference cover.*  ``COVER`` modulo ``STEP`` holds two elements at every distance, so for any two
places a common shift below STEP takes both to sampled places.  Only suffixes at sampled places are
sorted: blocks of STEP words get a name, names are doubled until all suffixes differ.  An LCE compares
the few words up to the synchronised samples, takes whole blocks from a range minimum (sparse table)
over the common prefixes of sorted neighbours, and compares the words of the first differing block.
The order is that of block names, which serves as well as that of words: only common prefixes are
read from it.  Extensions that end within ``SHALLOW`` words need no table, so the suffixes of a
document are sorted only if some pair goes deeper.

Words are compared by 64-bit hashes of their bytes.  All arrays are per piece of about 1 MB of whole
documents, 0.2 sampled suffixes a word; a longer document is a piece of its own.

Defined cases: a null text has no words, no runs and an empty collapsed text; a null doc_id is kept;
rows that repeat get a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.jobs import arrow_job
from postlens.llm.wordhash import SPACE, U, mix, range_hash, word_pieces

POWER, LEAST = 4, 6
STEP, COVER = 31, (0, 1, 3, 8, 12, 18)
SHALLOW = 8
PAIRS = 1 << 20                    # grid pairs looked at together

_SLOT = np.full(STEP, -1, np.int64)            # place within the cover
_SLOT[list(COVER)] = np.arange(len(COVER))
_SHIFT = np.array([[next(k for k in range(STEP) if _SLOT[(a + k) % STEP] >= 0 and _SLOT[(b + k) % STEP] >= 0)
                    for b in range(STEP)] for a in range(STEP)])


def _equal_from(values: np.ndarray, i: np.ndarray, j: np.ndarray, most) -> np.ndarray:
    """How many values are equal from i and j on, at most ``most`` (a number or one for each pair)."""
    most = np.broadcast_to(most, i.shape)
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    step = 0
    while len(live):
        live = live[values[i[live] + step] == values[j[live] + step]]
        step += 1
        out[live] = step
        live = live[most[live] > step]
    return out


class Extensions:
    """LCE over an array whose last value occurs once; see the module's text."""

    def __init__(self, values: np.ndarray):
        k = len(COVER)
        blocks = -(-len(values) // STEP)
        self.values = np.concatenate([values, np.zeros(2 * STEP, U)])
        place = (np.arange(blocks)[:, None] * STEP + np.array(COVER)).ravel()
        place = np.minimum(place, len(values))
        rank = np.unique(range_hash(self.values, place, place + STEP), return_inverse=True)[1]
        levels, m = [rank], len(place)
        while levels[-1].max() + 1 < m:
            far = k << (len(levels) - 1)
            if far >= m:
                break
            after = np.zeros(m, np.int64)
            after[:-far] = levels[-1][far:] + 1
            levels.append(np.unique(levels[-1] * (m + 1) + after, return_inverse=True)[1])
        self.rank = np.empty(m, np.int64)
        order = np.argsort(levels[-1], kind="stable")
        self.rank[order] = np.arange(m)
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for n in range(len(levels) - 1, -1, -1):
            x, y = a + k * common, b + k * common
            ok = (x < m) & (y < m)
            same = ok.copy()
            same[ok] = levels[n][x[ok]] == levels[n][y[ok]]
            common += same << n
        table = [common.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(common):
            half = 1 << (len(table) - 1)
            low = table[-1].copy()
            low[:-half] = np.minimum(low[:-half], table[-1][half:])
            table.append(low)
        self.table = np.stack(table)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal values from i and j on; i < j, and no common stretch reaches the last value."""
        shift = _SHIFT[i % STEP, j % STEP]
        out = _equal_from(self.values, i, j, shift)
        deep = np.flatnonzero(out == shift)
        x, y = i[deep] + out[deep], j[deep] + out[deep]
        ends = [self.rank[p // STEP * len(COVER) + _SLOT[p % STEP]] for p in (x, y)]
        lo, hi = np.minimum(*ends), np.maximum(*ends)
        n = np.frexp((hi - lo).astype(float))[1] - 1
        whole = STEP * np.minimum(self.table[n, lo], self.table[n, hi - (1 << n)]).astype(np.int64)
        out[deep] += whole + _equal_from(self.values, x + whole, y + whole, STEP)
        return out


def _pairs(n: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, i, period) of the grids of documents of n words that begin at base."""
    most = n // POWER
    doc = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (n[doc] - period - 1) // ((POWER - 1) * period) + 1
    edge = np.concatenate([[0], np.cumsum(count)])
    k = 0
    while k < len(doc):
        end = max(k + 1, int(np.searchsorted(edge, edge[k] + PAIRS, "right")) - 1)
        c = count[k:end]
        along = np.arange(edge[end] - edge[k]) - np.repeat(edge[k:end] - edge[k], c)
        q = np.repeat(period[k:end], c)
        yield np.repeat(doc[k:end], c), np.repeat(base[doc[k:end]], c) + along * q * (POWER - 1), q
        k = end


def runs_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period.

    Document k has the word hashes words[bounds[k]:bounds[k + 1]]."""
    docs, n = len(bounds) - 1, np.diff(bounds)
    # a mark of its own before, between and after the documents ends every extension
    marks = mix(np.arange(1, docs + 2, dtype=U) + U(0xA5A5A5A500000000))
    values = np.empty(len(words) + docs + 1, U)
    at = np.arange(len(words)) + np.repeat(np.arange(1, docs + 1), n)
    values[at] = words
    sep = np.concatenate([[0], bounds[1:] + np.arange(1, docs + 1)])
    values[sep] = marks
    back = values[::-1]
    last = len(values) - 1
    padded = [np.concatenate([x, np.zeros(SHALLOW, U)]) for x in (values, back)]

    found = []
    for doc, i, q in _pairs(n, sep[:-1] + 1):
        same = np.flatnonzero(values[i] == values[i + q])
        doc, i, q = doc[same], i[same], q[same]
        ahead = _equal_from(padded[0], i, i + q, SHALLOW)
        behind = _equal_from(padded[1], last - i - q + 1, last - i + 1, SHALLOW)
        open_ = (ahead == SHALLOW) | (behind == SHALLOW)
        keep = open_ | (ahead + behind + q >= np.maximum(LEAST, POWER * q))
        found.append([x[keep] for x in (doc, i, q, ahead, behind)])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    doc, i, q, ahead, behind = (np.concatenate(x) for x in zip(*found, strict=True))

    deep = np.flatnonzero((ahead == SHALLOW) | (behind == SHALLOW))
    if len(deep):
        # the documents that need it, with the marks around them, moved together
        some = np.zeros(docs, bool)
        some[doc[deep]] = True
        kept = np.zeros(len(values), bool)
        kept[sep] = True
        kept[at] = np.repeat(some, n)
        moved = np.cumsum(kept) - 1
        body = values[kept]
        x, y = moved[i], moved[i + q]
        end = len(body) - 1
        for reverse, have in ((False, ahead), (True, behind)):
            todo = deep[have[deep] == SHALLOW]
            if len(todo):
                table = Extensions(body[::-1] if reverse else body)
                have[todo] = table.lce(end - y[todo] + 1, end - x[todo] + 1) if reverse else table.lce(x[todo], y[todo])
    size = ahead + behind + q
    ok = size >= np.maximum(LEAST, POWER * q)
    doc, start, size, q = doc[ok], (i - behind)[ok], size[ok], q[ok]
    order = np.lexsort((q, size, start, doc))
    doc, start, size, q = doc[order], start[order], size[order], q[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    doc, start, size, q = doc[fresh], start[fresh], size[fresh], q[fresh]
    start = start - sep[doc] - 1
    order = np.lexsort((q, start, doc))
    return doc[order], start[order], size[order], q[order]


def _collapse(piece, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    joined = np.flatnonzero(keep)
    doc = np.searchsorted(piece.bounds, joined, "right") - 1
    inner = np.zeros(len(joined), bool)                  # a kept word of the same document follows
    inner[:-1] = doc[1:] == doc[:-1]
    start, end = piece.start[joined], piece.end[joined] + inner
    edge = np.zeros(len(piece.data) + 2, np.int8)
    edge[start] += 1
    edge[end] -= 1
    data = np.where(SPACE[piece.data], np.uint8(32), piece.data)[np.cumsum(edge[:-2], dtype=np.int8) > 0]
    size = np.bincount(doc, weights=end - start, minlength=piece.docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(piece.docs, pa.py_buffer(offsets), pa.py_buffer(data))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in word_pieces(batch.column("text")):
            doc, start, size, period = runs_of(p.hash, p.bounds)
            drop = np.zeros(len(p.hash) + 1, np.int64)
            np.add.at(drop, p.bounds[doc] + start + period, 1)
            np.add.at(drop, p.bounds[doc] + start + size, -1)
            text = _collapse(p, np.cumsum(drop[:-1]) == 0)
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, size, period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(p.docs + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(p.row, p.docs), pa.array(np.diff(p.bounds), pa.int64()), runs, text.cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in words), collapsed for each row of ``docs``:
    the text without the words that some run holds after its first period."""
    return arrow_job(docs.select("doc_id", "text"), _run,
                     "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32(doc_id as text) leaves 0 modulo 10, the words from a on repeat the
    first p of them.  (The contract's inputs; texts without words stay.)"""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.expr("crc32(cast(cast(doc_id as string) as binary))")
    n = F.size("_w")
    d = docs.select("doc_id", "text").withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_g", F.floor(h / 10))
    d = (d.withColumn("_a", F.when(n > 0, F.expr("_g % size(_w)")))
         .withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + _g % 8)")))
    at = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1),
                     lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return d.select("doc_id", F.when(n > 0, F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``periodic_runs`` over the planted texts."""
    found = periodic_runs(with_planted_periods(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    f = found.withColumn("_best", best)
    return f.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words")
