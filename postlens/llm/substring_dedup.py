"""Removal of passages that repeat across documents, by level-wise doubling of window lengths.

Level 1 looks at windows of half the length (25 words).  Of these only *anchors* are compared: the
window with the smallest hash in every run of half-windows that a full window holds.  Two equal
full windows have the same anchors at the same places, so a full window whose anchors appear in one
document only appears in one document only; nothing is sampled away.  Half-windows repeated across
documents are then extended to twice that length (50 words).  All full windows of one anchor lie in
one *block* of words, and equal blocks hold equal windows, so the extension compares blocks first,
and single windows only between the first documents of different blocks of one anchor.  Copies by
the thousand thereby come down to one representative before any window is compared.  The contract
judges windows of exactly 50 words, so no candidate has to go beyond that level.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; a row
with a null doc_id is neither smaller nor larger than any other, so it loses and claims nothing;
rows that repeat a doc_id never count as smaller than each other, and each gets its own result row (equal
rows share one list of marks);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.jobs import arrow_job, written
from postlens.llm.wordhash import as_long, range_hash, sliding_min, windows, word_pieces

WINDOW = 50


def _anchors(window: int):
    half = window // 2
    width = window - half + 1                    # half-windows in a window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(False), batch.column("th").to_numpy(False)
            for p in word_pieces(batch.column("text")):
                h, _ = windows(p.hash, p.bounds, half)
                n = len(p.hash) - window + 1
                if n <= 0:
                    continue
                last = np.repeat(p.bounds[1:], np.diff(p.bounds))[:n]
                whole = np.arange(n) + window <= last
                if not whole.any():
                    continue
                low = np.where(whole, sliding_min(h, width), np.uint64(0))
                # an anchor equals the smallest value of some window around it
                padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
                best = ~sliding_min(~padded, width)
                at = np.flatnonzero((best == h) & (best > 0))
                back = at[:, None] - np.arange(width)[None, :]
                ok = (back >= 0) & (back < n)
                back = np.where(ok, back, 0)
                ok &= whole[back] & (low[back] == h[at][:, None])
                lo = at - (width - 1 - np.argmax(ok[:, ::-1], axis=1))
                hi = at - np.argmax(ok, axis=1)
                doc = p.row + np.searchsorted(p.bounds, at, "right") - 1
                block = range_hash(p.hash, lo, hi + window)
                base = p.bounds[doc - p.row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(h[at])), pa.array(as_long(block)), pa.array(ids[doc]), pa.array(keys[doc]),
                     pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))],
                    ["a", "b", "doc_id", "th", "lo", "hi"])
    return run


def _verify(window: int):
    """Hash of every full window that a mixed anchor holds in this document."""
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            marks = batch.column("marks").to_pylist()
            for p in word_pieces(batch.column("text")):
                for k in range(p.docs):
                    r = p.row + k
                    spans = [(m["lo"], m["hi"]) for m in marks[r] if m["check"]]
                    if not spans:
                        continue
                    starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in spans]))
                    at = starts + p.bounds[k]
                    h = range_hash(p.hash, at, at + window)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(h)), pa.array(np.full(len(h), ids[r])), pa.array(np.full(len(h), keys[r])),
                         pa.array(starts.astype(np.int32))], ["w", "doc_id", "th", "start"])
    return run


def _cut(window: int):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("th")
            marks, extra = batch.column("marks").to_pylist(), batch.column("starts").to_pylist()
            removed, digest = [], []
            for p in word_pieces(batch.column("text")):
                for k in range(p.docs):
                    r, n = p.row + k, int(p.bounds[k + 1] - p.bounds[k])
                    edge = np.zeros(n + 1, np.int64)
                    for m in marks[r]:
                        if not m["check"]:
                            edge[m["lo"]] += 1
                            edge[m["hi"] + window] -= 1
                    for s in extra[r] or ():
                        edge[s] += 1
                        edge[s + window] -= 1
                    gone = np.cumsum(edge)[:n] > 0
                    removed.append(int(gone.sum()))
                    digest.append(hashlib.sha256(p.joined(np.flatnonzero(~gone) + p.bounds[k])).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                                             ["doc_id", "th", "n_removed", "kept_sha256"])
    return run


def _whole(batches):
    for batch in batches:
        n, digest = [], []
        for p in word_pieces(batch.column("text")):
            n += np.diff(p.bounds).tolist()
            digest += [hashlib.sha256(p.joined(slice(p.bounds[k], p.bounds[k + 1]))).hexdigest() for k in range(p.docs)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(digest, pa.string())],
            ["doc_id", "th", "n_words", "sha"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs`` (doc_id, text)."""
    src = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    known = src.where("doc_id is not null and text is not null")
    found = arrow_job(known, _anchors(window), "a long, b long, doc_id long, th long, lo int, hi int")

    repeated = written(found.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
                       .where("x < y").select("a"), "repeated")
    hits = written(found.join(repeated, "a", "left_semi"), "hits")

    # written, so that both sides of the join come from their own exchange and a hot anchor is split
    first = written(hits.groupBy("a", "b").agg(F.min("doc_id").alias("first")), "first")
    mixed = written(first.groupBy("a").agg((F.count("*") > 1).alias("mixed")), "mixed")
    blocks = written(first.join(mixed, "a"), "blocks")
    marks = (hits.join(blocks, ["a", "b"])
             .where("first < doc_id or mixed")
             .groupBy("doc_id", "th")
             .agg(F.collect_set(F.struct("lo", "hi", (F.col("first") == F.col("doc_id")).alias("check"))).alias("marks")))
    touched = written(known.join(marks, ["doc_id", "th"]), "touched")

    seen = arrow_job(touched.where(F.exists("marks", lambda m: m["check"])), _verify(window),
                     "w long, doc_id long, th long, start int")
    seen = written(seen, "windows")
    firsts = written(seen.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                     .where("first < last").select("w", "first"), "firsts")
    starts = (seen.join(firsts, "w").where("first < doc_id")
              .groupBy("doc_id", "th").agg(F.collect_set("start").alias("starts")))
    cut = arrow_job(touched.join(starts, ["doc_id", "th"], "left").select("doc_id", "th", "text", "marks", "starts"),
                    _cut(window), "doc_id long, th long, n_removed long, kept_sha256 string")
    cut = cut.groupBy("doc_id", "th").agg(F.max("n_removed").alias("n_removed"), F.max("kept_sha256").alias("kept"))

    return (arrow_job(src, _whole, "doc_id long, th long, n_words long, sha string")
            .join(cut, ["doc_id", "th"], "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("kept", "sha").alias("kept_sha256")))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM pos),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
bad AS (SELECT DISTINCT h.doc_id, unnest(range(h.p, h.p + 50)) AS i FROM h JOIN f USING (k) WHERE f.first < h.doc_id),
ex AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT ex.doc_id, count(*) FILTER (WHERE bad.i IS NOT NULL) AS n_removed,
             string_agg(word, ' ' ORDER BY ex.i) FILTER (WHERE bad.i IS NULL) AS kept
      FROM ex LEFT JOIN bad ON ex.doc_id = bad.doc_id AND ex.i = bad.i GROUP BY ex.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
