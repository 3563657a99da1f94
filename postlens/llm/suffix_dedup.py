"""Removal of every byte covered by a string of ``WINDOW`` bytes that starts twice or more in the corpus.

*Buckets.*  A suffix here is a place where a whole window starts in its document.  Its bucket is the
smallest 64-bit hash of the half-windows within its window: equal windows have equal bucket keys.
Neighbouring suffixes of one bucket form a *cell*, whose text (the first byte of its first window to the
last of its last) is all that has to move.  Cells of a bucket met once hold nothing that repeats; equal
cells repeat as a whole and are compared no further; different cells of one bucket, one of each text,
go to the task of their bucket.

*Blockwise suffix sorting.*  A task takes whole buckets of about ``SHARE`` bytes.  Of their text it
names the 8-byte words in order and ranks the suffixes sampled by a difference cover (``COVER``
modulo ``STEP``) by their first ``REACH`` bytes, doubling the ranked length.  Then ranges of first words
holding at most ``RANGE`` suffixes are sorted one after the other, so only that many are in work at a
time: by words up to STEP - 1 bytes, and what is still tied by ternary quicksort, where a comparison
shifts both suffixes to places that are both sampled and compares precomputed ranks, then the last
words of the window.  Neighbours in the sorted order that agree on a whole window repeat.

A bucket of more than ``CELLS`` cells is dealt to several tasks; each sorts its share, and one member
of every run of equal suffixes goes by its window's hash to a merge that finds runs of several shares.

Cells and buckets are compared by 64-bit hashes; equal windows are found by their bytes (in the merge
of shares by 64-bit hash).

Defined cases: a null text counts as empty; texts shorter than a window lose nothing; strings may
overlap and lie in one document; rows that repeat (also with one doc_id) count as several documents
and get a row each; a null doc_id is a document like others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.jobs import arrow_job, written
from postlens.llm.wordhash import U, as_long, mix, range_hash, raw_pieces, sliding_min, windows

WINDOW = 400
STEP, COVER = 57, (1, 6, 7, 9, 19, 38, 42, 49)
REACH = 6 * STEP                   # ranked bytes; REACH + STEP - 1 is within the window
SHARE = 2 << 20
RANGE = 1 << 19
CELLS = 8192

_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_SLOT = np.full(STEP, -1, np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))
_SHIFT = np.array([[next(k for k in range(STEP) if _SLOT[(a + k) % STEP] >= 0 and _SLOT[(b + k) % STEP] >= 0)
                    for b in range(STEP)] for a in range(STEP)], np.int16)


# ---------------------------------------------------------------------------------------------
# sorting within a task
# ---------------------------------------------------------------------------------------------

class CoverRanks:
    """Names of the 8-byte words and ranks of the sampled suffixes of a text."""

    def __init__(self, text: np.ndarray):
        k = len(COVER)
        size = -(-(len(text) + 1) // STEP) * STEP
        padded = np.zeros(size + 2 * STEP + 8, np.uint8)
        padded[:len(text)] = text
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(U)
        names, name = np.unique(words, return_inverse=True)
        del words
        self.name, self.names = name.astype(np.int32), len(names)
        place = (np.arange(size // STEP)[:, None] * STEP + np.array(COVER)).ravel()
        m = len(place)
        rank = self.name[place].astype(np.int64)
        for at in range(8, STEP - 8, 8):
            rank = np.unique(rank * self.names + self.name[place + at], return_inverse=True)[1]
        rank = np.unique(rank * self.names + self.name[place + STEP - 8], return_inverse=True)[1]
        for blocks in (1, 2, 2):                   # STEP bytes to 2, 4 and, overlapping, 6 times STEP
            after = np.zeros(m, np.int64)
            after[:-blocks * k] = rank[blocks * k:] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1]
        self.rank = rank

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // STEP * len(COVER) + _SLOT[at % STEP]]

    def compare(self, p: np.ndarray, r: np.ndarray, window: int) -> np.ndarray:
        """Order (-1, 0, 1) of the windows at p and r that agree on their first STEP - 1 bytes."""
        shift = _SHIFT[p % STEP, r % STEP]
        out = np.sign(self.of(p + shift) - self.of(r + shift))
        same = np.flatnonzero(out == 0)
        for at in [*range(REACH, window - 8, 8), window - 8]:
            if not len(same):
                break
            out[same] = np.sign(self.name[p[same] + at] - self.name[r[same] + at])
            same = same[out[same] == 0]
        return out


def _sort_range(ranks: CoverRanks, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted starts, whether each has the window of the one before)."""
    order = starts[np.argsort(ranks.name[starts], kind="stable")]
    head = np.ones(len(order), bool)
    head[1:] = ranks.name[order[1:]] != ranks.name[order[:-1]]
    same = np.zeros(len(order), bool)

    def tied():
        """Slots in groups of two or more that aren't known to be equal, and their group."""
        group = np.cumsum(head) - 1
        many = np.bincount(group)[group] > 1
        slots = np.flatnonzero(many & ~done)
        return slots, group[slots]

    done = np.zeros(len(order), bool)
    for at in range(8, STEP - 1, 8):
        slots, group = tied()
        if not len(slots):
            return order, same
        key = group * ranks.names + ranks.name[order[slots] + at]
        by = np.argsort(key, kind="stable")
        order[slots], key = order[slots[by]], key[by]
        head[slots[1:]] |= key[1:] != key[:-1]
    while True:
        slots, group = tied()
        if not len(slots):
            return order, same
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([first, [len(slots)]]))
        pivot = order[slots[first + size // 2]]
        p = order[slots]
        sign = ranks.compare(p, np.repeat(pivot, size), window)
        by = np.lexsort((p, sign, group))          # members of an equal run by place
        order[slots], sign, group = p[by], sign[by], group[by]
        new = (sign[1:] != sign[:-1]) & (group[1:] == group[:-1])
        head[slots[1:]] |= new
        equal = sign == 0
        done[slots[equal]] = True
        pair = equal[1:] & equal[:-1] & (group[1:] == group[:-1])
        same[slots[1:]] |= pair


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of ``text`` at ``starts`` in order, one range of first words at a time, as
    (starts, whether each has the window of the one before)."""
    ranks = CoverRanks(text)
    first = ranks.name[starts]
    upto = np.cumsum(np.bincount(first, minlength=ranks.names))
    lo, taken = 0, 0
    while lo < ranks.names:
        hi = max(lo + 1, int(np.searchsorted(upto, taken + RANGE, "right")))
        part = starts[(first >= lo) & (first < hi)]
        if len(part):
            yield _sort_range(ranks, part, window)
        lo, taken = hi, int(upto[hi - 1])


# ---------------------------------------------------------------------------------------------
# tasks
# ---------------------------------------------------------------------------------------------

def cells_of(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(bucket, hash of the text, first start, last start, weight) of the cells of a piece.

    A cell holds at most as many starts as a window has half-windows.  Weight 2: the bucket's half-window
    occurs twice in the cell, which may then repeat in itself."""
    half = window // 2
    width = window - half + 1
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    values = _BYTE[data]
    h, _ = windows(values, bounds, half)
    low = sliding_min(h, width)
    whole = np.arange(n) + window <= np.repeat(bounds[1:], np.diff(bounds))[:n]
    new = whole.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~whole[:-1]
    stop = whole.copy()
    stop[:-1] &= new[1:] | ~whole[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(stop)
    pieces = (hi - lo) // width + 1
    along = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    last = np.repeat(hi, pieces)
    lo = np.repeat(lo, pieces) + along * width
    hi = np.minimum(lo + width - 1, last)
    a = low[lo]
    weight = np.ones(len(lo), np.int32)
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    for k in range(0, len(lo), 4096):
        x, y, key = lo[k:k + 4096], hi[k:k + 4096], a[k:k + 4096, None]
        at_x, at_y = view[x] == key, view[y] == key
        twice = (at_x.sum(1) > 1) | (at_y.sum(1) > 1) | (x + at_x.argmax(1) != y + at_y.argmax(1))
        weight[k:k + 4096] += twice
    return a, range_hash(values, lo, hi + window), lo, hi, weight


def _cells(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("th")
            for row, off, data in raw_pieces(batch.column("text")):
                a, b, lo, hi, weight = cells_of(data, off, window)
                if not len(a):
                    continue
                doc = np.searchsorted(off, lo, "right") - 1
                take = pa.array(row + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(a)), pa.array(as_long(b)), ids.take(take), keys.take(take),
                     pa.array((lo - off[doc]).astype(np.int32)), pa.array((hi - off[doc]).astype(np.int32)), pa.array(weight)],
                    ["a", "b", "doc_id", "th", "lo", "hi", "weight"])
    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each element, elements) of a list column; a null list is empty."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten()


def _send(window: int):
    """The text of the cells that go to their bucket's task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, marks = _flat(batch.column("marks"))
            sent = np.flatnonzero(marks.field("a").is_valid().to_numpy(zero_copy_only=False))
            row, marks = row[sent], marks.take(pa.array(sent))
            lo, hi = (marks.field(x).to_numpy() for x in ("lo", "hi"))
            for first, off, data in raw_pieces(batch.column("text")):
                x, y = np.searchsorted(row, [first, first + len(off) - 1])
                raw = data.tobytes()
                for k in range(x, y, 2000):
                    some = slice(k, min(k + 2000, y))
                    base = off[row[some] - first]
                    text = [raw[s:e] for s, e in zip((base + lo[some]).tolist(), (base + hi[some] + window).tolist(), strict=True)]
                    part, take = marks[some], pa.array(row[some])
                    yield pa.RecordBatch.from_arrays(
                        [part.field("a"), part.field("salt"), part.field("salts"), batch.column("doc_id").take(take), batch.column("th").take(take),
                         part.field("lo"), part.field("sure"), pa.array(text, pa.binary())],
                        ["a", "salt", "salts", "doc_id", "th", "lo", "sure", "cell"])
    return run


def _sort_cells(t: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Repeated starts of whole buckets, as intervals; for shares of a bucket also one member of each run."""
    t = t.combine_chunks()
    if not t.num_rows:
        return
    off, text = _bytes(t.column("cell"))
    count = np.diff(off) - window + 1
    cell = np.repeat(np.arange(t.num_rows), count)
    starts = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count) + off[:-1][cell]
    lo, sure, salts = (t.column(x).to_numpy() for x in ("lo", "sure", "salts"))
    repeated = np.zeros(len(text) + 1, bool)
    runs = []
    for order, same in sorted_suffixes(text, starts, window):
        twin = same.copy()
        twin[:-1] |= same[1:]
        repeated[order[twin]] = True
        if (salts > 1).any():
            heads = np.flatnonzero(~same)
            at = np.searchsorted(off, order[heads], "right") - 1
            split = salts[at] > 1
            runs.append((order[heads[split]], at[split], ~twin[heads[split]] & ~sure[at[split]]))
    found = repeated[starts] & ~sure[cell]
    begin, end = found.copy(), found.copy()
    begin[1:] &= ~found[:-1] | (cell[1:] != cell[:-1])
    end[:-1] &= ~found[1:] | (cell[1:] != cell[:-1])
    x, y = np.flatnonzero(begin), np.flatnonzero(end)
    yield _rows(t, cell[x], lo[cell[x]] + starts[x] - off[cell[x]], lo[cell[x]] + starts[y] - off[cell[x]])
    for at, owner, open_ in runs:
        w = range_hash(_BYTE[text], at, at + window)
        place = lo[owner] + at - off[owner]
        yield _rows(t, owner, place, place, as_long(w), open_)


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, off, data = column.cast(pa.large_binary()).buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return off - off[0], np.frombuffer(data, np.uint8)[off[0]:off[-1]]


def _rows(t: pa.Table, cell, lo, hi, w=None, open_=None) -> pa.RecordBatch:
    take = pa.array(cell)
    doc, th = (t.column(x).combine_chunks().take(take) for x in ("doc_id", "th"))
    return pa.RecordBatch.from_arrays(
        [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (
            doc, th, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
            pa.nulls(len(lo), pa.int64()) if w is None else pa.array(w), pa.nulls(len(lo), pa.bool_()) if open_ is None else pa.array(open_))],
        ["doc_id", "th", "lo", "hi", "w", "undecided"])


def _sort_buckets(window: int):
    """Takes rows sorted by bucket and share; gathers whole ones of about SHARE bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("cell").nbytes
            if size < SHARE:
                continue
            t = pa.Table.from_batches(held)
            a, salt = (t.column(x).to_numpy() for x in ("a", "salt"))
            last = int(np.argmax((a == a[-1]) & (salt == salt[-1])))         # where the open bucket begins
            if last:
                yield from _sort_cells(t.slice(0, last), window)
                t = pa.table(t.slice(last).take(pa.array(np.arange(t.num_rows - last))))
            held, size = t.to_batches(), t.column("cell").nbytes
        if held:
            yield from _sort_cells(pa.Table.from_batches(held), window)
    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, marks = _flat(batch.column("marks"))
            sure = marks.field("sure").to_numpy(zero_copy_only=False)
            more, spans = _flat(batch.column("found"))
            lo, hi = (np.concatenate([marks.field(x).to_numpy()[sure], spans.field(x).to_numpy()]) for x in ("lo", "hi"))
            row = np.concatenate([row[sure], more])
            by = np.argsort(row, kind="stable")
            row, lo, hi = row[by], lo[by], hi[by]
            for first, off, data in raw_pieces(batch.column("text")):
                docs = len(off) - 1
                some = slice(*np.searchsorted(row, [first, first + docs]))
                base = off[row[some] - first]
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, base + lo[some], 1)
                np.add.at(edge, base + hi[some] + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                head = np.zeros(len(data) + 1, bool)
                head[off] = True
                x = np.flatnonzero(gone & (~np.concatenate([[False], gone[:-1]]) | head[:-1]))
                y = np.flatnonzero(gone & (~np.concatenate([gone[1:], [False]]) | head[1:])) + 1
                doc = np.searchsorted(off, x, "right") - 1
                cut = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array((x - off[doc]).astype(np.int64)), pa.array((y - off[doc]).astype(np.int64))], ["start", "end"]))
                kept = np.concatenate([[0], np.cumsum(~gone)])[off]
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), docs, [None, pa.py_buffer(kept), pa.py_buffer(data[~gone])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, docs), batch.column("th").slice(first, docs), text.cast(pa.binary()), cut],
                    ["doc_id", "th", "kept", "spans"])
    return run


# ---------------------------------------------------------------------------------------------
# the job
# ---------------------------------------------------------------------------------------------

def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined by doc_id (null equals null) and text hash; the right side's keys go."""
    right = right.withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), how).drop("_doc", "_th")


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))


def find_repeats(docs: DataFrame, window: int = WINDOW, cells: int = CELLS) -> DataFrame:
    """doc_id, th (xxhash64 of the text), kept (binary), spans (start, end; in bytes) of the documents
    that lose something, a row for each doc_id and text."""
    if window < REACH + STEP:
        raise ValueError(f"windows of {REACH + STEP} bytes at least")
    known = _source(docs).where(F.octet_length("text") >= window)
    found = written(arrow_job(known, _cells(window), "a long, b long, doc_id long, th long, lo int, hi int, weight int"), "cells")
    several = written(found.groupBy("a").agg(F.sum("weight").alias("k")).where("k > 1").select("a"), "several")
    hits = written(found.join(several, "a", "left_semi"), "hits")

    one = F.struct("doc_id", "th", "lo")
    distinct = written(hits.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min(one).alias("one"), F.max("weight").alias("weight")), "distinct")
    buckets = written(distinct.groupBy("a").agg(F.count("*").alias("n"), F.max("weight").alias("w")).where("n > 1 or w > 1")
                      .select("a", F.ceil(F.col("n") / cells).cast("int").alias("salts")), "buckets")
    texts = written(distinct.join(buckets, "a", "left").select(
        "a", "b", (F.col("copies") > 1).alias("sure"), "one", "salts",
        F.pmod(F.xxhash64("b", F.lit("share")), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")), "texts")
    goes = F.col("salts").isNotNull() & one.eqNullSafe(F.col("one"))
    marks = (hits.join(texts, ["a", "b"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct(
        "lo", "hi", "sure", F.when(goes, F.col("a")).alias("a"), F.when(goes, F.col("salt")).alias("salt"),
        F.when(goes, F.col("salts")).alias("salts"))).alias("marks")))
    touched = written(_with(known, marks, "inner"), "touched")

    sent = arrow_job(touched.where(F.exists("marks", lambda m: m["a"].isNotNull())).select("doc_id", "th", "text", "marks"), _send(window),
                     "a long, salt int, salts int, doc_id long, th long, lo int, sure boolean, cell binary")
    sent = sent.repartition("a", "salt").sortWithinPartitions("a", "salt")
    runs = written(arrow_job(sent, _sort_buckets(window), "doc_id long, th long, lo int, hi int, w long, undecided boolean"), "runs")
    shared = written(runs.where("w is not null").groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w"), "shared")
    more = runs.where("undecided").join(shared, "w", "left_semi").select("doc_id", "th", "lo", "hi")
    spans = (runs.where("w is null").select("doc_id", "th", "lo", "hi").union(more)
             .groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("found")))
    every = _with(touched, spans, "left").select("doc_id", "th", "text", "marks", "found")
    cut = arrow_job(every, _cut(window), "doc_id long, th long, kept binary, spans array<struct<start:long,end:long>>")
    return cut.where(F.size("spans") > 0).dropDuplicates(["doc_id", "th"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept (binary), spans for each row of ``docs`` (doc_id, text)."""
    return _with(_source(docs), find_repeats(docs, window), "left").select(
        "doc_id", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"), F.coalesce("spans", F.array()).alias("spans"))


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``; only the hash and
    length of an untouched text move."""
    own = _source(docs).select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"),
                               F.sha2(F.col("text").cast("binary"), 256).alias("_own"))
    cut = written(find_repeats(docs, window).select(
        "doc_id", "th", F.octet_length("kept").cast("long").alias("_left"), F.size("spans").cast("long").alias("_n"), F.sha2("kept", 256).alias("_cut")), "cut")
    return _with(own, cut, "left").select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("_left", "n_bytes")).alias("n_removed"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("_cut", "_own").alias("kept_sha256"))
