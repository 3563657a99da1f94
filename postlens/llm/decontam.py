"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Words are compared in ASCII lower case without ASCII punctuation.  For each benchmark item of m
words, every window of m consecutive words of a document is compared with it.  The similarity is
the weighted Jaccard of the five-word shingles, weighted by how often each occurs: sum of the
smaller counts over sum of the larger ones; 0.75 or more is a leak.

1. A Bloom filter of BITS_EACH bits a shingle (2**16 to 2**26 bits, 8 MB at most) holds (m, shingle) of
   all items.  A window that can reach 0.75 has at least 6/7 of its shingles among those of items of its
   size, so only such windows get a fingerprint.  The filter errs on the side of more windows, never fewer.
2. A window's and an item's fingerprint is the 64-bit SimHash of their words.  Multi-index: the 64
   bits are cut into BLOCKS blocks of 16 bits; an item looks for windows of its size in every block with
   its own bits and all that differ from them in up to NEAR bits (137 values).  By the pigeonhole principle
   that finds every pair within RADIUS bits, while a pair of random fingerprints meets with probability
   4 * 137 / 2**16, below 1 %.  The join is a shuffle of both sides, whatever the benchmark's size.
3. Pairs farther apart are found by a shared shingle: of two sorted lists of a and b shingles with
   at least o in common, the first a - o + 1 and the first b - o + 1 hold a common one.  So no pair
   that reaches 0.75 depends on its fingerprints.
4. The pairs of 2 and 3 are verified by the exact weighted similarity.

Defined cases: items without words are skipped; an item of fewer than five words is one shingle of
its whole sequence, compared with windows of as many words; a document shorter than an item, but
long enough to reach 0.75, is one window; null and empty texts hold no leak; null doc_ids are
reported as null; rows that repeat are reported once; repeated items are reported each; empty
tables give an empty result; other columns are ignored by ``leaks`` and carried by ``without_leaks``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from postlens.llm.jobs import arrow_job, written
from postlens.llm.wordhash import U, as_long, mix, windows, word_pieces
from postlens.session import ship

SHINGLE = 5
SIMILARITY = 0.75
BLOCKS, BLOCK_BITS, NEAR = 4, 16, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
BITS_EACH = 16
MIN_BITS, MAX_BITS = 16, 26


def simhash(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """SimHash of words[s:s + size] for each s: bit b is set where most of the words' hashes have it."""
    lo, hi = int(start.min()), int(start.max()) + size
    bits = ((words[lo:hi, None] >> np.arange(64, dtype=U)) & U(1)).astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)])
    major = 2 * (total[start - lo + size] - total[start - lo]) > size
    return (major.astype(U) << np.arange(64, dtype=U)).sum(1, dtype=U)


def _cells(m: int, shingles: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(shingles ^ U(m * 0x9E3779B97F4A7C15 % (1 << 64)))
    keep = U((1 << bits) - 1)
    return [(h & keep).astype(np.int64), (h >> U(64 - bits)).astype(np.int64)]


def item_rows(batches):
    """item_id, m, fingerprint and sorted shingles of each item with words."""
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        out = []
        for p in word_pieces(batch.column("text"), lower=True, strip=True):
            for k in range(p.docs):
                a, b = int(p.bounds[k]), int(p.bounds[k + 1])
                if b > a:
                    w = p.hash[a:b]
                    h, _ = windows(w, np.array([0, b - a]), min(SHINGLE, b - a))
                    fp = simhash(w, np.array([0]), b - a)
                    out.append((ids[p.row + k], b - a, int(as_long(fp)[0]), np.sort(as_long(h)).tolist()))
        yield pa.RecordBatch.from_pydict(
            {"item_id": [x[0] for x in out], "m": [x[1] for x in out], "fp": [x[2] for x in out], "shingles": [x[3] for x in out]},
            schema=pa.schema([("item_id", pa.int64()), ("m", pa.int32()), ("fp", pa.int64()), ("shingles", pa.list_(pa.int64()))]))


def _filter_cells(bits: int):
    def run(batches):
        for batch in batches:
            cells = [np.concatenate(_cells(m, np.array(s, np.int64).view(U), bits)) for m, s in
                     zip(batch.column("m").to_pylist(), batch.column("shingles").to_pylist(), strict=True)]
            cells = np.unique(np.concatenate(cells)) if cells else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells >> 6), pa.array(as_long(U(1) << (cells & 63).astype(U)))], ["word", "bits"])
    return run


def filter_bits(shingles: int) -> int:
    """log2 of the filter's bits for so many shingles."""
    return min(max((BITS_EACH * max(shingles, 1) - 1).bit_length(), MIN_BITS), MAX_BITS)


def benchmark_filter(items: DataFrame) -> np.ndarray:
    """Bit table of the items' shingles in words of 64 bits; built by Spark, a row a word to the driver."""
    bits = filter_bits(items.agg(F.sum(F.size("shingles"))).first()[0] or 0)
    rows = (arrow_job(items.select("m", "shingles"), _filter_cells(bits), "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator())
    table = np.zeros(1 << (bits - 6), U)
    for r in rows:
        table[r["word"]] = np.int64(r["bits"]).view(U)
    return table


def _in(table: np.ndarray, m: int, shingles: np.ndarray) -> np.ndarray:
    a, b = _cells(m, shingles, len(table).bit_length() + 5)
    hit = (table[a >> 6] >> (a & 63).astype(U)) & U(1) > 0
    hit[hit] = (table[b[hit] >> 6] >> (b[hit] & 63).astype(U)) & U(1) > 0
    return hit


def _windows(table, sizes: list[int], any_size):
    """Windows of documents that may reach the similarity with an item of their size.

    ``any_size`` is the filter of all shingles regardless of size: one test per position settles
    most documents.
    """
    def run(batches):
        by_size, every = table.value, any_size.value
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            out = {k: [] for k in ("doc_id", "th", "m", "start", "fp", "shingles")}

            def add(row, m, w, h, starts, size, k):
                fps = as_long(simhash(w, starts, size))
                for s, fp in zip(starts.tolist(), fps.tolist(), strict=True):
                    out["doc_id"].append(ids[row])
                    out["th"].append(keys[row])
                    out["m"].append(m)
                    out["start"].append(s)
                    out["fp"].append(fp)
                    out["shingles"].append(np.sort(as_long(h[s:s + size - k + 1])))

            for p in word_pieces(batch.column("text"), lower=True, strip=True):
                for k in sorted({min(SHINGLE, m) for m in sizes}):
                    h, whole = windows(p.hash, p.bounds, k)
                    hit = whole & _in(every, 0, h)
                    if not hit.any():
                        continue
                    doc = np.unique(np.searchsorted(p.bounds, np.flatnonzero(hit), "right") - 1)
                    for d in doc.tolist():
                        a, b = int(p.bounds[d]), int(p.bounds[d + 1])
                        n = b - a
                        own, near = h[a:b - k + 1], hit[a:b - k + 1]
                        at = np.flatnonzero(near)
                        for m in sizes:
                            if min(SHINGLE, m) != k:
                                continue
                            size = min(m, n)                     # a short document is one window
                            cells, most = size - k + 1, m - k + 1
                            least = -(-(SIMILARITY * (cells + most)) // (1 + SIMILARITY))
                            if len(at) < least or cells < SIMILARITY * most:
                                continue
                            good = np.zeros(len(own) + 1, np.int64)
                            good[at + 1] = _in(by_size, m, own[at])
                            good = np.cumsum(good)
                            starts = np.flatnonzero(good[cells:] - good[:-cells] >= least)
                            if len(starts):
                                add(p.row + d, m, p.hash[a:b], own, starts, size, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["th"], pa.int64()), pa.array(out["m"], pa.int32()),
                 pa.array(out["start"], pa.int32()), pa.array(out["fp"], pa.int64()),
                 pa.array(out["shingles"], pa.list_(pa.int64()))], list(out))
    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two lists of shingles, weighted by their counts."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(a) + len(b) - common)


def similarity_udf(spark):
    ship(spark)

    @arrow_udf("double")
    def similarity_of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(np.array(x), np.array(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())
    return similarity_of


def blocks(fp: str) -> F.Column:
    """The fingerprint's blocks of bits, each with its number."""
    return F.array(*[F.struct(F.lit(k).alias("block"),
                              F.shiftrightunsigned(F.col(fp), BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("part"))
                     for k in range(BLOCKS)])


def probes(fp: str) -> F.Column:
    """The blocks, and all that differ from one in up to NEAR bits."""
    masks = [sum(1 << b for b in c) for n in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), n)]
    near = F.array(*[F.lit(m) for m in masks])
    return F.flatten(F.transform(blocks(fp), lambda x: F.transform(near, lambda m: F.struct(
        x["block"].alias("block"), x["part"].bitwiseXOR(m).alias("part")))))


def firsts(least_cells) -> F.Column:
    """The distinct shingles of which a pair that reaches the similarity shares one (columns m, shingles).

    ``least_cells`` is the smallest number of shingles that the other side can have.
    """
    cells = F.size("shingles")
    least = F.ceil(SIMILARITY / (1 + SIMILARITY) * (cells + least_cells) - 1e-6).cast("int")
    return F.array_distinct(F.slice("shingles", F.lit(1), F.greatest(cells - least + 1, F.lit(1))))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th (text key), item_id, similarity, start (word), n_words, distance for each document
    and item that match; the best window of each."""
    spark = docs.sparkSession
    items = written(arrow_job(benchmark.select("item_id", "text").where("text is not null"), item_rows,
                              "item_id long, m int, fp long, shingles array<long>"), "items")
    sizes = sorted(r["m"] for r in items.select("m").distinct().collect())   # distinct lengths only
    table = spark.sparkContext.broadcast(benchmark_filter(items))
    any_size = spark.sparkContext.broadcast(benchmark_filter(items.withColumn("m", F.lit(0))))
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where("text is not null")
    found = written(arrow_job(src, _windows(table, sizes, any_size),
                              "doc_id long, th long, m int, start int, fp long, shingles array<long>")
                    .withColumn("w", F.xxhash64("doc_id", "th", "m", "start")), "windows")

    left = found.select("w", "m", "fp", F.inline(blocks("fp")))
    right = items.select("item_id", "m", F.col("fp").alias("item_fp"), F.inline(probes("fp")))
    near = (left.join(right, ["m", "block", "part"])
            .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
            .where(F.col("distance") <= RADIUS)
            .select("w", "item_id", "item_fp", "distance"))
    most = F.col("m") - F.least(F.col("m"), F.lit(SHINGLE)) + 1     # shingles of an item; a short document has fewer
    left = found.select("w", "m", "fp", F.explode(firsts(most)).alias("shingle"))
    right = items.select("item_id", "m", F.col("fp").alias("item_fp"),
                         F.explode(firsts(F.ceil(SIMILARITY * F.size("shingles") - 1e-6))).alias("shingle"))
    far = (left.join(right, ["m", "shingle"])
           .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
           .where(F.col("distance") > RADIUS)
           .select("w", "item_id", "item_fp", "distance"))
    near = near.union(far).distinct()
    pairs = (near.join(found, "w")
             .join(items.select("item_id", F.col("fp").alias("item_fp"), "m", F.col("shingles").alias("item_shingles")),
                   ["item_id", "item_fp", "m"])
             .withColumn("similarity", similarity_udf(spark)("shingles", "item_shingles"))
             .where(F.col("similarity") >= SIMILARITY))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "m", "distance")).alias("b")
    return (pairs.groupBy("doc_id", "th", "item_id").agg(best)
            .select("doc_id", "th", "item_id", "b.similarity", (-F.col("b.s")).alias("start"), F.col("b.m").alias("n_words"), "b.distance"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that hold a benchmark item."""
    bad = written(leaks(docs, benchmark).select("doc_id", "th").distinct(), "leaked")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("d"),
                         F.xxhash64(docs["text"]).alias("t"))
    return (packed.join(bad, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left_anti")
            .select("row.*"))
