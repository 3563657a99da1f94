"""N-gram Jaccard join by a blocked sparse product of the document x n-gram incidence.

Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.75 or more.
Documents with the same set form a class and count once (``classes``).  The product's columns are
the shingles; a block of columns is what one shuffle partition holds, and only the cells that a link
needs are made: of n shingles each class keeps the first n - ceil(0.75 n) + 1 in one global order,
since two sets that agree on 0.75 must meet there.  The order puts shingles that occur in unusually
many documents last.  What is frequent is read off a count sketch of fixed size (2**20 counters,
4 MB) over all shingles of all documents; any order gives the same links, the sketch only keeps
columns thin.

A link of sizes x and y needs ceil(0.75 (x + y) / 1.75) common shingles.  Two rounds keep groups of
copies from growing into all their pairs.  Round 1 pairs each class with the earliest class of each
column, accumulates the overlap counts over the cells, drops pairs whose count plus what can lie
behind the kept cells, max(ceil(0.75 x), ceil(0.75 y)) - 1, falls short of that number, takes the
pair with the highest count and verifies it.  Round 2 takes the pairs of cells whose classes are not
yet in one component (pairs within one can't change the result): the two sets must meet within the
first x - needed + 1 and y - needed + 1 places of the order, so a cell's place bounds the sizes it
can pair with; their overlap counts are then accumulated and bounded as before.  Verification compares the whole sets, computed again from the texts.

Defined cases: a text without words (null, empty) has an empty set, is linked with nothing and is
its own component; fewer than five words make one shingle of the whole sequence; a row with a null
doc_id takes part in links, but a component's id is the smallest doc_id that is not null (null if
there is none); rows that repeat a doc_id each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.jobs import arrow_job, components, written
from postlens.llm.wordhash import U, as_long, mix, range_hash, windows, word_pieces

SHINGLE = 5
NUM, DEN = 75, 100                 # links: DEN * intersection >= NUM * union
SKETCH_BITS = 20                   # counters of the sketch: fixed, whatever the corpus
SKETCH_BLOCKS = 16
MERGE_WAYS = 256                   # first level of merging the tasks' sketches


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each document."""
    for p in word_pieces(column, lower=True):
        h, _ = windows(p.hash, p.bounds, size)
        for k in range(p.docs):
            a, b = int(p.bounds[k]), int(p.bounds[k + 1])
            if b - a >= size:
                yield p.row + k, np.unique(h[a:b - size + 1])
            elif b > a:
                yield p.row + k, range_hash(p.hash, np.array([a]), np.array([b]))
            else:
                yield p.row + k, np.zeros(0, U)


def set_id(s: np.ndarray) -> np.uint64:
    """One number for the whole set."""
    with np.errstate(over="ignore"):
        return mix(np.array([mix(s).sum(dtype=U) + U(len(s)) * U(0x9E3779B97F4A7C15)], U))[0]


def needed(x, y):
    """Common shingles that sets of these sizes need: ceil(NUM (x + y) / (NUM + DEN))."""
    return -(-NUM * (x + y) // (NUM + DEN))


def kept_cells(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


# --- the sketch that orders columns -------------------------------------------------------------

def _counters(batches):
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    salt = 0
    for batch in batches:
        sets = [s for _, s in shingle_sets(batch.column("text"))]
        if sets:
            every = np.concatenate(sets)
            salt = (salt + int(every.sum(dtype=U))) % MERGE_WAYS if len(every) else salt
            counts += np.bincount((every >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
    if counts.any():
        blocks = counts.reshape(SKETCH_BLOCKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SKETCH_BLOCKS, dtype=np.int32)), pa.array(np.full(SKETCH_BLOCKS, salt, np.int32)),
             pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], ["block", "salt", "counts"])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.uint32)
    for c in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(c), np.uint32)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "salt": [0], "counts": [zlib.compress(total.tobytes(), 1)]})


def column_levels(texts: DataFrame) -> np.ndarray:
    """For each sketch cell, 0 where its count is usual, else how far above (log scale)."""
    schema = "block int, salt int, counts binary"
    merged = (arrow_job(texts, _counters, schema)
              .groupBy("block", "salt").applyInPandas(_merge, schema)
              .groupBy("block").applyInPandas(_merge, schema))
    counts = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint32)
    for r in merged.collect():                    # SKETCH_BLOCKS rows, 4 MB in all
        counts[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    counts = counts.reshape(-1).astype(float)
    above = (counts - np.median(counts)) / np.sqrt(np.median(counts) + 1)
    return np.where(above >= 1, 1 + np.floor(6 * np.log2(np.maximum(above, 1))), 0).astype(np.uint8)


# --- jobs over the texts --------------------------------------------------------------------------

def _sets(batches):
    for batch in batches:
        n, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, U)
        for row, s in shingle_sets(batch.column("text")):
            n[row], ids[row] = len(s), set_id(s)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(as_long(ids))],
                                         ["doc_id", "th", "n", "sid"])


def _cells(levels):
    def run(batches):
        table = levels.value
        for batch in batches:
            grams, ids, place = [], [], []
            for _, s in shingle_sets(batch.column("text")):
                if len(s):
                    order = np.argsort(table[(s >> U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    grams.append(s[order[:kept_cells(len(s))]])
                    ids.append(np.full(len(grams[-1]), set_id(s), U))
                    place.append(np.arange(len(grams[-1]), dtype=np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(grams))), pa.array(as_long(np.concatenate(ids))),
                                                  pa.array(np.concatenate(place))], ["g", "sid", "place"])
    return run


def _verified(batches):
    """Pairs of texts -> the pairs that link."""
    for batch in batches:
        a = [s for _, s in shingle_sets(batch.column("ta"))]
        b = [s for _, s in shingle_sets(batch.column("tb"))]
        common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        union = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64) - common
        yield batch.select(["u", "v"]).filter(pa.array(DEN * common >= NUM * union))


def _link(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) pairs of classes -> those that link; each class's text moves once per pair it is in."""
    a = texts.select(F.col("sid").alias("u"), F.col("text").alias("ta"))
    b = texts.select(F.col("sid").alias("v"), F.col("text").alias("tb"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "ta", "tb")
    return arrow_job(both, _verified, "u long, v long")


def _could_link(a, b, count) -> F.Column:
    """The count of common cells is enough for these sizes."""
    need = F.expr(f"({NUM} * ({a} + {b}) + {NUM + DEN - 1}) div {NUM + DEN}")
    behind = F.expr(f"({NUM} * greatest({a}, {b}) + {DEN - 1}) div {DEN} - 1")
    return (F.col(count) + behind >= need) & F.expr(f"{DEN} * least({a}, {b}) >= {NUM} * greatest({a}, {b})")


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, th (text key), n (set size), sid (id of the set)."""
    return arrow_job(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), _sets,
                     "doc_id long, th long, n long, sid long")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    members = written(classes(docs), "classes")
    reps = written(members.where("n > 0").groupBy("sid")
                   .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"), F.first("n").alias("n"))
                   .select("sid", "n", "r.doc_id", "r.th"), "reps")

    keyed = docs.select("doc_id", "text").where("text is not null")
    levels = spark.sparkContext.broadcast(column_levels(keyed.select("text")))
    cells = arrow_job(keyed.select("text"), _cells(levels), "g long, sid long, place int")
    shared = written(cells.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"), "columns")
    cells = written(cells.join(shared, "g", "left_semi").distinct(), "cells_all")
    busy = cells.groupBy("g").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x < y").select("g")
    cells = written(cells.join(busy, "g", "left_semi").join(reps, "sid").select("g", "sid", "place", "n", "doc_id"), "cells")

    # the texts of all classes that share a column with another class
    wanted = cells.select("sid").distinct().join(reps, "sid").select("sid", "doc_id", "th")
    texts = (docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
             .join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
             .groupBy("sid").agg(F.first("text").alias("text")))
    texts = written(texts, "texts")

    # round 1: the earliest class of each column
    early = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")
    heads = cells.groupBy("g").agg(F.min(early).alias("h")).select("g", F.col("h.sid").alias("v"))
    votes = (cells.join(heads, "g").where("sid <> v")
             .groupBy("sid", "v", "n").agg(F.count("*").alias("c"))
             .join(reps.select(F.col("sid").alias("v"), F.col("n").alias("m")), "v")
             .where(_could_link("n", "m", "c")))
    best = written(votes.groupBy("sid").agg(F.max(F.struct("c", "v")).alias("b"))
                   .select(F.col("sid").alias("u"), F.col("b.v").alias("v")), "best")
    links = written(_link(best, texts), "links1")
    comp = written(components(links), "comp1")

    # round 2: all other pairs of cells that can be the first to meet, between components only
    cc = cells.join(comp.withColumnRenamed("node", "sid"), "sid", "left") \
        .select("g", "sid", "n", F.coalesce("comp", "sid").alias("comp"),
                F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}").alias("least"),
                F.expr(f"({DEN} * n - {NUM + DEN} * place) div {NUM}").alias("most"))
    cc = written(cc, "cells2")
    per = cc.groupBy("g", "comp").agg(F.min("n").alias("n0"), F.max("n").alias("n1"),
                                      F.min("least").alias("least"), F.max("most").alias("most"))
    many = per.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    per = written(per.join(many, "g", "left_semi"), "columns2")
    across = (per.alias("a").join(per.alias("b"), F.expr(
        "a.g = b.g and a.comp < b.comp and a.n1 >= b.least and a.n0 <= b.most and b.n1 >= a.least and b.n0 <= a.most"))
        .select("a.g", F.col("a.comp").alias("c1"), F.col("b.comp").alias("c2")))
    pairs = (across.join(cc.alias("x").withColumnRenamed("comp", "c1"), ["g", "c1"])
             .select("g", "c2", F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("least").alias("lu"), F.col("most").alias("mu"))
             .join(cc.withColumnRenamed("comp", "c2"), ["g", "c2"])
             .where("n between lu and mu and nu between least and most")
             .select("u", F.col("sid").alias("v")).distinct())
    # a pair's whole count over the kept cells, of which a class has no more than its text has words
    own = written(cells.groupBy("sid", "n").agg(F.collect_list("g").alias("own")), "own_cells")
    pairs = (written(pairs, "meetings")
             .join(own.select(F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("own").alias("a")), "u")
             .join(own.select(F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("own").alias("b")), "v")
             .withColumn("c", F.size(F.array_intersect("a", "b")))
             .where(_could_link("nu", "nv", "c")).select("u", "v"))
    pairs = pairs.join(best, ["u", "v"], "left_anti") \
        .join(best.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"], "left_anti")
    more = written(_link(written(pairs, "pairs2"), texts), "links2")
    comp = written(components(links.union(more)), "comp2")

    # a component's id is its smallest doc_id
    where = members.select("doc_id", "sid").where("doc_id is not null") \
        .join(comp.withColumnRenamed("node", "sid"), "sid", "left") \
        .select(F.coalesce("comp", "sid").alias("comp"), "doc_id").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = reps.select("sid").join(comp.withColumnRenamed("node", "sid"), "sid", "left") \
        .select("sid", F.coalesce("comp", "sid").alias("comp")).join(where, "comp", "left").select("sid", "component_id")
    return (members.join(written(named, "named"), "sid", "left")
            .select("doc_id", "th", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one whose doc_id is the component's id.

    Rows with the same doc_id and text are copies, of which one stays (that with the smallest hash of all
    its columns, so reruns agree); rows without words stay.  All columns are kept.
    """
    parts = link_components(docs).where("n_shingles > 0")
    rows = parts.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r")) \
        .select("r.doc_id", "r.th")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("d"),
                         F.xxhash64(docs["text"]).alias("t"),
                         F.coalesce(~docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(True)).alias("blank"))
    one = packed.where("not blank").join(rows, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left_semi")
    one = one.groupBy("d", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(packed.where("blank").select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [md5(array_to_string(ws, ' '))]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
