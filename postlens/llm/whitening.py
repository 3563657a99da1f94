"""Whitening of embeddings with MLlib's distributed BlockMatrix.

Entries become integers x = floor(64 c) + 1,000,000, so counts, sums and deviations are exact.  The
covariance is over the *fit list*, each distinct x vector once.  Rows are centred before anything is
multiplied (the offset would otherwise cancel away all digits): n x - S is exact, only its division
by n rounds.  Centred rows get consecutive indices and become a BlockMatrix; its transpose times
itself is the scatter, whose d x d sum alone comes to the driver for ``eigh``; a second
multiplication, by the whitening matrix, projects all rows.

``multiply`` would send all row blocks of a one-block result to one task; the number of splits of the
inner dimension, an argument of its Scala form, keeps one task per few blocks and adds their d x d
products by key.  Blocks hold at most ``BLOCK_BYTES``; the driver learns one coordinate pair a block.

Defined cases: rows whose vector is null, empty, or holds null, non-finite or absurd (beyond 2**40)
entries are dropped, as are vectors that don't have the commonest length (ties: the longer); repeated
rows count once in the fit list and get their results each; a null vec_id is kept; a component without
variance (rank lower than the dimension, one row only) has a null whitened value and explains 0, and
identity_error is over the components with variance (null if none); a deviation past 2**63 - 1 raises
an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.jobs import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
COLUMNS = 256                      # per block
BLOCK_BYTES = 16 << 20
SPLITS = 2000                      # inner splits of a product, at most
ABSURD = float(1 << 40)


def as_integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x of the rows that have a usable vector of the commonest length."""
    c = F.col("embedding").cast("array<double>")
    sound = embeddings.select("vec_id", c.alias("c")).where(
        "size(c) > 0 and forall(c, v -> v is not null and not isnan(v) and abs(v) <= %r)" % ABSURD)
    lengths = sound.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return sound.where(F.size("c") == d).select(
        "vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + OFFSET).alias("x"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with consecutive ``row`` numbers from 0: counts of the parts give each its offset."""
    kept = written(df.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["count"]) for r in kept.groupBy(part.alias("p")).count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    rows = [(p, before[k] - (p << 33)) for k, (p, _) in enumerate(counts)]
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _first long")       # a row for each task
    return (kept.join(F.broadcast(offsets), part == F.col("_part"))
            .withColumn("row", F.col("_id") + F.col("_first")).drop("_id", "_part", "_first"))


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """``rows`` (row, centred array<double>) as blocks of about equal size, some for each core."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    width = min(d, COLUMNS)
    high = int(max(1, min(BLOCK_BYTES // (8 * width), max(64, n // (4 * cores)))))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(high, width)


def multiply(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def release(a: BlockMatrix) -> None:
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)


def gram(a: BlockMatrix) -> np.ndarray:
    """Transpose of a times a: as many rows as a has columns."""
    splits = max(1, min(-(-a.numRows() // a.rowsPerBlock), SPLITS))
    return multiply(a.transpose(), a, splits).toLocalMatrix().toArray()


def local_blocks(spark, w: np.ndarray, height: int) -> BlockMatrix:
    """A small local matrix as blocks of ``height`` rows."""
    parts = [((k, 0), Matrices.dense(len(p), w.shape[1], p.ravel("F").tolist()))
             for k, p in ((k, w[k * height:(k + 1) * height]) for k in range(-(-len(w) // height)))]
    return BlockMatrix(spark.sparkContext.parallelize(parts, len(parts)), height, w.shape[1])


def fit(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, share of the trace, whitening matrix) of the first components; a component
    without variance has eigenvalue 0 and no column."""
    v = (scatter + scatter.T) / (2.0 * n)
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    real = e > len(e) * np.finfo(float).eps * max(e[0], 0.0)
    e = np.where(real, e, 0.0)[:most]
    trace = float(np.trace(v))
    used = int((e > 0).sum())
    return e, e / trace if trace > 0 else e, vectors[:, :used] / np.sqrt(e[:used])


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue: a row for each
    usable row of ``embeddings`` (vec_id, embedding) and component up to ``most``."""
    spark = embeddings.sparkSession
    rows = numbered(as_integers(embeddings), "vectors")
    distinct = numbered(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "distinct")
    sums = distinct.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sums = sorted(tuple(r) for r in sums.collect())                                 # a row for each dimension
    n, total, d = distinct.count(), rows.count(), len(sums)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, eigenvalue double")
    if not n:
        return spark.createDataFrame([], schema)

    # (n x - S)^2 summed fits a long unless the largest entries say otherwise
    big = sum(max(abs(n * lo - int(s)), abs(n * hi - int(s))) ** 2 for _, s, lo, hi in sums) >= 1 << 63
    big = big or any(max(abs(n * lo), abs(n * hi), abs(int(s))) >= 1 << 62 for _, s, lo, hi in sums)
    kind = T.DecimalType(38, 0) if big else T.LongType()
    total_of = F.array(*[F.lit(s).cast(kind) for _, s, _, _ in sums])

    def centred(df):
        whole = F.zip_with("x", total_of, lambda x, s: x.cast(kind) * F.lit(n).cast(kind) - s)
        return (df.withColumn("whole", whole).withColumn("centred", F.transform("whole", lambda v: v.cast("double") / F.lit(float(n)))))

    fitted = block_matrix(centred(distinct).select("row", "centred"), n, d).persist(StorageLevel.MEMORY_AND_DISK)
    e, share, w = fit(gram(fitted), n, most)
    components, used = len(e), w.shape[1]
    error = None
    if used:
        weights = local_blocks(spark, w, fitted.colsPerBlock)
        check = gram(multiply(fitted, weights, 1)) / n
        error = float(np.abs(check - np.eye(used)).max())
        every = block_matrix(centred(rows).select("row", "centred"), total, d).persist(StorageLevel.MEMORY_AND_DISK)
        projected = multiply(every, weights, 1).toIndexedRowMatrix()
        frame = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
        y = written(frame.select(F.col("index").alias("row"), vector_to_array("vector").alias("y")), "whitened")
        release(every)
    else:
        y = rows.select("row", F.array().cast("array<double>").alias("y"))
    release(fitted)
    square = F.aggregate("whole", F.lit(0).cast(kind), lambda a, v: (a + v * v).cast(kind)).cast("long")
    out = centred(rows).select("row", "vec_id", square.alias("deviation")).join(y, "row")
    facts = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(float(share[k])).alias("explained"),
                               F.lit(float(e[k])).alias("eigenvalue")) for k in range(components)])
    out = out.select("vec_id", "deviation", "y", F.explode(facts).alias("f"))
    return out.select("vec_id", "f.component", F.lit(n).cast("long").alias("n"), "deviation",
                      F.get("y", F.col("f.component") - 1).alias("whitened"), "f.explained",
                      F.lit(error).cast("double").alias("identity_error"), "f.eigenvalue")
