"""Mixing sources to target weights, with DataFrame functions only.

Tokens (words) are summed per source; the weights 5, 2, 1 go round over the sources in code point
order (null last) and share ``SHARE`` of all words, where no source may get more than ``CEILING``
times its own words.  That cut is a water level: with sources ordered by the level at which they
fill up, the level is the largest of the levels found by taking the first 0, 1, 2, ... sources as
full, so one running sum gives it without iterating.  A source's repetition rate is target / size;
each of its documents is taken floor(rate) times, and once more where a hash of its doc_id falls
below the rate's fraction.

Defined cases: a null or empty text has size 0 and is taken with 0 words; null is a source of its
own; a source without words gets target 0 and rate 0; a null doc_id draws as the empty string; rows
that repeat a doc_id draw alike and each get a row; an empty table gives an empty result; extra
columns are ignored by ``mix`` and carried by ``emit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.jobs import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: str) -> F.Column:
    """Uniform number in [0, 1) from the doc_id."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, ceiling=CEILING) -> DataFrame:
    """(source, source_size, target) of a (source, size) table.

    The windows without a key run over one row per source, after the aggregate.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    per = (per.withColumn("weight", F.element_at(wheel, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
           .withColumn("full", F.col("source_size") * F.lit(float(ceiling)))
           .withColumn("fills_at", F.col("full") / F.col("weight")))
    before = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (per.withColumn("taken_before", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
           .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
           .withColumn("all_words", F.sum("source_size").over(every))
           .withColumn("all_weight", F.sum("weight").over(every))
           .withColumn("level", (F.col("all_words") * F.lit(float(share)) - F.col("taken_before"))
                       / (F.col("all_weight") - F.col("weight_before")))
           .withColumn("level", F.max("level").over(every)))
    return per.select("source", "source_size",
                      F.least("full", F.col("level") * F.col("weight")).alias("target"))


def _rated(docs: DataFrame, seed: str) -> DataFrame:
    """docs with size, source_size, target and copies."""
    per = targets(docs.select("source", "size"))
    per = per.select(F.col("source").alias("_s"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("_rate"))
    return (docs.join(per, docs["source"].eqNullSafe(per["_s"]), "left").drop("_s")
            .withColumn("_rate", F.least(rate, F.lit(CEILING)))
            .withColumn("copies", (whole + (_draw(seed) < F.col("_rate") - whole).cast("long")).cast("long"))
            .drop("_rate"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row; the texts are read once."""
    sized = written(docs.select("doc_id", "source", words("text").alias("size")), "sized")
    return _rated(sized, seed).select("doc_id", "size", "source_size", "target",
                                      (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is taken, with its copy number.

    Columns of ``docs`` named like the operator's own (size, copy, ...) are kept as they are, so the
    copy number is called mix_copy, or mix_copy_ and so on where that name is taken.
    """
    packed = docs.select("doc_id", "source", words("text").alias("size"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    n = "mix_copy"
    while n in docs.columns:
        n += "_"
    return (_rated(packed, seed).where("copies > 0")
            .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_n"))
            .select("_row.*", F.col("_n").alias(n)))


_TARGETS = r"""
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM per),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked),
filled AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0.0) AS taken_before,
                  coalesce(sum(weight) OVER b, 0.0) AS weight_before
           FROM weighed WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM per) - taken_before)
                     / ((SELECT sum(weight) FROM weighed) - weight_before)) AS level FROM filled),
goal AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target FROM filled, level),
drawn AS (SELECT sized.*, goal.source_size, goal.target,
                 CASE WHEN goal.source_size > 0 THEN least(goal.target / goal.source_size, 2.0::DOUBLE) ELSE 0 END AS rate,
                 ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
          FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source)
"""

ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
""" + _TARGETS + r"""
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM drawn
"""
