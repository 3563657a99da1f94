"""Quality rules with a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and pairs of neighbouring words are counted by their 64-bit hashes, so the table of n-grams
grows with the corpus.  Two multinomials are counted: the target over trusted documents (all that are
labelled quality 1, held-out rows left out) and the raw one over all documents, scaled to the target's
total; both get ``SMOOTH`` added to each n-gram, so one that the target could hardly have hit weighs
nothing.  A document's verdict is the mean, over its words and pairs, of log target - log raw: at or
above the cut it is kept.  Every third trusted document is left out of the target; the cut is the
``CUT`` quantile of the ratios of these, so that nearly all that is like the target stays.

The base rules are exact per-document counts.  Repeated three-word windows are found by their
64-bit hashes within one document; sorting is needed only where a document has a repeated one.

*Frequent n-grams.*  At most ``HOT`` n-grams, the most frequent of every ``SOME``-th document, are counted
by themselves over all documents (summed per task), looked up by a broadcast and summed per document
before a shuffle.  Which ones they are changes only how they travel, never a count.

*All others* move once, packed: a row for each document and share holds the document's 64-bit key and the
hashes that fall into the share.  A share's task counts its n-grams over all rows, weighs each and sends
back a sum for each document.  There are SHARES shares for up to EACH n-grams, twice as many for each
four times that.

Target documents are marked as their words are read: up to ``MARKS`` ids are broadcast, more are joined.

Defined cases: a text without words (null, empty) has zero counts, fails the base rules and isn't
kept; without trusted documents every ratio is 0 and the base rules decide; rows that repeat count
each and get a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.jobs import held_out, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 1 << 64                  # values of an n-gram's hash
HOT = 1 << 17
SOME = 32
LONGEST = 64                       # characters of a frequent n-gram; longer ones travel with the others
SHARES, EACH = 16, 1 << 28
MARKS = 1 << 22
SMOOTH = 2.0
CUT = 0.001
MIN_WORDS = 50
MAX_REPEAT = 50                    # per cent of words in repeated three-word windows


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
            .groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1"))
    return good.select(F.col("doc_id").alias("_id"), F.when(F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.lit(3)) == 0, 2).otherwise(1).alias("trusted"))


def _words(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, ``more``, text, d (key of doc_id and text), ws (words), n."""
    d = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))
    return (d.withColumn("d", F.xxhash64("doc_id", "text"))
            .withColumn("ws", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
            .withColumn("n", F.size("ws")))


def _grams() -> F.Column:
    """The words and the pairs of neighbours, joined by a space (columns ws, n)."""
    most = F.greatest(F.col("n") - 1, F.lit(0))
    return F.concat("ws", F.zip_with(F.slice("ws", F.lit(1), most), F.slice("ws", F.lit(2), most), lambda a, b: F.concat_ws(" ", a, b)))


def base_counts(words: DataFrame) -> DataFrame:
    """Adds word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    last = F.col("n") - 3
    out = (words
           .withColumn("word_chars", F.length(F.array_join("ws", "")).cast("long"))
           .withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("long"))
           .withColumn("_lines", lines)
           .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
           .withColumn("_h", F.transform("ws", lambda w: F.xxhash64(w)))
           .withColumn("_w", F.when(F.col("n") >= 3, F.transform(
               F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)))))
           .withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(
               F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
           .withColumn("_p", F.filter(F.transform("_s", lambda s, k: F.when(
               (s["h"] == F.get("_s", k - 1)["h"]) | (s["h"] == F.get("_s", k + 1)["h"]), s["i"])), lambda i: i.isNotNull()))
           .withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(F.concat(
               F.col("_p"), F.transform("_p", lambda i: i + 1), F.transform("_p", lambda i: i + 2)))), F.lit(0)).cast("long"))
           .withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long"))))
    return out


def _marked(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``rows`` with ``trusted``: 1 in the target, 2 left out for the cut, else 0."""
    return (rows.join(trusted, F.col("doc_id") == F.col("_id"), "left").drop("_id")
            .withColumn("trusted", F.coalesce("trusted", F.lit(0))))


def _targets(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, text, t: 1 for a document of the target, else 0."""
    ids = trusted.where("trusted = 1").select("_id", F.lit(1).alias("t"))
    if ids.count() <= MARKS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("t", F.lit(0)).alias("t"))


def counts(docs: DataFrame, trusted: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(gram, raw, target) of every n-gram, or those of ``only`` (gram, at most HOT); the gram is null where raw is 1."""
    grams = _words(_targets(docs, trusted), "t").select("t", F.explode(_grams()).alias("gram")).select("t", F.xxhash64("gram").alias("gram"))
    if only is not None:
        grams = grams.join(F.broadcast(only), "gram")
    return (grams.groupBy("gram").agg(F.count("*").alias("raw"), F.sum("t").cast("long").alias("target"))
            .select(F.when(F.col("raw") > 1, F.col("gram")).alias("gram"), "raw", "target"))


def frequent(docs: DataFrame) -> DataFrame:
    """gram: at most HOT n-grams that come twice or more in every SOME-th document, its most frequent."""
    some = _words(docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("some")), F.lit(SOME)) == 0))
    seen = written(some.select(F.explode(_grams()).alias("gram")).where(F.length("gram") <= LONGEST)
                   .groupBy("gram").count().where("count > 1"), "some")
    least, n = 1 << 62, 0
    for r in seen.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():
        n += r["n"]
        if n > HOT:
            break
        least = r["count"]
    return seen.where(F.col("count") >= least).select("gram")


def postings(words: DataFrame, hot: list[str], shares: int = SHARES) -> DataFrame:
    """(share, d, t, grams) for the n-grams of ``words`` (d, t, ws, n) that aren't in ``hot``; shares are ranges of hashes."""
    bounds = F.array(*(F.lit(k * BUCKETS // shares - BUCKETS // 2) for k in range(shares)))
    rest = words.select("d", "t", _grams().alias("grams"))
    rest = StopWordsRemover(inputCol="grams", outputCol="rest", stopWords=hot, caseSensitive=True).transform(rest)
    # the bounds are sorted in among the hashes, each before the equal ones
    return (rest.select("d", "t", F.sort_array(F.concat(F.transform("rest", lambda g: F.xxhash64(g)), bounds)).alias("keys"))
            .select("d", "t", "keys", F.concat(F.transform(bounds, lambda b: F.array_position("keys", b).cast("int")),
                                               F.array(F.size("keys") + 1)).alias("at"))
            .select("d", "t", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(shares)), lambda k: F.slice(
                "keys", F.element_at("at", k) + 1, F.element_at("at", k + 1) - F.element_at("at", k) - 1))).alias("share", "grams"))
            .where(F.size("grams") > 0).select("share", "d", "t", "grams"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    ratio for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    trusted = written(trusted_ids(labels), "trusted")
    own = ["doc_id", "n", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = written(_marked(base_counts(_words(docs)).select("d", *own), trusted), "base")
    grams = F.greatest(2 * F.col("n").cast("long") - 1, F.lit(0))
    total = base.agg(F.sum(grams).alias("r"), F.sum(F.when(F.col("trusted") == 1, grams)).alias("t")).first()
    raw, target = int(total["r"] or 0), int(total["t"] or 0)
    scale = target / max(raw, 1)
    shares = SHARES << max(0, math.ceil(math.log(max(raw, 1) / EACH, 4)))

    def weight(hits, seen):
        return F.log(hits + SMOOTH) - F.log(seen * F.lit(scale) + SMOOTH)

    hot = frequent(docs)
    often = F.broadcast(written(counts(docs, trusted, hot.select(F.xxhash64("gram").alias("gram"))), "often").select("gram", weight(F.col("target"), F.col("raw")).alias("weight")))
    words = _words(_targets(docs, trusted), "t")
    sums = (words.select("d", F.explode(_grams()).alias("gram")).select("d", F.xxhash64("gram").alias("gram")).join(often, "gram").select("d", "weight"))
    each = Window.partitionBy("gram", "share")
    rest = (postings(words, [r["gram"] for r in hot.collect()], shares).repartitionById(shares, "share")
            .select("share", "d", "t", F.explode("grams").alias("gram"))
            .select("d", weight(F.sum("t").over(each), F.count("*").over(each)).alias("weight")))
    sums = sums.union(rest).groupBy("d").agg(F.sum("weight").alias("sum"), F.count("*").alias("all"))
    scored = (base.join(sums, "d", "left")
              .withColumn("ratio", F.coalesce(F.col("sum") / F.col("all"), F.lit(0.0)))
              .withColumn("base_failed", (F.col("n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n"))))
    scored = written(scored.select(*own, "trusted", "ratio", "base_failed"), "scored")
    cut = scored.where("trusted = 2 and not base_failed").agg(F.percentile("ratio", CUT).alias("cut")).first()["cut"]
    verdict = F.lit(True) if cut is None else F.col("ratio") >= F.lit(cut) - 1e-12
    return scored.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "ratio")
