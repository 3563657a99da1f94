"""Keyword tables of any length matched in one pass over each text.

A literal keyword list costs one search per keyword and text.  Here the keywords become an
Aho-Corasick automaton that reports all of them in one pass, so time follows the texts and their
hits, not the number of keywords.  The table is broadcast in parts of at most ``PART_BYTES`` (checked
by an aggregate before anything is collected); a larger table makes more parts, which a worker takes
one after the other over ``HOLD`` bytes of texts, without a shuffle.  A Python worker holds one automaton
at a time, so its memory follows the bounds and not the table (which it keeps as packed strings).

Matching is by substring of the lower-cased text, as in the literal rules; ``ignore_case=False``
matches as written.  Occurrences of one keyword are counted from the left without overlap.  Positions
are 1-based characters of the (lower-cased) text.

Defined cases: a null or empty text has no matches; null, empty and repeated keywords are dropped;
an empty table matches nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens import config as C
from postlens.session import scratch_path, ship

PART_BYTES = 2 << 20               # of keywords in an automaton: some 100 MB of nodes a worker
HOLD = 32 << 20                    # of texts in a worker that meet one automaton after the other
SLICE = 256                        # texts whose matches are Python objects at a time
MATCHES = "array<struct<keyword:string,n:int,first:int>>"

_automaton: dict[str, tuple] = {}


def automaton(token: str, names: pa.Array) -> tuple:
    """(automaton, keywords) of a part; a worker keeps the last one it has built."""
    if token not in _automaton:
        import ahocorasick
        _automaton.clear()
        a, words = ahocorasick.Automaton(), names.to_pylist()
        for k, w in enumerate(words):
            a.add_word(w, k)
        a.make_automaton()
        _automaton[token] = a, words
    return _automaton[token]


def matches_of(a, words: list[str], text: str | None) -> list[tuple[int, int, int]]:
    """(keyword's number, n, first) of every keyword in the text."""
    if not text or not words:
        return []
    seen: dict[int, list[int]] = {}                # keyword -> count, first start, end of the last counted
    for end, k in a.iter(text):
        start = end - len(words[k]) + 1
        got = seen.get(k)
        if got is None:
            seen[k] = [1, start, end]
        elif start > got[2]:
            got[0] += 1
            got[2] = end
    return [(k, n, s + 1) for k, (n, s, _) in seen.items()]


def _hits(a, words: list[str], texts: pa.Array) -> np.ndarray:
    """Rows (row, keyword's number, n, first) of a column of texts."""
    out = [np.zeros((0, 4), np.int32)]
    for at in range(0, len(texts), SLICE):
        found = [(at + k, *m) for k, t in enumerate(texts.slice(at, SLICE).to_pylist()) for m in matches_of(a, words, t)]
        out.append(np.array(found, np.int32).reshape(-1, 4))
    return np.concatenate(out)


def _as_lists(rows: int, names: list[pa.Array], hits: list[np.ndarray]) -> pa.Array:
    """The matches of a batch from the hits of each part."""
    words = pa.concat_arrays([w.take(pa.array(h[:, 1])) for w, h in zip(names, hits, strict=True)])
    flat = np.concatenate(hits)
    by = np.argsort(flat[:, 0], kind="stable")
    ends = np.searchsorted(flat[by, 0], np.arange(rows + 1)).astype(np.int32)
    parts = [words.take(pa.array(by)), pa.array(flat[by, 2]), pa.array(flat[by, 3])]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["keyword", "n", "first"]))


def match_batches(parts: list[tuple[str, pa.Array]], batches: Iterator[pa.RecordBatch], hold: int = HOLD) -> Iterator[pa.RecordBatch]:
    """``batches`` with ``_found``, the matches of ``_text`` with the keywords of all parts (token, keywords)."""
    order, names = list(range(len(parts))), [w for _, w in parts]
    held, size = [], 0

    def matched():
        hits = [[None] * len(parts) for _ in held]
        for k in order:
            a, words = automaton(*parts[k])
            for mine, batch in zip(hits, held, strict=True):
                mine[k] = _hits(a, words, batch.column("_text"))
        order.reverse()                            # the next texts begin with the automaton at hand
        for mine, batch in zip(hits, held, strict=True):
            yield pa.RecordBatch.from_arrays([*batch.columns, _as_lists(batch.num_rows, names, mine)], names=[*batch.schema.names, "_found"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= hold or len(parts) == 1:
            yield from matched()
            held, size = [], 0
    if held:
        yield from matched()


def keyword_parts(keywords: DataFrame, ignore_case: bool = True, part_bytes: int = PART_BYTES) -> Iterator[list[str]]:
    """The distinct keywords in parts of bounded size; one part at a time is collected."""
    word, spark = F.col(keywords.columns[0]), keywords.sparkSession
    path = scratch_path(spark, "keywords")
    keywords.select((F.lower(word) if ignore_case else word).alias("w")).where("w is not null and w <> ''").distinct().write.parquet(path)
    words = spark.read.schema("w string").parquet(path)
    total = words.agg(F.sum(F.octet_length("w"))).first()[0] or 0
    n = -(-total // part_bytes)
    for k in range(n):
        yield [r["w"] for r in words.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k).collect()]


def with_matches(df: DataFrame, text_col: str, keywords: DataFrame, out: str = "matches", ignore_case: bool = True,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` with array<struct<keyword, n, first>> of the keywords (first column of ``keywords``) in
    ``text_col``, by first position and keyword.  Row-local: no shuffle, any number of keywords."""
    spark = df.sparkSession
    text = F.coalesce(F.lower(text_col) if ignore_case else F.col(text_col), F.lit(""))
    own = df.columns
    x = df.withColumn("_text", text)
    ship(spark)
    tables = [(uuid.uuid4().hex, spark.sparkContext.broadcast(pa.array(words, pa.string())))
              for words in keyword_parts(keywords, ignore_case, part_bytes)]
    if tables:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return match_batches([(token, table.value) for token, table in tables], batches)

        schema = T.StructType([*x.schema.fields, T.StructField("_found", T._parse_datatype_string(MATCHES))])
        x = x.mapInArrow(run, schema)
    else:
        x = x.withColumn("_found", F.array().cast(MATCHES))
    order = F.array_sort(F.transform("_found", lambda m: F.struct(m["first"].alias("first"), m["keyword"].alias("keyword"), m["n"].alias("n"))))
    done = F.transform(order, lambda m: F.struct(m["keyword"].alias("keyword"), m["n"].alias("n"), m["first"].alias("first")))
    return x.select(*own, done.alias(out))


def keyword_hits(df: DataFrame, key: str, text_col: str, keywords: DataFrame, **options) -> DataFrame:
    """A row (key, keyword, n, first) for every keyword that occurs in a post."""
    x = with_matches(df.select(key, text_col), text_col, keywords, **options)
    return x.select(key, F.explode("matches").alias("m")).select(key, "m.keyword", "m.n", "m.first")


def snippet(text, first, keyword, radius: int = C.SNIPPET_RADIUS):
    """The text around a match, with ... where it is cut."""
    lo = F.greatest(first - radius, F.lit(1))
    hi = F.least(first + F.length(keyword) + radius, F.length(text) + 1)
    return F.concat(F.when(lo > 1, "...").otherwise(""), F.substring(text, lo, hi - lo), F.when(hi <= F.length(text), "...").otherwise(""))


def rule_hits(df: DataFrame, key: str, text_col: str, rules: DataFrame, **options) -> DataFrame:
    """F2 for a table of rules: a row (rule_id, key) for every rule that a post meets.

    ``rules`` (rule_id, place, text, condition): place 0 is the region keyword, which must occur; so
    must all AND keywords, and some OR keyword where a rule has any.  Keywords without text are left
    out; a rule without a region keyword is never met."""
    r = rules.where("text is not null and text <> ''").select(
        "rule_id", F.lower("text").alias("keyword"),
        F.when(F.col("place") == 0, "region").otherwise(F.lower("condition")).alias("kind")).distinct()
    needs = r.groupBy("rule_id").agg(F.count_if(F.col("kind") == "and").alias("n_and"), F.count_if(F.col("kind") == "or").alias("n_or"))
    hits = keyword_hits(df, key, text_col, r.select("keyword"), **options)
    if (r.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0) <= PART_BYTES:
        r = F.broadcast(r)                         # else a keyword that most posts hold moves to one task's rules
    met = (hits.join(r, "keyword").groupBy("rule_id", key)
           .agg(F.count_if(F.col("kind") == "region").alias("region"), F.count_if(F.col("kind") == "and").alias("ands"),
                F.count_if(F.col("kind") == "or").alias("ors")))
    return (met.where("region > 0").join(needs, "rule_id").where("ands = n_and and (ors > 0 or n_or = 0)")
            .select("rule_id", key))
