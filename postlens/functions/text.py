"""Text scalars (T1-T12) as native column expressions.

Python's ``\\w`` and ``\\s`` are Unicode-aware while Java's are ASCII, so the classes below spell
them out; the same patterns run unchanged in DuckDB (RE2), which keeps the SQL oracles exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens import config as C

WORD = "[\\p{L}\\p{N}_]"
BLANK_CHARS = "\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}"
BLANK = f"[{BLANK_CHARS}]"

# fixed values: patterns of what cleaning removes
TAG_RE = "<[^>]+>"
URL_RE = "http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\\\(\\\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL_RE = "[\\p{L}\\p{N}_.-]+@[\\p{L}\\p{N}_.-]+\\.[\\p{L}\\p{N}_]+"
SPECIAL_RE = f"[^\\p{{L}}\\p{{N}}_{BLANK_CHARS}.,!?]"
SENTENCE_SPLIT_RE = "[.!?]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# the characters of BLANK, listed (ASCII controls, NEL, and the Unicode space separators Zs/Zl/Zp)
BLANK_SET = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\x20\xa0\u1680"
             + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip_blank(c) -> Column:
    """Python ``str.strip()``: removes Unicode blanks at both ends.  ``trim`` with an explicit
    character set touches only the ends (a ``^blank+|blank+$`` regex scans the whole text)."""
    return F.trim(_c(c), F.lit(BLANK_SET))


def collapse_blank(c) -> Column:
    return F.regexp_replace(_c(c), f"{BLANK}+", " ")


def word_count(c) -> Column:
    """``len(text.split())``."""
    return F.size(F.regexp_extract_all(_c(c), F.lit(f"[^{BLANK_CHARS}]+"), 0))


def is_blank(c) -> Column:
    """no non-blank character (stops at the first one; no rewrite of the text)"""
    return ~_c(c).rlike(f"[^{BLANK_CHARS}]")


def _when_has(t: Column, marker: str, expr: Column) -> Column:
    """apply ``expr`` only to texts holding ``marker`` (a cheap substring test skips the regex)"""
    return F.when(F.contains(t, F.lit(marker)), expr).otherwise(t)


def basic_clean(c) -> Column:
    """T1 step 1: tags -> '', URLs -> ' ', e-mails -> ' ', keep word chars, blanks and .,!?,
    collapse blanks, strip.

    Evaluated as: each of the three removals only on texts holding '<', 'http', '@'; then one
    pass replacing every run of characters that are neither word characters nor ``.,!?`` by one
    space (special characters become blanks and blank runs collapse, in one step); then ``trim``
    (only plain spaces can remain at the ends).  The SQL oracle runs the literal six steps.
    """
    t = _c(c)
    t = _when_has(t, "<", F.regexp_replace(t, TAG_RE, ""))
    t = _when_has(t, "http", F.regexp_replace(t, URL_RE, " "))
    t = _when_has(t, "@", F.regexp_replace(t, EMAIL_RE, " "))
    t = F.regexp_replace(t, f"[^\\p{{L}}\\p{{N}}_.,!?]+", " ")
    return F.trim(t)


def first_chunk(c, max_tokens: int = C.MAX_TOKENS, min_tokens: int = C.MIN_TEXT_LENGTH) -> Column:
    """T2 greedy sentence packing, first chunk only, as a native fold (no UDF).

    Sentences are cut at ``[.!?]+``, stripped, blanks dropped; a sentence costs ``len // 4`` tokens.
    Sentences join the current chunk while the sum stays <= ``max_tokens``; a full chunk counts
    only if it holds >= ``min_tokens`` tokens.  Returns null when no chunk qualifies.
    """
    sentences = F.filter(F.transform(F.split(_c(c), SENTENCE_SPLIT_RE), strip_blank),
                         lambda s: F.length(s) > 0)
    zero = F.struct(F.lit(None).cast("string").alias("first"),
                    F.lit(None).cast("string").alias("cur"),
                    F.lit(0).alias("n"))

    def step(acc, s):
        t = F.floor(F.length(s) / 4).cast("int")
        overflow = acc["n"] + t > max_tokens
        return (F.when(acc["first"].isNotNull(), acc)
                .when(overflow, F.struct(F.when(acc["n"] >= min_tokens, acc["cur"]).alias("first"),
                                         s.alias("cur"), t.alias("n")))
                .otherwise(F.struct(F.lit(None).cast("string").alias("first"),
                                    F.concat_ws(" ", acc["cur"], s).alias("cur"),
                                    (acc["n"] + t).alias("n"))))

    def finish(acc):
        return F.coalesce(acc["first"], F.when(acc["n"] >= min_tokens, acc["cur"]))

    return F.aggregate(sentences, zero, step, finish)


def chunk_long(cleaned, max_len: int = C.MAX_TEXT_LENGTH) -> Column:
    """T2 on cleaned text: longer than ``max_len`` -> first qualifying chunk, else its first
    ``max_len`` characters; shorter text unchanged."""
    t = _c(cleaned)
    return F.when(F.length(t) > max_len,
                  F.coalesce(first_chunk(t), F.substring(t, 1, max_len))).otherwise(t)


def preprocess(c, max_len: int = C.MAX_TEXT_LENGTH) -> Column:
    """T1 + T2 as one expression (the cleaned text is evaluated more than once; prefer
    ``with_preprocessed`` on DataFrames)."""
    return chunk_long(basic_clean(c), max_len)


def with_preprocessed(df, src: str, dst: str, mode: str = "whole", max_len: int = C.MAX_TEXT_LENGTH):
    """T1, then T2 by ``mode``: "whole" keeps all of the cleaned text (a score over word counts is the
    same as over all of its chunks together), "first_chunk" keeps T2's first chunk of long texts.
    Two projections, so the cleaning regexes run once per row."""
    if mode == "whole":
        return df.withColumn(dst, basic_clean(src))
    if mode != "first_chunk":
        raise ValueError(f"no such mode: {mode}")
    return (df.withColumn("_clean", basic_clean(src))
            .withColumn(dst, chunk_long("_clean", max_len)).drop("_clean"))


def clean_capped(c, cap: int = C.SCORER_TEXT_CAP) -> Column:
    """T1 then a character cap (scorer input)."""
    return F.substring(basic_clean(c), 1, cap)


def clean_title(c) -> Column:
    """Drop emoji, tags, nbsp and zero-width space; collapse blanks; strip."""
    t = F.regexp_replace(_c(c), C.EMOJI_CLASS, "")
    t = F.regexp_replace(t, TAG_RE, "")
    t = F.regexp_replace(t, "&nbsp;|\\x{00A0}", " ")
    t = F.regexp_replace(t, "\\x{200B}", "")
    return strip_blank(collapse_blank(t))


def clean_html_entities(c) -> Column:
    """T4: strip tags, then entities in fixed order, collapse blanks, strip."""
    t = F.regexp_replace(_c(c), TAG_RE, "")
    for ent, rep in C.HTML_ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(rep))
    return strip_blank(collapse_blank(t))


def token_estimate(c) -> Column:
    """``len(text) // 4``."""
    return F.floor(F.length(_c(c)) / 4).cast("int")


def safe_keyword(c) -> Column:
    """Drop non-word, non-blank characters, blanks -> '_'."""
    return F.replace(F.regexp_replace(_c(c), f"[^\\p{{L}}\\p{{N}}_{BLANK_CHARS}]", ""),
                     F.lit(" "), F.lit("_"))


def fixed_pieces(c, size: int = C.FIXED_CHUNK_SIZE) -> Column:
    """Array of consecutive ``size``-character pieces covering the whole text."""
    n = F.greatest(F.floor((F.length(_c(c)) - 1) / size), F.lit(0)).cast("int")
    return F.when(F.length(_c(c)) > 0,
                  F.transform(F.sequence(F.lit(0), n),
                              lambda i: F.substring(_c(c), i * size + 1, size))
                  ).otherwise(F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row.  Branches of AND, OR and CASE are short-circuit,
    so an expression repeated in them is not shared by the optimizer."""
    return F.element_at(F.transform(F.array(value), use), 1)


def holds(low: Column, word: str) -> Column:
    """substring test of a lower-cased text against a literal"""
    return F.contains(low, F.lit(word.lower()))


def tokens(c) -> Column:
    """lower-cased word tokens of >= 1 character"""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(f"{WORD}+"), 0)


def query_variations(region, ands, ors, max_n: int | None = None) -> Column:
    """Search-query variants from a region keyword, AND keywords and OR keywords (arrays).

    With AND keywords: base = region + all ANDs; base alone when there is no OR keyword, else base
    + each OR, plus base + all ORs when there is more than one.  Without AND keywords: region, and
    region + each OR.  With ``max_n`` (W11: an API quota) only the first ``max_n`` variants are
    kept, before duplicates are removed (U2)."""
    region, ands, ors = _c(region), _c(ands), _c(ors)
    base = F.concat_ws(" ", region, F.array_join(ands, " "))
    with_and = F.when(F.size(ors) == 0, F.array(base)).otherwise(F.concat(
        F.transform(ors, lambda o: F.concat_ws(" ", base, o)),
        F.when(F.size(ors) > 1, F.array(F.concat_ws(" ", base, F.array_join(ors, " "))))
        .otherwise(F.array().cast("array<string>"))))
    without_and = F.concat(F.array(region), F.transform(ors, lambda o: F.concat_ws(" ", region, o)))
    v = F.when(F.size(ands) > 0, with_and).otherwise(without_and)
    if max_n is not None:
        v = F.slice(v, 1, max(1, max_n))
    return F.array_distinct(v)


def keywords_string(words) -> Column:
    """Keywords as one command-line string; blank ones dropped, ones holding a space quoted."""
    kept = F.filter(F.transform(_c(words), strip_blank), lambda k: k != "")
    return F.array_join(F.transform(kept, lambda k: F.when(F.contains(k, F.lit(" ")),
                                                           F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)), " ")
