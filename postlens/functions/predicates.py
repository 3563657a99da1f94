"""Filters and predicates (F1-F15) as boolean column expressions.

Keyword rules are folded at plan time from literal keyword lists, so Catalyst sees one boolean
expression per row (constant folding, short-circuit ``AND``/``OR``), not a per-row Python loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import text as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(cols) -> Column:
    cols = list(cols)
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _all(cols) -> Column:
    cols = list(cols)
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def split_keywords(spec):
    """(region, and_words, or_words) from keyword objects [(text, condition), ...]."""
    if not spec:
        return None, [], []
    region = spec[0][0]
    ands = [t for t, cond in spec[1:] if cond == "AND" and t]
    ors = [t for t, cond in spec[1:] if cond == "OR" and t]
    return region, ands, ors


def keyword_match_strict(text, spec=C.KEYWORD_SPEC) -> Column:
    """region keyword AND every AND keyword AND (any OR keyword when there are any);
    case-insensitive; blank text or no keywords -> false."""
    t = _c(text)
    region, ands, ors = split_keywords(spec)
    if not region:
        return F.lit(False)

    def cond(low: Column) -> Column:
        met = T.holds(low, region) & _all(T.holds(low, k) for k in ands)
        return met & _any(T.holds(low, k) for k in ors) if ors else met

    return F.coalesce(F.when(t.isNotNull() & (t != ""), T.let(F.lower(t), cond)), F.lit(False))


def keyword_match_loose(text, spec=C.KEYWORD_SPEC) -> Column:
    """any AND keyword (when there are AND keywords); then any OR keyword, required only
    when AND keywords exist; case-insensitive over all keyword objects."""
    t = _c(text)
    ands = [k for k, cond in spec if cond == "AND" and k]
    ors = [k for k, cond in spec if cond == "OR" and k]
    if not spec:
        return F.lit(False)

    def cond(low: Column) -> Column:
        if not ands:
            return F.lit(True)
        met = _any(T.holds(low, k) for k in ands)
        return met & _any(T.holds(low, k) for k in ors) if ors else met

    return F.coalesce(F.when(t.isNotNull() & (t != ""), T.let(F.lower(t), cond)), F.lit(False))


def contains_all(text, words) -> Column:
    """every word is a case-insensitive substring; the text is lower-cased once."""
    words = list(words)
    return T.let(F.lower(_c(text)), lambda low: _all(T.holds(low, w) for w in words))


def contains_any(text, words) -> Column:
    """some word is a case-insensitive substring."""
    words = list(words)
    return T.let(F.lower(_c(text)), lambda low: _any(T.holds(low, w) for w in words))


def postprocess_keep(title, content, required=C.REQUIRED_KEYWORDS,
                     excluded=C.EXCLUDED_KEYWORDS) -> Column:
    """keep if some required keyword occurs and no excluded keyword occurs in
    ``title + ' ' + content`` (case-insensitive)."""
    full = F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(content), F.lit("")))

    def keep(low: Column) -> Column:
        met = _any(T.holds(low, w) for w in required) if required else F.lit(True)
        return met & ~_any(T.holds(low, w) for w in excluded) if excluded else met

    return T.let(F.lower(full), keep)


def sentiment_eligibility(c) -> Column:
    """(valid, reason).  < 30 characters, an excluded keyword, or < 2 words -> invalid."""
    t = _c(c)
    reason = (F.when(t.isNull(), F.lit("not_text"))
              .when(F.length(t) < C.MIN_TEXT_LENGTH, F.lit("too_short"))
              .when(contains_any(t, C.EXCLUDE_KEYWORDS), F.lit("excluded_keyword"))
              .when(T.word_count(t) < C.MIN_SENTIMENT_WORDS, F.lit("too_few_words"))
              .otherwise(F.lit("ok")))
    return F.struct((reason == "ok").alias("valid"), reason.alias("reason"))


def content_valid(p) -> Column:
    """a cleaned text has >= 30 characters, >= 3 words and no excluded keyword, all of it judged."""
    p = _c(p)
    return F.coalesce((F.length(p) >= C.MIN_TEXT_LENGTH) & (T.word_count(p) >= C.MIN_CONTENT_WORDS)
                      & ~contains_any(p, C.EXCLUDE_KEYWORDS), F.lit(False))


def script_char_count(c, char_class: str = "[가-힣]") -> Column:
    return F.size(F.regexp_extract_all(_c(c), F.lit(char_class), 0))


def script_char_ok(c, min_chars: int = 50, char_class: str = "[가-힣]") -> Column:
    """F8: at least ``min_chars`` characters of a script class (Hangul by default)."""
    return F.coalesce(script_char_count(c, char_class) >= min_chars, F.lit(False))


def not_blank(c) -> Column:
    """content present and not blank."""
    return F.coalesce(~T.is_blank(_c(c)), F.lit(False))


def region_flag(c, keywords=C.REGION_KEYWORDS) -> Column:
    """any region keyword occurs (case-sensitive)."""
    return F.coalesce(_any(F.contains(_c(c), F.lit(k)) for k in keywords), F.lit(False))
