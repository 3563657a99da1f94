"""DuckDB SQL fragments that mirror the Spark column functions, for the oracle queries.

Each builder takes a SQL expression string and returns a SQL expression string.  They are kept
side by side with the Spark functions' rules (same patterns, same order of steps).
"""

from __future__ import annotations

from postlens import config as C
from postlens.functions import dates as D
from postlens.functions import shape as S
from postlens.functions import text as T
from postlens.sources import tables as TB


def q(s: str) -> str:
    """SQL string literal"""
    return "'" + s.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def rx_replace(e: str, pattern: str, rep: str) -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(rep)}, 'g')"


def strip_blank(e: str) -> str:
    return rx_replace(e, f"^{T.BLANK}+|{T.BLANK}+$", "")


def collapse_blank(e: str) -> str:
    return rx_replace(e, f"{T.BLANK}+", " ")


def word_count(e: str) -> str:
    return f"len(regexp_extract_all({e}, {q('[^' + T.BLANK_CHARS + ']+')}))"


def basic_clean(e: str) -> str:
    t = rx_replace(e, T.TAG_RE, "")
    t = rx_replace(t, T.URL_RE, " ")
    t = rx_replace(t, T.EMAIL_RE, " ")
    t = rx_replace(t, T.SPECIAL_RE, " ")
    return strip_blank(collapse_blank(t))


def first_chunk(e: str, max_tokens: int = C.MAX_TOKENS, min_tokens: int = C.MIN_TEXT_LENGTH) -> str:
    sentences = (f"list_filter(list_transform(regexp_split_to_array({e}, {q(T.SENTENCE_SPLIT_RE)}), "
                 f"lambda s: {strip_blank('s')}), lambda s: length(s) > 0)")
    t = "(length(x) // 4)::INTEGER"
    step = (f"lambda acc, x: CASE WHEN acc.first IS NOT NULL THEN acc "
            f"WHEN acc.n + {t} > {max_tokens} THEN "
            f"{{'first': CASE WHEN acc.n >= {min_tokens} THEN acc.cur END, 'cur': x, 'n': {t}}} "
            f"ELSE {{'first': NULL::VARCHAR, 'cur': concat_ws(' ', acc.cur, x), 'n': acc.n + {t}}} END")
    zero = "{'first': NULL::VARCHAR, 'cur': NULL::VARCHAR, 'n': 0}"
    acc = f"list_reduce({sentences}, {step}, {zero})"
    return f"(SELECT coalesce(a.first, CASE WHEN a.n >= {min_tokens} THEN a.cur END) FROM (SELECT {acc} AS a))"


def preprocess(e: str, max_len: int = C.MAX_TEXT_LENGTH) -> str:
    c = basic_clean(e)
    return (f"(SELECT CASE WHEN length(c) > {max_len} THEN coalesce({first_chunk('c')}, left(c, {max_len})) "
            f"ELSE c END FROM (SELECT {c} AS c))")


def tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {q(T.WORD + '+')})"


def contains_ci(e: str, word: str) -> str:
    return f"contains(lower({e}), {q(word.lower())})"


def contains_any(e: str, words) -> str:
    return "(" + " OR ".join(contains_ci(e, w) for w in words) + ")" if words else "false"


def label_name(e: str) -> str:
    return (f"coalesce(CASE ({e})::INTEGER WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' "
            f"WHEN 2 THEN 'positive' END, 'neutral')")


def label_bucket(e: str) -> str:
    s = f"CAST({e} AS VARCHAR)"
    return (f"CASE WHEN {s} IS NULL THEN 'unknown' WHEN {s} IN ('0','negative') THEN 'negative' "
            f"WHEN {s} IN ('1','neutral') THEN 'neutral' WHEN {s} IN ('2','positive') THEN 'positive' "
            f"ELSE 'unknown' END")


def eligibility_reason(e: str) -> str:
    return (f"CASE WHEN {e} IS NULL THEN 'not_text' WHEN length({e}) < {C.MIN_TEXT_LENGTH} THEN 'too_short' "
            f"WHEN {contains_any(e, C.EXCLUDE_KEYWORDS)} THEN 'excluded_keyword' "
            f"WHEN {word_count(e)} < {C.MIN_SENTIMENT_WORDS} THEN 'too_few_words' ELSE 'ok' END")


def rule_score(e: str) -> str:
    """struct(label, confidence) of the native rule scorer, with fallbacks"""
    toks = tokens(e)
    n = f"greatest(len({toks}), 1)::DOUBLE"
    npos = f"len(list_filter({toks}, lambda x: list_contains({arr(C.POSITIVE_WORDS)}, x)))::DOUBLE"
    nneg = f"len(list_filter({toks}, lambda x: list_contains({arr(C.NEGATIVE_WORDS)}, x)))::DOUBLE"
    sc = C.RULE_SCORE_SCALE
    lg = f"[{nneg} * {sc} / {n}, 1.0::DOUBLE, {npos} * {sc} / {n}]"
    head = argmax_head(lg)
    blank = f"({e} IS NULL OR length({strip_blank(e)}) = 0)"
    return (f"(SELECT CASE WHEN {blank} THEN {{'label': 1, 'confidence': 0.0::DOUBLE}} "
            f"WHEN h.confidence < {C.LOW_CONFIDENCE_FALLBACK} THEN {{'label': 1, 'confidence': 0.0::DOUBLE}} "
            f"ELSE h END FROM (SELECT {head} AS h))")


def plain_rule_score(e: str) -> str:
    """struct(label, confidence) of the rule scorer itself, as a plug-in gives it"""
    toks = tokens(e)
    n = f"greatest(len({toks}), 1)::DOUBLE"
    npos = f"len(list_filter({toks}, lambda x: list_contains({arr(C.POSITIVE_WORDS)}, x)))::DOUBLE"
    nneg = f"len(list_filter({toks}, lambda x: list_contains({arr(C.NEGATIVE_WORDS)}, x)))::DOUBLE"
    sc = C.RULE_SCORE_SCALE
    return argmax_head(f"[{nneg} * {sc} / {n}, 1.0::DOUBLE, {npos} * {sc} / {n}]")


def argmax_head(lg: str) -> str:
    return (f"(SELECT {{'label': (list_position(p, list_max(p)) - 1)::INTEGER, 'confidence': list_max(p)}} "
            f"FROM (SELECT list_transform(e, lambda x: x / list_sum(e)) AS p FROM "
            f"(SELECT list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM (SELECT {lg} AS l))))")


# ---------------------------------------------------------------- dates

def strptime_date(e: str, fmt: str) -> str:
    rx, order = D.strptime_regex(fmt)
    part = {f: f"trim(regexp_extract({e}, {q(rx)}, {k + 1}))" for k, f in enumerate(order)}
    iso = f"concat_ws('-', {part['Y']}, lpad({part['m']}, 2, '0'), lpad({part['d']}, 2, '0'))"
    return f"CASE WHEN regexp_full_match({e}, {q(rx)}) THEN TRY_CAST({iso} AS DATE) END"


def first_format(e: str, fmts) -> str:
    return "coalesce(" + ", ".join(strptime_date(e, f) for f in fmts) + ")"


def ymd(e: str) -> str:
    return f"strftime({e}, '%Y%m%d')"


def as_of(d=C.AS_OF) -> str:
    return f"DATE '{d.isoformat()}'"


# ---------------------------------------------------------------- adapters

def posts_cte() -> str:
    plats = arr(TB.ADAPTER_PLATFORMS)
    first_line = "split_part(d.text, chr(10), 1)"
    noisy = ("'<b>Note</b> see https://www.example.org/post/' || d.doc_id || ' or mail user' || d.doc_id "
             "|| '@mail.example.com ' || d.text")
    base = (f"CASE WHEN d.doc_id % 50 = 49 THEN DATE '1999-12-31' "
            f"ELSE DATE '{TB.DATE_EPOCH}' + CAST(d.doc_id * 7 % {TB.DATE_SPAN_DAYS} AS INTEGER) END")
    ymd_ = "strftime(b.base_date, '%Y-%m-%d')"
    y, m, dd = f"substr({ymd_}, 1, 4)", f"substr({ymd_}, 6, 2)", f"substr({ymd_}, 9, 2)"
    date_text = (f"CASE b.doc_id % 8 WHEN 0 THEN {y} || {m} || {dd} WHEN 1 THEN {ymd_} "
                 f"WHEN 2 THEN replace({ymd_}, '-', '.') WHEN 3 THEN replace({ymd_}, '-', '/') "
                 f"WHEN 4 THEN {y} || '년' || {m} || '월' || {dd} || '일' "
                 f"WHEN 5 THEN {ymd_} || ' 12:34:56' WHEN 6 THEN '' ELSE 'not a date' END")
    return f"""posts AS (
  SELECT b.doc_id, b.ingest_seq, b.platform, b.title, b.content, b.url, {date_text} AS date_text,
         b.base_date, b.crawled_at, b.keyword, b.keywords, b.lang, b.source, b.sentiment, b.confidence
  FROM (
    SELECT d.doc_id, d.doc_id AS ingest_seq, ({plats})[d.doc_id % 7 + 1] AS platform,
      {first_line} AS title,
      CASE WHEN d.doc_id % 10 = 0 THEN {noisy} ELSE d.text END AS content,
      CASE WHEN d.doc_id % 7 = 3 THEN 'https://www.youtube.com/watch?v=v' || d.doc_id
           ELSE 'https://' || d.source || '.example.com/' || d.doc_id END AS url,
      {base} AS base_date,
      CAST({base} AS TIMESTAMP) + to_hours(CAST(d.doc_id % 24 AS INTEGER)) AS crawled_at,
      d.lang AS keyword,
      d.text AS keywords,
      d.lang, d.source,
      CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 WHEN l.quality IS NOT NULL THEN 1 END AS INTEGER) AS sentiment,
      (d.doc_id * 37 % 101) / 100.0::DOUBLE AS confidence
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) b
)"""


def votes_cte() -> str:
    """votes of the members over posts (needs posts)"""
    rows = ", ".join(f"({i}, {q(m)}, {C.MODEL_RULES[m][0]}::DOUBLE, {C.MODEL_RULES[m][1]}::DOUBLE, {C.MODEL_RULES[m][2]}::DOUBLE)"
                     for i, m in enumerate(C.MODEL_NAMES))

    def n_of(words, group):
        picked = arr([w for w in words if (w in C.GERMANIC_WORDS) == group])
        return f"len(list_filter(toks, lambda x: list_contains({picked}, x)))::DOUBLE"

    head = argmax_head("[(ng * m.g + nr * m.r) * m.scale / n, 1.0::DOUBLE, (pg * m.g + pr * m.r) * m.scale / n]")
    return f"""vote_counts AS (
  SELECT doc_id, greatest(len(toks), 1)::DOUBLE AS n, {n_of(C.POSITIVE_WORDS, True)} AS pg, {n_of(C.POSITIVE_WORDS, False)} AS pr,
    {n_of(C.NEGATIVE_WORDS, True)} AS ng, {n_of(C.NEGATIVE_WORDS, False)} AS nr
  FROM (SELECT doc_id, {tokens('c')} AS toks FROM (SELECT doc_id, {basic_clean('content')} AS c FROM posts) WHERE length(c) > 0)),
votes AS (
  SELECT doc_id, model, model_ord, h.label AS label, round(h.confidence, 4) AS confidence FROM (
    SELECT t.doc_id, m.model, CAST(m.k AS INTEGER) AS model_ord, {head} AS h
    FROM vote_counts t CROSS JOIN (VALUES {rows}) m(k, model, scale, g, r)))"""


def comments_cte() -> str:
    return """comments AS (
  SELECT conv_id - conv_id % 7 + 3 AS video_key, (conv_id % 7) * 1000000 + turn AS turn, role AS author, text
  FROM conversations
)"""


def comment_labels_cte() -> str:
    """comments with the scorer's label (needs comments)"""
    return f"""labelled AS (SELECT video_key, turn, author, s.label AS label FROM (
  SELECT *, {rule_score('text')} AS s FROM comments))"""


def analyzed_cte() -> str:
    """M6 output over posts (needs posts)."""
    pre = basic_clean("content")
    return f"""analyzed AS (
  SELECT doc_id, title, c AS content, platform, date_text AS published_date, url,
         s.label AS sentiment, round(s.confidence, 6) AS confidence
  FROM (SELECT *, {rule_score('c')} AS s FROM
         (SELECT doc_id, title, platform, date_text, url, {pre} AS c FROM posts
          WHERE coalesce(length({strip_blank('content')}) > 0, false)) x
        WHERE length(c) > 0) y
)"""


def with_ctes(*ctes) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def kwic(e: str, keywords=C.REGION_KEYWORDS, radius: int = C.SNIPPET_RADIUS) -> str:
    parts = []
    for k in keywords:
        idx = f"(instr({e}, {q(k)}) - 1)"
        start = f"greatest({idx} - {radius}, 0)"
        end = f"least(length({e}), {idx} + {len(k)} + {radius})"
        snip = (f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || substr({e}, {start} + 1, {end} - {start}) "
                f"|| CASE WHEN {end} < length({e}) THEN '...' ELSE '' END)")
        parts.append(f"WHEN instr({e}, {q(k)}) > 0 THEN {snip}")
    return "CASE " + " ".join(parts) + " END"


def video_id(e: str) -> str:
    found = [f"nullif(regexp_extract({e}, {q(p)}, 1), '')" for p in S.VIDEO_ID_PATTERNS]
    return (f"CASE WHEN {e} IS NULL OR {e} = '' THEN '' ELSE coalesce({', '.join(found)}, "
            f"'video_' || {crc32_hex(e)}) END")


def crc32_hex(e: str) -> str:
    """crc32 of an ASCII text in 8 hex digits: eight shifts a byte"""
    byte = ("list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
            "lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)")
    crc = (f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({e}, ''), lambda x: unicode(x)::BIGINT)), "
           f"lambda c, b: {byte})")
    return f"printf('%08x', xor({crc}, 4294967295))"


def _starts(e: str) -> str:
    return f"(starts_with({e}, '12') OR starts_with({e}, '13') OR starts_with({e}, '14'))"


def parse_date_null(e: str, platform: str | None = None) -> str:
    cut = f"(regexp_full_match({e}, '^\\d{{8}}$') AND {_starts(e)})"
    if platform:
        cut = f"({cut} OR ({platform} = 'naver_news_api' AND {_starts(e)}))"
    s1 = f"(CASE WHEN {cut} THEN '20' || left({e}, 6) ELSE {e} END)"
    d = first_format(s1, D.FORMATS_NULL_POLICY)
    return (f"(SELECT CASE WHEN year(d) >= 2000 AND year(d) <= {C.AS_OF.year} THEN d END "
            f"FROM (SELECT {d} AS d))")


def _digits(e: str) -> str:
    return rx_replace(e, "[^0-9]", "")


def parse_date_today(e: str) -> str:
    s = strip_blank(e)
    today = ymd(as_of())
    return (f"(SELECT CASE WHEN r IS NULL OR r = '' THEN {today} "
            f"WHEN regexp_full_match(s, '^[0-9]{{8}}$') THEN s "
            f"ELSE coalesce({ymd(first_format('s', D.FORMATS_TODAY_POLICY))}, "
            f"CASE WHEN length({_digits('s')}) >= 8 THEN left({_digits('s')}, 8) END, {today}) END "
            f"FROM (SELECT {e} AS r, {s} AS s))")


def parse_date_relative(e: str) -> str:
    today = ymd(as_of())
    dd, yy, mm = "TRY_CAST(substr(s, 1, 2) AS INTEGER)", "TRY_CAST(substr(s, 3, 4) AS INTEGER)", \
        "TRY_CAST(substr(s, 7, 1) AS INTEGER)"
    ddyyyym = (f"CASE WHEN regexp_full_match(s, '^[0-9]{{7,}}$') AND {dd} BETWEEN 1 AND 31 "
               f"AND {yy} BETWEEN 2000 AND 2100 AND {mm} BETWEEN 1 AND 9 "
               f"THEN CAST({yy} AS VARCHAR) || lpad(CAST({mm} AS VARCHAR), 2, '0') || lpad(CAST({dd} AS VARCHAR), 2, '0') END")
    digits = _digits("s")
    n = f"(CASE WHEN length({digits}) BETWEEN 1 AND 9 THEN TRY_CAST({digits} AS INTEGER) END)"
    rel = (f"CASE WHEN (contains(s, '전') OR contains(s, '일')) AND {n} IS NOT NULL "
           f"AND {n} <= ({as_of()} - DATE '0001-01-01') THEN {ymd(f'({as_of()} - {n})')} END")
    return (f"(SELECT CASE WHEN s IS NULL OR s = '' THEN {today} WHEN regexp_full_match(s, '^[0-9]{{8}}$') THEN s "
            f"ELSE coalesce({ddyyyym}, {ymd(first_format('s', D.FORMATS_RELATIVE_POLICY))}, {rel}, {today}) END "
            f"FROM (SELECT {e} AS s))")


def parse_date_split(e: str) -> str:
    today = ymd(as_of())

    def z(p):
        return f"CASE WHEN length({p}) < 2 THEN lpad({p}, 2, '0') ELSE {p} END"

    def by(sep):
        parts = f"string_split(s, '{sep}')"
        p = [strip_blank(f"{parts}[{i}]") for i in (1, 2, 3)]
        return f"CASE WHEN len({parts}) >= 3 THEN {p[0]} || {z(p[1])} || {z(p[2])} END"

    return (f"(SELECT coalesce(CASE WHEN contains(s, '.') THEN coalesce({by('.')}, {today}) "
            f"WHEN contains(s, '-') THEN coalesce({by('-')}, {today}) "
            f"WHEN contains(s, '/') THEN coalesce({by('/')}, {today}) END, {today}) "
            f"FROM (SELECT {strip_blank(e)} AS s))")


def parse_date_trend(e: str) -> str:
    return first_format(e, D.FORMATS_TREND)
