"""Projections and record shaping (P1-P19) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens import config as C


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# video-id URL shapes, first match wins (fixed values)
VIDEO_ID_PATTERNS = [
    "(?:youtube\\.com/watch\\?v=|youtu\\.be/)([^&\\n?]+)",
    "youtube\\.com/embed/([^&\\n?]+)",
    "youtube\\.com/v/([^&\\n?]+)",
    "youtube\\.com/watch\\?.*&v=([^&\\n?]+)",
]


def video_id(url) -> Column:
    """Id from the first matching URL shape, else ``video_`` + the address's crc32 in 8 hex digits."""
    u = _c(url)
    found = [F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in VIDEO_ID_PATTERNS]
    return F.when(u.isNull() | (u == ""), F.lit("")).otherwise(
        F.coalesce(*found, F.concat(F.lit("video_"), F.lower(F.lpad(F.hex(F.crc32(u)), 8, "0")))))


def doc_key(*parts) -> Column:
    """SHA-256 hex of the concatenated parts."""
    return F.sha2(F.concat(*[F.coalesce(_c(p), F.lit("")) for p in parts]), 256)


def label_name(c) -> Column:
    """0/1/2 -> negative/neutral/positive; anything else -> neutral."""
    m = F.create_map(*[x for k, v in C.LABEL_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(c).cast("int")), F.lit("neutral"))


def label_code(c) -> Column:
    """P8 reverse map: name -> code; unknown -> 1."""
    m = F.create_map(*[x for k, v in C.LABEL_NAMES.items() for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.element_at(m, _c(c)), F.lit(1))


def label_color(c) -> Column:
    m = F.create_map(*[x for k, v in C.LABEL_COLORS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, label_name(c))


def label_bucket(c) -> Column:
    """A4 bucket: ints or names; null or anything else -> unknown."""
    s = _c(c).cast("string")
    return (F.when(s.isNull(), F.lit("unknown"))
            .when(s.isin("0", "negative"), F.lit("negative"))
            .when(s.isin("1", "neutral"), F.lit("neutral"))
            .when(s.isin("2", "positive"), F.lit("positive"))
            .otherwise(F.lit("unknown")))


def platform_parent(c) -> Column:
    """Name -> its platform; any other naver_ name -> naver; unknown -> null (rejected)."""
    p = F.lower(_c(c))
    alias = F.create_map(*[x for k, v in C.PLATFORM_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return (F.when(p.isin(*C.PLATFORM_PARENTS), p)
            .otherwise(F.coalesce(F.element_at(alias, p), F.when(p.startswith("naver_"), F.lit("naver")))))


def json_field(c, path: str) -> Column:
    """Value at a dotted path of a JSON record, '' where any step is absent."""
    return F.coalesce(F.get_json_object(_c(c), "$." + path), F.lit(""))


# fixed values: where a blog post's address holds its blog and its number
BLOG_ID_RE = "blog\\.naver\\.com/([^/]+)"
LOG_NO_RE = "logNo=([0-9]+)"


def normalize_url(url) -> Column:
    """P5: mobile host -> desktop host (``//m.`` -> ``//``)."""
    return F.regexp_replace(_c(url), "//m\\.", "//")


def url_site_class(url) -> Column:
    """P5: extractor class picked by host."""
    u = _c(url)
    return (F.when(F.contains(u, F.lit("news.naver.com")), F.lit("naver_news"))
            .when(F.contains(u, F.lit("blog.naver.com")), F.lit("naver_blog"))
            .when(F.contains(u, F.lit("cafe.naver.com")), F.lit("naver_cafe"))
            .otherwise(F.lit("general")))


def url_host(url) -> Column:
    return F.regexp_extract(_c(url), "^[a-zA-Z]+://([^/?#:]+)", 1)


def url_query_param(url, name: str) -> Column:
    """Value of a query parameter, '' when absent."""
    return F.regexp_extract(_c(url), f"[?&]{name}=([^&#]*)", 1)


def youtube_prefix(url) -> Column:
    """P1 youtube URL: prefix only when the value is not already a URL."""
    u = _c(url)
    return F.when(u.rlike("^https?://"), u).otherwise(
        F.concat(F.lit("https://www.youtube.com/watch?v="), u))


def kwic(content, keywords=C.REGION_KEYWORDS, radius: int = C.SNIPPET_RADIUS) -> Column:
    """Snippet around the first listed keyword that occurs (case-sensitive), ``radius``
    characters each side, '...' on a cut side; null when none occurs."""
    t = _c(content)
    out = None
    for k in reversed(keywords):
        idx = F.instr(t, k) - 1
        start = F.greatest(idx - radius, F.lit(0))
        end = F.least(F.length(t), idx + len(k) + radius)
        snip = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
                        F.substring(t, start + 1, end - start),
                        F.when(end < F.length(t), F.lit("...")).otherwise(F.lit("")))
        branch = F.when(F.instr(t, k) > 0, snip)
        out = branch if out is None else branch.otherwise(out)
    return out


def excerpt(c, n: int = C.EXCERPT_LENGTH) -> Column:
    """First n characters + '...'."""
    return F.concat(F.substring(_c(c), 1, n), F.lit("..."))


def first_metatag(metatags, name: str) -> Column:
    """The value in the first of an array of tag maps that holds ``name``"""
    held = F.filter(_c(metatags), lambda t: F.map_contains_key(t, name))
    return F.element_at(F.get(held, F.lit(0)), name)


def blog_view_url(url) -> Column:
    """The address of a blog post's own page, from its blog id and ``logNo``; '' without both"""
    blog = F.regexp_extract(_c(url), BLOG_ID_RE, 1)
    no = F.regexp_extract(_c(url), LOG_NO_RE, 1)
    return F.when((blog != "") & (no != ""), F.concat(F.lit("https://blog.naver.com/PostView.naver?blogId="), blog,
                                                     F.lit("&logNo="), no)).otherwise(F.lit(""))
