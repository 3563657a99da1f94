"""Date scalars (D1-D11) as native column expressions with an explicit ``as_of`` date.

Python's ``strptime`` accepts one- or two-digit months and days and must consume the whole
string.  Each format is therefore rebuilt as an anchored regex from strptime's own field
patterns; the captured fields are validated by ``try_to_date`` (so 2024-02-30 fails like
strptime does).  Formats are tried in order and the first valid one wins (``coalesce``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import dategrammar as G
from postlens.functions.text import BLANK, strip_blank

# strptime field patterns (fixed values)
FIELD_RE = {
    "Y": "(\\d\\d\\d\\d)",
    "m": "(1[0-2]|0[1-9]|[1-9])",
    "d": "(3[01]|[12]\\d|0[1-9]|[1-9]| [1-9])",
    "H": "(?:2[0-3]|[0-1]\\d|\\d)",
    "M": "(?:[0-5]\\d|\\d)",
    "S": "(?:6[0-1]|[0-5]\\d|\\d)",
}

# format lists (fixed values, in the order each rule tries them)
FORMATS_NULL_POLICY = ["%Y%m%d", "%Y-%m-%d", "%Y.%m.%d", "%Y년%m월%d일", "%Y/%m/%d", "%d/%m/%Y",
                       "%m/%d/%Y"]
FORMATS_TODAY_POLICY = ["%Y-%m-%d %H:%M:%S", "%Y.%m.%d %H:%M:%S", "%Y-%m-%d", "%Y.%m.%d", "%Y%m%d",
                        "%Y년%m월%d일", "%Y년 %m월 %d일"]
FORMATS_RELATIVE_POLICY = ["%Y%m%d", "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y년%m월%d일",
                           "%Y년 %m월 %d일", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S"]
FORMATS_TREND = ["%Y%m%d", "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y년%m월%d일"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_date(d) -> Column:
    return F.lit(d.isoformat() if isinstance(d, _dt.date) else d).cast("date")


def strptime_regex(fmt: str) -> tuple[str, list[str]]:
    """Anchored regex for a strptime format and the order of its Y/m/d groups."""
    out, order, i = ["^"], [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            f = fmt[i + 1]
            out.append(FIELD_RE[f])
            if f in "Ymd":
                order.append(f)
            i += 2
            continue
        if ch.isspace():
            out.append(f"{BLANK}+")
        elif ch in ".^$*+?()[]{}|\\/-":
            out.append("\\" + ch)
        else:
            out.append(ch)
        i += 1
    out.append("$")
    return "".join(out), order


def strptime_date(c, fmt: str) -> Column:
    """Date parsed like ``datetime.strptime(s, fmt).date()``; null when strptime would raise."""
    rx, order = strptime_regex(fmt)
    s = _c(c)
    part = {f: F.trim(F.regexp_extract(s, rx, k + 1)) for k, f in enumerate(order)}
    iso = F.concat_ws("-", part["Y"], F.lpad(part["m"], 2, "0"), F.lpad(part["d"], 2, "0"))
    return F.when(s.rlike(rx), F.try_to_date(iso, "yyyy-MM-dd"))


def first_format(c, fmts) -> Column:
    return F.coalesce(*[strptime_date(c, f) for f in fmts])


def ymd(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def parse_date_null(c, platform=None, as_of=C.AS_OF) -> Column:
    """8 digits starting 12/13/14 read as YYMMDD.. (for naver news any such string), then the
    null-policy formats; year must be 2000..year(as_of); failure -> null.  Returns DATE."""
    s = _c(c)
    starts = s.startswith("12") | s.startswith("13") | s.startswith("14")
    cut = s.rlike("^\\d{8}$") & starts
    if platform is not None:
        cut = cut | ((_c(platform) == "naver_news_api") & starts)
    s1 = F.when(cut, F.concat(F.lit("20"), F.substring(s, 1, 6))).otherwise(s)
    d = first_format(s1, FORMATS_NULL_POLICY)
    return F.when((F.year(d) >= 2000) & (F.year(d) <= as_of.year), d)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def parse_date_today(c, as_of=C.AS_OF) -> Column:
    """Strip; 8 digits kept as text; today-policy formats; else first 8 of all digits;
    else as_of.  Returns 'yyyyMMdd' text."""
    raw = _c(c)
    s = strip_blank(raw)
    digits = _digits(s)
    return (F.when(raw.isNull() | (raw == ""), ymd(_lit_date(as_of)))
            .when(s.rlike("^[0-9]{8}$"), s)
            .otherwise(F.coalesce(ymd(first_format(s, FORMATS_TODAY_POLICY)),
                                  F.when(F.length(digits) >= 8, F.substring(digits, 1, 8)),
                                  ymd(_lit_date(as_of)))))


def _news_date(s: Column) -> Column:
    """Dates as mail and news write them; only texts that begin like one are read."""
    return F.when(s.rlike("^([A-Za-z]{3,9}, ?)?[0-9]{1,2} [A-Za-z]{3}"), ymd(G.rfc822(s)))


def parse_date_relative(c, as_of=C.AS_OF) -> Column:
    """D3: 8 digits kept; 7+ digits read as DDYYYYM; formats, and RFC-822 as news answers write it (X13);
    'N days ago' (text holding 전 or 일, all digits joined) -> as_of - N; else as_of.  Returns
    'yyyyMMdd' text."""
    s = _c(c)
    today = ymd(_lit_date(as_of))
    dd = F.substring(s, 1, 2).try_cast("int")
    yy = F.substring(s, 3, 4).try_cast("int")
    mm = F.substring(s, 7, 1).try_cast("int")
    ddyyyym = F.when(s.rlike("^[0-9]{7,}$") & dd.between(1, 31) & yy.between(2000, 2100)
                     & mm.between(1, 9),
                     F.concat(yy.cast("string"), F.lpad(mm.cast("string"), 2, "0"),
                              F.lpad(dd.cast("string"), 2, "0")))
    digits = _digits(s)
    n = F.when(F.length(digits).between(1, 9), digits.try_cast("int"))
    relative = F.when((F.contains(s, F.lit("전")) | F.contains(s, F.lit("일")))
                      & n.isNotNull() & (n <= F.datediff(_lit_date(as_of), _lit_date("0001-01-01"))),
                      ymd(F.date_sub(_lit_date(as_of), n)))
    return (F.when(s.isNull() | (s == ""), today)
            .when(s.rlike("^[0-9]{8}$"), s)
            .otherwise(F.coalesce(ddyyyym, ymd(first_format(s, FORMATS_RELATIVE_POLICY)), _news_date(s),
                                  relative, today)))


def _zfill2(p: Column) -> Column:
    return F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p)


def parse_date_split(c, as_of=C.AS_OF) -> Column:
    """Strip; split on the first of '.', '-', '/' present; >= 3 parts -> Y + zfill(M) + zfill(D);
    else as_of.  Returns text."""
    s = strip_blank(_c(c))
    today = ymd(_lit_date(as_of))

    def by(sep):
        parts = F.split(s, "\\" + sep if sep != "/" else sep)
        p = [strip_blank(F.element_at(parts, i)) for i in (1, 2, 3)]
        return F.when(F.size(parts) >= 3, F.concat(p[0], _zfill2(p[1]), _zfill2(p[2])))

    return F.coalesce(
        F.when(F.contains(s, F.lit(".")), F.coalesce(by("."), today))
        .when(F.contains(s, F.lit("-")), F.coalesce(by("-"), today))
        .when(F.contains(s, F.lit("/")), F.coalesce(by("/"), today)),
        today)


def parse_date_trend(c) -> Column:
    """The five trend formats; unparsed -> null (rows are then left out)."""
    return first_format(_c(c), FORMATS_TREND)


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_RE = ("(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
            "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
MDY_RE = "^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})(?![0-9])"


def parse_date_clean(c) -> Column:
    """8 digits as yyyyMMdd; Korean marks and separators normalised; month/day/year with '/', '-'
    or '.' (day first where the first number can't be a month); English month names before or after
    the day (``Mar 5, 2024``, ``5 March 2024``); timestamp forms that Spark casts; any other layout of
    the date grammars (RFC-822, ISO weeks); else null.  Returns DATE."""
    s = strip_blank(_c(c))
    k = F.regexp_replace(F.regexp_replace(s, "[년월]\\s*", "-"), "일.*$", "")
    k = F.regexp_replace(k, "[./]", "-")
    def made(y, m, d):
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    a, b, y = (F.regexp_extract(k, MDY_RE, i) for i in (1, 2, 3))
    month = F.lower(F.regexp_extract(s, "(?i)" + MONTH_RE, 0))
    mm = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.substring(month, 1, 3)).cast("string")
    before = [F.regexp_extract(s, f"(?i)^{MONTH_RE}\\.? ([0-9]{{1,2}}),? ([0-9]{{4}})", i) for i in (2, 1)]
    after = [F.regexp_extract(s, f"(?i)^([0-9]{{1,2}})[ -]{MONTH_RE}\\.?,?[ -]([0-9]{{4}})", i) for i in (2, 1)]
    return F.coalesce(
        F.when(s.rlike("^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd")),
        strptime_date(k, "%Y-%m-%d"),
        F.when(k.rlike(MDY_RE), F.coalesce(made(y, a, b), made(y, b, a))),
        F.when(month != "", F.coalesce(made(before[0], mm, before[1]), made(after[0], mm, after[1]))),
        F.to_date(F.try_to_timestamp(k)),
        F.when(s.rlike("[0-9]"), G.date(s)),
    )


def iso_to_ymd(c, as_of=C.AS_OF) -> Column:
    """ISO timestamp text -> first 10 chars without '-'; else as_of."""
    s = _c(c)
    ok = s.rlike("^\\d{4}-\\d{2}-\\d{2}")
    return F.when(ok, F.replace(F.substring(s, 1, 10), F.lit("-"), F.lit(""))) \
        .otherwise(ymd(_lit_date(as_of)))


def extract_date(c) -> Column:
    """First YYYY[-./]M[-./]D in free text, else ''."""
    return F.regexp_extract(_c(c), "(\\d{4}[-./]\\d{1,2}[-./]\\d{1,2})", 1)


def ymd_to_timestamp(c, as_of=C.AS_OF) -> Column:
    """D10: 'yyyyMMdd' -> timestamp; failure -> as_of midnight."""
    s = _c(c)
    return F.coalesce(F.when(s.rlike("^\\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd"))),
                      _lit_date(as_of).cast("timestamp"))


def clamp_future(d, as_of=C.AS_OF) -> Column:
    """a date after as_of becomes as_of."""
    return F.least(_c(d), _lit_date(as_of))


def lit_date(d) -> Column:
    return _lit_date(d)


def in_window(d: Column, first: str = "2000-01-01", last=C.AS_OF) -> Column:
    """F11 as a generator: the date where it lies in the window, no row otherwise.  A filter on a
    parsed date would be pushed below the projection and parse it a second time."""
    return F.explode(F.filter(F.array(d), lambda x: x.between(F.lit(first).cast("date"), lit_date(last))))
