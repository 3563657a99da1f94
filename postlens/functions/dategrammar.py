"""Dates of any known layout from one tokenising pass and a table of grammars.

A text is cut once into numbers, words, blanks and signs.  Each token has a one-letter kind, so the
kinds joined are the text's *shape*: ``Tue, 13 May 2025 10:00:00 +0900`` is ``A, n B Y n:n:n +Y``.  A
grammar is a shape with the places of year, month and day in it; a text is matched by comparing its
shape with the table, not by a regular expression for each layout.  A new layout is a new line there.

The date is the one written, whatever zone follows it; time and zone are returned beside it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.text import let

# kinds: n 1-2 digits, D 3, Y 4, S 6, E 8, # other numbers; A weekday, B month, T, W, Z zone, P half of the day;
# a blank is a space, a sign stands for itself, any other word is ?
TOKEN_RE = "[0-9]+|\\p{L}+|\\s+|[^0-9\\p{L}\\s]"
DIGITS = {1: "n", 2: "n", 3: "D", 4: "Y", 6: "S", 8: "E"}

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# minutes east of Greenwich of the zone names of mail and news dates (fixed values)
ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
         "pst": -480, "pdt": -420, "kst": 540, "jst": 540}
HALVES = {"am": 0, "pm": 12}

MONTH_NO = {m[:n]: k for k, m in enumerate(MONTHS, 1) for n in (3, len(m))} | {"sept": 9}
WORDS = ({w[:n]: "A" for w in WEEKDAYS for n in (3, len(w))} | {m: "B" for m in MONTH_NO} | {z: "Z" for z in ZONES}
         | {h: "P" for h in HALVES} | {"t": "T", "w": "W"})

# layouts of a date, and the places of year, month and day; a second reading follows where both are possible
DATES = [
    ("Y-n-n", 0, 2, 4), ("Y.n.n", 0, 2, 4), ("Y/n/n", 0, 2, 4), ("Y. n. n", 0, 3, 6), ("Y. n. n.", 0, 3, 6),
    ("Y년n월n일", 0, 2, 4), ("Y년 n월 n일", 0, 3, 6), ("n/n/Y", 4, 0, 2), ("n/n/Y", 4, 2, 0), ("n-n-Y", 4, 0, 2), ("n-n-Y", 4, 2, 0),
    ("n.n.Y", 4, 0, 2), ("n.n.Y", 4, 2, 0), ("n B Y", 4, 2, 0), ("n-B-Y", 4, 2, 0), ("n B, Y", 5, 2, 0), ("B n, Y", 5, 0, 2),
    ("B n Y", 4, 0, 2), ("B. n, Y", 6, 0, 3), ("Y B n", 0, 2, 4), ("Y-B-n", 0, 2, 4), ("E", 0, 0, 0), ("Y-Wn-n", 0, 3, 5), ("Y-Wn", 0, 3, -1),
]
PREFIXES = ["A, ", "A ", "A,"]
# what may follow: nothing; hours and minutes, seconds, their fraction, half of the day; a zone
FRACTIONS = ["n", "D", "Y", "S", "E", "#"]
CLOCKS = ["n:n", "n:n:n", *[f"n:n:n.{f}" for f in FRACTIONS], "n:n P", "n:n:n P", "n:nP"]
OFFSETS = ["", *[b + z for b in ("", " ") for z in ("Z", "+Y", "-Y", "+n:n", "-n:n")]]
RESTS = ["", "Z", *[sep + clock + zone for sep in (" ", "T") for clock in CLOCKS for zone in OFFSETS]]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _table(rows: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in rows.items() for x in kv])


def _kind(t: Column) -> Column:
    first, size = F.ascii(t), F.length(t)
    number = F.lit("#")
    for n, k in DIGITS.items():
        number = F.when(size == n, k).otherwise(number)
    word = F.coalesce(F.element_at(_table(WORDS), F.lower(t)), F.when((size > 1) | (F.upper(t) != F.lower(t)), "?").otherwise(t))
    return F.when(first.between(48, 57), number).when(first <= 32, " ").otherwise(word)


def tokens(c) -> Column:
    """The text's tokens and shape; the only regular expression there is."""
    return let(F.regexp_extract_all(F.trim(_c(c)), F.lit(TOKEN_RE), F.lit(0)),
               lambda t: F.struct(t.alias("t"), F.array_join(F.transform(t, _kind), "").alias("shape")))


def _two(x: Column) -> Column:
    return F.lpad(x, 2, "0")


def _date(t: Column, g: Column, shape: Column) -> Column:
    """The date of tokens ``t`` (weekday left out) under grammar ``g``, null where it isn't one."""
    y, m, d = (F.get(t, g[k]) for k in ("y", "m", "d"))
    month = F.coalesce(F.element_at(_table(MONTH_NO), F.lower(m)).cast("string"), m)
    plain = F.try_to_date(F.concat_ws("-", y, _two(month), _two(d)), "yyyy-MM-dd")
    week, day = m.try_cast("int"), F.coalesce(F.when(g["d"] >= 0, d).try_cast("int"), F.lit(1))
    monday = F.trunc(F.try_to_date(F.concat(y, F.lit("-01-04")), "yyyy-MM-dd"), "week")
    in_week = F.date_add(monday, ((week - 1) * 7 + day - 1).cast("int"))
    # week 53 only in years that have one: its Thursday is still in the year
    thursday = F.date_add(monday, ((week - 1) * 7 + 3).cast("int"))
    iso = F.when(week.between(1, 53) & day.between(1, 7) & (F.year(thursday) == y.try_cast("int")), in_week)
    return (F.when(g["shape"] == "E", F.try_to_date(y, "yyyyMMdd"))
            .when(F.contains(g["shape"], F.lit("W")), iso).otherwise(plain))


def _clock(t: Column, rest: Column) -> tuple[Column, Column]:
    """(seconds of the day, minutes east of Greenwich) of what follows the date; null where not given or
    not a time."""
    h, mi = (F.get(t, F.lit(k)).try_cast("int") for k in (1, 3))
    s = F.when(F.substring(rest, 5, 2) == ":n", F.get(t, F.lit(5)).try_cast("int")).otherwise(0)
    half = F.when(F.contains(rest, F.lit("P")), F.element_at(_table(HALVES), F.lower(F.get(t, F.instr(rest, "P") - 1))))
    hour = F.when(half.isNull(), h).when(h.between(1, 12), h % 12 + half)
    timed = F.length(rest) > 2
    seconds = F.when(timed & hour.between(0, 23) & mi.between(0, 59) & s.between(0, 60), hour * 3600 + mi * 60 + s)
    name = F.element_at(_table(ZONES), F.lower(F.get(t, F.length(rest) - 1)))
    at = F.greatest(F.instr(rest, "+"), F.instr(rest, "-"))                       # 1-based place of the sign
    sign = F.when(F.instr(rest, "+") > 0, 1).otherwise(-1)
    digits = F.when(F.substring(rest, at + 1, 1) == "Y", F.get(t, at)).otherwise(F.concat(_two(F.get(t, at)), _two(F.get(t, at + 2))))
    offset = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return seconds, F.when(rest.endswith("Z"), name).when(at > 0, sign * offset)


def parse(c) -> Column:
    """struct(date, seconds, offset, shape); date is null where no grammar gives a real day."""
    grammars = F.array(*[F.struct(F.lit(s).alias("shape"), F.lit(len(s)).alias("n"), F.lit(y).alias("y"), F.lit(m).alias("m"), F.lit(d).alias("d"))
                         for s, y, m, d in DATES])
    rests = F.array(*[F.lit(r) for r in RESTS])

    def cut(x: Column) -> Column:
        skip = F.lit(0)
        for p in reversed(PREFIXES):
            skip = F.when(x["shape"].startswith(p), len(p)).otherwise(skip)
        return let(skip, lambda k: F.struct(F.slice(x["t"], k + 1, F.greatest(F.size(x["t"]) - k, F.lit(0))).alias("t"),
                                            F.substring(x["shape"], k + 1, F.length(x["shape"])).alias("shape"), x["shape"].alias("whole")))

    def read(x: Column) -> Column:
        fits = F.filter(grammars, lambda g: x["shape"].startswith(g["shape"]) & F.array_contains(rests, F.substring(x["shape"], g["n"] + 1, F.length(x["shape"]))))
        days = F.filter(F.transform(fits, lambda g: F.struct(_date(x["t"], g, x["shape"]).alias("date"), g["n"].alias("n"))), lambda r: r["date"].isNotNull())

        def out(first: Column) -> Column:
            rest = F.substring(x["shape"], first["n"] + 1, F.length(x["shape"]))
            seconds, offset = _clock(F.slice(x["t"], first["n"] + 1, F.greatest(F.size(x["t"]) - first["n"], F.lit(0))), rest)
            # a time that isn't one makes the whole text no date
            real = (F.length(rest) <= 2) | seconds.isNotNull()
            return F.struct(F.when(real, first["date"]).alias("date"), F.when(real, seconds).alias("seconds"),
                            F.when(real, offset).alias("offset"), x["whole"].alias("shape"))
        return let(F.get(days, F.lit(0)), out)

    return let(let(tokens(c), cut), read)


def date(c) -> Column:
    return parse(c)["date"]


def ymd_text(c) -> Column:
    """The date as ``yyyyMMdd`` text; anything else is null."""
    return F.date_format(date(c), "yyyyMMdd")


def rfc822(c) -> Column:
    """The date of a mail or news date (weekday, day, month's name, year, time, zone), else null."""
    return let(parse(c), lambda r: F.when(F.contains(r["shape"], F.lit("n B Y")), r["date"]))
