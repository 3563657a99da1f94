"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass their check are permuted by a keyed Feistel network within the set of
values of their format, so a value gets the same pseudonym in every document, different values stay
different, and what was valid stays valid:

* card numbers (13-19 digits, Luhn-valid): all digits but the last are permuted, the last is the new
  Luhn digit;
* phone numbers: the ten digits of area and line, with the country code and punctuation kept;
* IPv4 addresses: the 32-bit number;
* US social security numbers: area 001-899 but 666, group 01-99, serial 0001-9999;
* calendar dates (year first, or day or month first with / . or -): the day within the 271 * 271 days
  from 1900-01-01, written in the same format;
* secrets (runs of 32-64 hex digits): pieces of up to 14 digits, in their case.

An e-mail address is no number; it becomes a keyed name at a reserved domain, the same everywhere.
A candidate that fails its check (a 16-digit number that isn't Luhn-valid, 31 February, 300.1.1.1)
stays as it is.

A text is cut once at all matches of one pattern and put together again, so a pseudonym is never
matched a second time and the work is linear in the text.

Defined cases: a null text stays null, an empty one empty; texts without matches are unchanged; rows
that repeat give the same result; an empty table gives an empty result; all columns are kept by
``pseudonymise``, and n_chars, where the table has it, follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "postlens-test-key"                          # a deployment passes its own
ROUNDS = 8
DATE_SIDE = 271                                    # 271 * 271 days from DATE_FIRST
DATE_FIRST = "1900-01-01"

# fixed values: the shapes of what is looked for
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
PHONE = r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE_YMD = r"(?<!\d)\d{4}([-/.])\d{1,2}\1\d{1,2}(?!\d)"
DATE_DMY = r"(?<!\d)\d{1,2}([-/.])\d{1,2}\2\d{4}(?!\d)"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4})(?![\p{L}\p{N}])"
PATTERN = "|".join([EMAIL, SSN, DATE_YMD, DATE_DMY, IP, SECRET, CARD, PHONE])

KINDS = ("email", "ssn", "date", "ip", "secret", "card", "phone")


def _number(key: str, *parts) -> Column:
    """Keyed number below 2**52 from the parts."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """Struct (l, r): a keyed permutation of the pairs 0 <= left < left_size, 0 <= right < right_size.

    Each round adds a keyed number made from the one half to the other, modulo its size, and swaps;
    after an even number of rounds the halves have their own sizes again.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"),
                     left_size.cast("long").alias("m"), right_size.cast("long").alias("n"))

    def one(s, i):
        return F.struct(s["r"].alias("l"), ((s["l"] + _number(key, tweak, i, s["r"])) % s["m"]).alias("r"),
                        s["n"].alias("m"), s["m"].alias("n"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, one)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the digit strings (2 to 18 digits) of one length."""
    n, h = F.length(digits), F.floor(F.length(digits) / 2).cast("int")
    f = feistel(F.substr(digits, F.lit(1), h).cast("long"), F.substr(digits, h + 1).cast("long"), _ten(h), _ten(n - h),
                key, F.concat(F.lit(kind), n.cast("string")))
    return F.element_at(F.transform(F.array(f), lambda s: F.concat(F.lpad(s["l"].cast("string"), h, "0"),
                                                                  F.lpad(s["r"].cast("string"), n - h, "0"))), 1)


def _luhn_sum(payload: Column) -> Column:
    """Luhn sum of digits that a check digit will follow."""
    d = F.transform(F.split(F.reverse(payload), ""), lambda c: F.coalesce(c.cast("int"), F.lit(0)))

    def add(c, i):
        twice = c * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c)
    return F.aggregate(F.transform(d, add), F.lit(0), lambda a, c: a + c)


def luhn_digit(payload: Column) -> Column:
    return ((10 - _luhn_sum(payload) % 10) % 10).cast("string")


def put_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by these, in order."""
    step = F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
                       lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")))
                       .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))))
    return step["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _once(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def card(m: Column, key: str) -> Column:
    """Null where the number isn't Luhn-valid."""
    def new(d):
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        fresh = _once(permute_digits(payload, key, "card"), lambda p: F.concat(p, luhn_digit(p)))
        return F.when(luhn_digit(payload) == F.substr(d, F.length(d)), put_digits(m, fresh))
    return _once(_digits(m), new)


def phone(m: Column, key: str) -> Column:
    def new(d):
        code = F.substr(d, F.lit(1), F.length(d) - 10)
        return put_digits(m, F.concat(code, permute_digits(F.substr(d, F.length(d) - 9), key, "phone")))
    return _once(_digits(m), new)


def ip(m: Column, key: str) -> Column:
    """Null where an octet is over 255 or has a leading zero."""
    def new(o):
        f = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
        return F.when(F.forall(o, lambda x: x <= 255) & ~m.rlike(r"(^|\.)0\d"), _once(f, lambda s: F.concat_ws(
            ".", *[F.floor(s[h] / 256).cast("string") if k == 0 else (s[h] % 256).cast("string") for h in ("l", "r") for k in (0, 1)])))
    return _once(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), new)


def ssn(m: Column, key: str) -> Column:
    """Null for numbers that are never given out."""
    def new(p):
        ok = p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        area = p[0] - 1 - (p[0] > 666).cast("long")
        f = feistel(area, (p[1] - 1) * 9999 + p[2] - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
        return F.when(ok, _once(f, lambda s: F.concat_ws(
            "-", F.lpad((s["l"] + 1 + (s["l"] >= 665).cast("long")).cast("string"), 3, "0"),
            F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"))))
    return _once(F.transform(F.split(m, "-"), lambda x: x.cast("long")), new)


def date(m: Column, key: str) -> Column:
    """Null where it is no day of the calendar, or outside the permuted days.

    Year first is read as year, month, day.  Year last is read as day, month, year where that is a
    date, else as month, day, year.  Parts keep their width (a part without a leading zero stays so
    where its new value allows).
    """
    sep = F.regexp_extract(m, r"([-/.])", 1)

    def made(y, a, b):
        return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(a, 2, "0"), F.lpad(b, 2, "0")), "yyyy-MM-dd")

    def new(p):
        first = F.length(p[0]) == 4
        dmy, mdy = made(p[2], p[1], p[0]), made(p[2], p[0], p[1])
        day = F.when(first, made(p[0], p[1], p[2])).otherwise(F.coalesce(dmy, mdy))
        month_first = ~first & dmy.isNull()

        def shifted(k):
            f = feistel(F.floor(k / DATE_SIDE), k % DATE_SIDE, F.lit(DATE_SIDE), F.lit(DATE_SIDE), key, F.lit("date"))

            def written(d):
                def part(c, width):
                    return F.when(width >= 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
                y = F.lpad(F.year(d).cast("string"), 4, "0")
                return (F.when(first, F.concat(y, sep, part(F.month(d), F.length(p[1])), sep, part(F.dayofmonth(d), F.length(p[2]))))
                        .when(month_first, F.concat(part(F.month(d), F.length(p[0])), sep, part(F.dayofmonth(d), F.length(p[1])), sep, y))
                        .otherwise(F.concat(part(F.dayofmonth(d), F.length(p[0])), sep, part(F.month(d), F.length(p[1])), sep, y)))
            inside = k.between(0, DATE_SIDE * DATE_SIDE - 1)
            return F.when(inside, _once(_once(f, lambda s: F.date_add(F.lit(DATE_FIRST).cast("date"), (s["l"] * DATE_SIDE + s["r"]).cast("int"))), written))
        return _once(F.datediff(day, F.lit(DATE_FIRST).cast("date")).cast("long"), shifted)
    return _once(F.split(m, r"[-/.]"), new)


def secret(m: Column, key: str) -> Column:
    def piece(i):
        s = F.substr(m, i * 14 + 1, F.lit(14))
        n = F.length(s)
        h = F.floor(n / 2).cast("int")

        def size(k):
            return F.pow(F.lit(16.0), k).cast("long")
        f = feistel(F.conv(F.substr(s, F.lit(1), h), 16, 10).cast("long"), F.conv(F.substr(s, h + 1), 16, 10).cast("long"),
                    size(h), size(n - h), key, F.concat_ws("-", F.lit("hex"), F.length(m).cast("string"), i.cast("string"), n.cast("string")))

        def text(x):
            left = F.when(h > 0, F.lpad(F.conv(x["l"].cast("string"), 10, 16), h, "0")).otherwise(F.lit(""))
            return F.concat(left, F.lpad(F.conv(x["r"].cast("string"), 10, 16), n - h, "0"))
        return _once(f, text)
    upper = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 14).cast("int")), piece))
    return F.when(m.rlike("[a-f]"), F.lower(upper)).otherwise(upper)


def email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


def kind_of(m: Column) -> Column:
    """Shape of a match of PATTERN."""
    return (F.when(m.contains("@"), "email")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(m.rlike(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"), "date")
            .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
            .when((F.length(m) >= 32) & m.rlike("^[0-9A-Fa-f]+$"), "secret")
            .when(m.rlike(r"^\d{13,19}$|^\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}$"), "card")
            .otherwise("phone"))


def pseudonym(m: Column, key: str = KEY) -> Column:
    """Pseudonym of a match, null where its check fails."""
    kind = kind_of(m)
    out = F.lit(None).cast("string")
    for name, make in (("email", email), ("ssn", ssn), ("date", date), ("ip", ip), ("secret", secret), ("card", card), ("phone", phone)):
        out = F.when(kind == name, make(m, key)).otherwise(out)
    return out


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with _text (the new text), _n (replaced values) and the cut-out parts."""
    some = F.col("text").rlike("[0-9@]")
    cut = (docs.withColumn("_found", F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
           .withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key))))
    joined = F.array_join(F.zip_with(
        F.split("text", PATTERN, -1),
        F.zip_with("_found", "_new", lambda a, b: F.coalesce(b, a)),
        lambda piece, value: F.concat(piece, F.coalesce(value, F.lit("")))), "")
    return (cut.withColumn("_text", F.when(F.size("_found") > 0, joined).otherwise(F.col("text")))
            .withColumn("_n", F.coalesce(F.size(F.filter("_new", lambda b: b.isNotNull())), F.lit(0)).cast("long")))


def find_and_replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_replaced, text (with pseudonyms) for each row."""
    return (_replaced(docs.select("doc_id", "text"), key)
            .select("doc_id", F.when(F.col("_n") >= 0, F.col("_n")).otherwise(F.lit(0).cast("long")).alias("n_replaced"),
                    F.col("_text").alias("text")))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in text."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("text"))
    done = _replaced(packed, key).select(
        F.col("_row"), F.col("_text"))
    columns = [F.col("_text").alias("text") if c == "text"
               else F.coalesce(F.length("_text").cast(docs.schema["n_chars"].dataType), F.col("_row.n_chars")).alias("n_chars") if c == "n_chars"
               else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*columns)
