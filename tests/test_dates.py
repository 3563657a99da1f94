import datetime as dt

import pytest
from pyspark.sql import functions as F

from postlens.functions import dates as D
from tests.conftest import one

AS_OF = dt.date(2026, 12, 1)


def _null_policy(spark, s, platform=None):
    col = D.parse_date_null(F.col("s"), F.lit(platform) if platform else None, as_of=AS_OF)
    return one(spark, col, s)


def test_null_policy_formats(spark):
    # C1
    for s in ["20250513", "2025-05-13", "2025.05.13", "2025년05월13일", "2025/05/13", "13/05/2025"]:
        assert _null_policy(spark, s) == dt.date(2025, 5, 13), s
    assert _null_policy(spark, "05/06/2025") == dt.date(2025, 6, 5)
    assert _null_policy(spark, "2025-5-3") == dt.date(2025, 5, 3)


def test_null_policy_edge(spark):
    # C2
    assert _null_policy(spark, "12202517") is None
    assert _null_policy(spark, "13052025") == dt.date(2013, 5, 20)
    assert _null_policy(spark, "19991231") is None
    assert _null_policy(spark, "2024-02-30") is None
    assert _null_policy(spark, None) is None


def test_today_policy(spark):
    # C3
    f = lambda s: one(spark, D.parse_date_today(F.col("s"), as_of=AS_OF), s)
    assert f("") == "20261201"
    assert f(None) == "20261201"
    assert f("2025년 5월 3일") == "20250503"
    assert f("id 20230101x") == "20230101"
    assert f("abc") == "20261201"
    assert f("20249999") == "20249999"  # 8 digits are kept as text


def test_relative_policy(spark):
    # C4
    f = lambda s: one(spark, D.parse_date_relative(F.col("s"), as_of=AS_OF), s)
    assert f("3일 전") == "20261128"
    assert f("어제") == "20261201"
    assert f("0520253") == "20250305"  # DDYYYYM
    assert f("2024-03-20T10:11:12") == "20240320"


def test_split_policy(spark):
    # C5
    f = lambda s: one(spark, D.parse_date_split(F.col("s"), as_of=AS_OF), s)
    assert f("2025.5.3") == "20250503"
    assert f("2025-12-1") == "20251201"
    assert f("x") == "20261201"
    assert f("2025.5") == "20261201"


def test_iso_and_extract(spark):
    assert one(spark, D.iso_to_ymd(F.col("s"), as_of=AS_OF), "2024-03-05T10:00:00Z") == "20240305"
    assert one(spark, D.iso_to_ymd(F.col("s"), as_of=AS_OF), "garbage") == "20261201"
    assert one(spark, D.extract_date(F.col("s")), "posted on 2024.3.5 by x") == "2024.3.5"
    assert one(spark, D.extract_date(F.col("s")), "none") == ""


def test_clean_policy_and_ymd_timestamp(spark):
    # 8 digits, Korean marks, separators, timestamps; else null
    f = lambda s: one(spark, D.parse_date_clean(F.col("s")), s)
    assert f("20240305") == dt.date(2024, 3, 5)
    assert f("2024년 3월 5일") == dt.date(2024, 3, 5)
    assert f("2024.03.05") == dt.date(2024, 3, 5)
    assert f("2024-03-05 10:11:12") == dt.date(2024, 3, 5)
    assert f("not a date") is None
    # yyyyMMdd -> timestamp, failure -> as_of midnight
    g = lambda s: one(spark, D.ymd_to_timestamp(F.col("s"), as_of=AS_OF), s)
    assert g("20240305").date() == dt.date(2024, 3, 5)
    assert g("bad").date() == AS_OF


@pytest.mark.parametrize("text, want", [
    ("05/06/2025", "2025-05-06"), ("13/05/2025", "2025-05-13"), ("Mar 5, 2024", "2024-03-05"), ("5 March 2024", "2024-03-05"),
    ("september 30 2023", "2023-09-30"), ("12-Dec-2022", "2022-12-12"), ("Feb 30, 2024", None), ("13/13/2025", None),
    ("march", None), ("20240229", "2024-02-29"), ("2024년 3월 5일", "2024-03-05"), ("", None), (None, None)])
def test_clean_dates_general_forms(spark, text, want):
    got = one(spark, D.parse_date_clean("s"), text)
    assert (got.isoformat() if got else None) == want
