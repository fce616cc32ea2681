from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions import times


def each(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    return [r["o"] for r in rows.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


NBSP, WIDE, BOM = " ", "　", "﻿"


def test_dates(spark):
    given = ["2026-03-01", "2026.3.1", "2026. 3. 1.", "26.03.01", "2026-03-01/", "2026-03-01 ~ 2026-03-10", f"{NBSP}2026.03.05{WIDE}", "2026.3.1 12:30", "2026-13-45", "2026/03/01", "등록일 2026-03-01", "2026년 3월 1일", "", "  -  ", None]
    want = ["2026-03-01"] * 6 + ["2026-03-05", "2026-03-11", "2026-13-45", "2026/03/01", "등록일 2026-03-01", "2026년 3월 1일", "", "-", ""]
    assert each(spark, given, T.normalize_date) == want
    strict = each(spark, given, T.normalize_date_strict)
    assert strict[7:10] == ["2026-03-01", None, "2026-03-01"]


def test_dates_in_text(spark):
    given = ["2026-03-15", "2026.12.31", "2026-03-01 ~ 2026-03-09", "2026-13-01", "26년 3월 5일", None]
    assert each(spark, given, T.extract_dates) == [["2026-03-01"], ["2026-12-03"], ["2026-03-01", "2026-03-09"], [], ["2026-03-05"], []]
    assert each(spark, given[:2], lambda c: T.extract_dates(c, strict=True)) == [["2026-03-15"], ["2026-12-31"]]


def test_tokens(spark):
    given = ["2026년 국립민속박물관 학예연구사 기간제근로자 채용 공고", "[국립민속박물관] 학예연구사(기간제근로자) 3명 모집 2차", "3월15일 Museum museum 20260315", "채용 공고", "", None]
    first = ["국립민속박물관", "학예연구사", "기간제근로자"]
    assert each(spark, given, T.title_tokens) == [first, first, ["Museum", "museum"], [], [], []]


def test_keys_and_cuts(spark):
    assert each(spark, ["학예직 채용…", "[국립] 「한글」 학예-직_채용, 공고.", None], T.crawl_key) == ["학예직채용", "국립한글학예직채용공고", ""]
    assert each(spark, ["학예직 채용…", "A b"], T.view_key) == ["학예직채용…", "ab"]
    assert each(spark, ["x" * 80, "y" * 81, f"{BOM} a{NBSP}\n b ", None], T.truncate) == ["x" * 80, "y" * 80 + "...", "a b", ""]
    assert each(spark, ["x" * 30 + "...", "  ab...", None], T.title_core) == ["x" * 20, "ab", ""]
    assert each(spark, [f"{NBSP}a\u0085{WIDE}", "​a᠎"], T.trim) == ["a\u0085", "​a᠎"]


def test_lengths_are_units_of_utf16(spark):
    def cut(text, n):
        b = text.encode("utf-16-le")[: 2 * n]
        return b.decode("utf-16-le", "replace")

    smile = "\U0001f600"
    given = [smile * 40, smile * 41, "x" * 79 + smile, "x" * 78 + smile + "y", "x" * 80, "가" * 79 + smile * 3, smile * 39 + "ab", "a" + smile * 40]
    want = [t if len(t.encode("utf-16-le")) <= 160 else cut(t, 80) + "..." for t in given]
    assert want[2] == "x" * 79 + "\ufffd..." and each(spark, given, T.truncate) == want
    assert each(spark, given, T.title_core) == [cut(t, 20) for t in given]
    assert each(spark, [f"{smile} a bb 채", smile], T.title_tokens) == [[smile, "bb"], [smile]]
    assert each(spark, [smile + "ab", ""], T.units) == [4, 0]


def test_small_ones(spark):
    assert each(spark, ["", None, "x"], lambda c: T.or_default(c, F.lit("d"))) == ["d", "d", "x"]
    assert each(spark, ["", None, "26.1.2"], T.optional_date) == [None, None, "2026-01-02"]
    assert each(spark, ["[a] b", "b [a]", None], lambda c: T.bracketed_organization(c, "d")) == ["a", "d", "d"]
    assert each(spark, ["b [a]"], lambda c: T.bracketed_organization(c, "d", True)) == ["a"]
    assert each(spark, ["javascript:go('12')", "go('1','7')", "x", None], lambda c: T.called_id(c, "go")) == ["12", "7", None, None]
    assert each(spark, ["2026-01-02", None], T.dotted) == ["2026.01.02", ""]
    assert each(spark, [None], lambda c: T.minute(c.cast("timestamp"))) == ["-"]


NOON, MIDNIGHT = datetime(2026, 3, 31, 12), datetime(2026, 3, 31)


def test_month_rules(spark):
    given = ["2026-03-02", "2026-03-03", "2026-03-04", "2027-01-01", "", "상시", "2026-13-45", None]
    assert each(spark, given, lambda c: times.within_month(c, NOON)) == [False, False, True, True, True, True, True, True]
    assert each(spark, given[:3], lambda c: times.within_month(c, MIDNIGHT)) == [False, True, True]
    assert each(spark, ["2026-02-28", "2026-03-01"], lambda c: times.within_month(c, NOON, strict=True)) == [False, True]
    assert each(spark, given, lambda c: times.within_month_view(c, NOON)) == [False, True, True, True, False, True, True, False]
    assert each(spark, given[:3], lambda c: times.within_month_view(c, NOON, zone="America/New_York")) == [False, False, True]


def test_zones_move_the_bounds(spark):
    """31 March 01:00 UTC: 10:00 of the day in Seoul, the evening before in New York."""
    early = datetime(2026, 3, 31, 1)
    given = ["2026-02-27", "2026-02-28", "2026-03-01", "2026-03-02", "2026-03-03", "2026-03-04", "2026.2.28", "2026.3.2", "2026/03/03"]
    view = lambda zone: each(spark, given, lambda c: times.within_month_view(c, early, zone))
    first = lambda zone: next(g for g, ok in zip(given, view(zone), strict=True) if ok)
    assert [first(z) for z in ("UTC", "Asia/Seoul", "America/New_York")] == ["2026-03-03", "2026-03-03", "2026-03-03"]
    assert view("America/New_York")[6:] == [False, True, True] and view("Asia/Seoul")[6:] == view("UTC")[6:] == [False, False, True]
    crawl = lambda zone: each(spark, given[:6], lambda c: times.within_month(c, early, zone=zone)).index(True)
    assert [given[crawl(z)] for z in ("UTC", "Asia/Seoul", "America/New_York")] == ["2026-03-04", "2026-03-04", "2026-03-03"]
    noon = datetime(2026, 3, 31, 20)  # 1 April in Seoul
    assert each(spark, ["2026-02-28", "2026-03-01"], lambda c: times.within_month_view(c, noon, "Asia/Seoul")) == [False, True]


def test_days_of_dates_in_all_shapes(spark):
    now = datetime(2026, 3, 31, 16)
    given = ["2026-03-28", "2026-03-29", "2026.3.28", "2026/03/29", "2026-3-29", "2026.03.28.", "2026.13.1", "03.29"]
    assert each(spark, given, lambda c: times.is_new(c, now)) == [False, True, False, True, True, False, False, False]
    assert each(spark, given, lambda c: times.is_new(c, now, "Asia/Seoul"))[:4] == [False, True, False, False]  # 29 March began on the 28th at 15:00 UTC
    assert each(spark, given, lambda c: times.is_new(c, now, "America/New_York"))[:4] == [False, True, False, True]
    summer = datetime(2026, 3, 11, 5, 30)  # New York's clocks went forward on 8 March
    assert each(spark, ["2026.3.8"], lambda c: times.is_new(c, summer, "America/New_York")) == [False]
    assert each(spark, ["2026.3.9"], lambda c: times.within_days(c, datetime(2026, 3, 12, 4), 3, "America/New_York")) == [True]


@pytest.mark.parametrize(("now", "want"), [(MIDNIGHT, True), (datetime(2026, 3, 31, 0, 0, 1), False)])
def test_days_are_counted_to_the_second(spark, now, want):
    assert each(spark, ["2026-03-28", "", "상시", "2026-04-09", None], lambda c: times.within_days(c, now, 3)) == [want, False, False, True, False]


def test_month_back(spark):
    days = ["2026-03-31", "2026-03-28", "2024-03-31", "2026-01-15"]
    assert [str(d) for d in each(spark, days, lambda c: times.month_back(c.cast("date")))] == ["2026-03-03", "2026-02-28", "2024-03-02", "2025-12-15"]


def test_a_text_is_read_once_for_all_that_is_made_of_it(spark):
    # Written twice, a column is computed twice, and the code of a run's boards grew beyond what can be compiled.
    assert str(T.truncate("raw")).count("regexp_extract") == 1
    assert str(T.normalize_date("raw")).count("regexp_extract") == 1
    texts = ["2026-3-1", "26.3.1.", " 2026. 3. 11. ", "26-3-1/", "2026-03-01-", "202-3-1", "226-3-1", "2026-3", "2026/3/1", "", " x ", None, "12345-1-1", "2026-123-1", "26-12-123"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = [r["d"] for r in rows.select("i", T.normalize_date("raw").alias("d")).orderBy("i").collect()]
    assert got == ["2026-03-01", "2026-03-01", "2026-03-11", "2026-03-01", "2026-03-01", "202-3-1", "226-3-1", "2026-3", "2026/3/1", "", "x", "", "12345-1-1", "2026-123-1", "2026-12-12"]
