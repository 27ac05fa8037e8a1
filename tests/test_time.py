"""Fixed instants: sessions, DST, holidays, trading day, schedule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import timeexpr as tx


def at(spark, texts, **cols):
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").withColumn("ts", F.col("t").cast("timestamp"))
    return df


def one(spark, text, expr):
    return at(spark, [text]).select(expr(F.col("ts")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("2025-01-15 09:00:00", "LONDON"), ("2025-01-15 14:00:00", "OVERLAP"), ("2025-01-15 18:00:00", "NEWYORK"),
    ("2025-01-15 02:00:00", "ASIA"), ("2025-01-15 23:00:00", None), ("2025-07-15 07:00:00", "LONDON"),
    ("2025-03-20 12:30:00", "OVERLAP"),
])
def test_primary_session(spark, text, want):
    assert one(spark, text, tx.primary_session) == want


@pytest.mark.parametrize("text,want", [
    ("2025-01-17 21:30:00", True), ("2025-01-17 22:30:00", False), ("2025-07-13 20:00:00", False),
    ("2025-07-13 22:00:00", True), ("2025-12-25 14:00:00", False), ("2025-04-18 14:00:00", False),
    ("2025-12-24 16:00:00", True), ("2025-12-24 17:30:00", False), ("2026-07-03 15:00:00", False),
    ("2025-07-04 15:00:00", False), ("2025-11-28 18:00:00", False), ("2025-01-18 12:00:00", False),
])
def test_market_open(spark, text, want):
    got = tx.with_market_open(at(spark, [text])).first()["is_open"]
    assert got is want
    years = spark.range(2025, 2027).select(F.col("id").cast("int").alias("year"))
    cal = tx.holiday_calendar(years).drop("year")
    assert tx.with_market_open(at(spark, [text]), calendar=cal).first()["is_open"] is want


def test_easter_and_calendar_size(spark):
    df = spark.createDataFrame([(2024,), (2025,), (1961,), (2038,), (2285,)], "y INT")
    got = [r[0] for r in df.select(tx.easter(F.col("y"))).collect()]
    assert got == [dt.date(2024, 3, 31), dt.date(2025, 4, 20), dt.date(1961, 4, 2), dt.date(2038, 4, 25), dt.date(2285, 3, 22)]
    years = spark.range(2000, 2040).select(F.col("id").cast("int").alias("year"))
    per = tx.holiday_calendar(years).groupBy("year", "kind").count().collect()
    assert {r["count"] for r in per if r["kind"] == "closed"} == {10}
    assert {r["count"] for r in per if r["kind"] == "half"} == {2}


def test_trading_day_rolls_at_five_pm_new_york(spark):
    day = lambda t: str(one(spark, t, tx.trading_day))
    assert day("2025-01-15 21:59:00") == "2025-01-14" and day("2025-01-15 22:00:00") == "2025-01-15"
    assert day("2025-07-15 20:59:00") == "2025-07-14" and day("2025-07-15 21:00:00") == "2025-07-15"


def test_overlap_longer_in_mismatch_weeks(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 15),), (dt.date(2025, 3, 20),)], "day DATE")
    a, b = tx.overlap_bounds(F.col("day"))
    hours = [r[0] for r in df.select((F.unix_timestamp(b) - F.unix_timestamp(a)) / 3600).collect()]
    assert hours == [3.0, 4.0]


def test_schedule_keeps_ties_together(spark):
    t, names = tx.next_events(F.col("ts"))
    r = at(spark, ["2025-01-17 20:50:00"]).select(t.alias("t"), names.alias("n")).first()
    assert str(r["t"]) == "2025-01-17 21:00:00"
    assert set(r["n"]) == {"BAR_CLOSE_15M", "MARKET_CLOSE", "WEEKLY_REPORT"}
    r = at(spark, ["2025-01-17 21:00:00"]).select(tx.next_weekday_time(F.col("ts"), 4, 21).alias("t")).first()
    assert str(r["t"]) == "2025-01-24 21:00:00"


def test_display(spark):
    assert one(spark, "2026-07-14 00:15:00", tx.display_utc_and_tehran) == "2026-07-14 00:15 UTC / 03:45 IRST"


def test_easter_of_far_years(spark):
    """Against the rule of the anonymous Gregorian computus, over years before 1900 and after 2299."""
    def plain(y):
        a, b, c = y % 19, y // 100, y % 100
        h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        w = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        m = (a + 11 * h + 22 * w) // 451
        return dt.date(y, (h + w - 7 * m + 114) // 31, (h + w - 7 * m + 114) % 31 + 1)

    years = [*range(1583, 1900, 3), *range(1900, 2300), *range(2300, 4100, 7)]
    df = spark.createDataFrame([(y,) for y in years], "y INT")
    assert {r[0]: r[1] for r in df.select("y", tx.easter(F.col("y"))).collect()} == {y: plain(y) for y in years}
